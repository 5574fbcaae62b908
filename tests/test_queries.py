from collections import Counter

import duckdb
import pytest

from pipehat import queries, service_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", queries.QUERIES)
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    expected = duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert Counter(tuple(str(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(str(r[i]) for i in at) for r in expected.fetchall())
