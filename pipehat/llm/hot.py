"""Joins in which a few values hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A value is hot with more rows than this share of all, and than this many; so there are at most MOST_HOT hot values.
MOST_HOT, LEAST_HOT = 10_000, 500


def hot_values(sizes: DataFrame, on: str, total: int) -> DataFrame | None:
    """(on, deals) of the hot values: over how many tasks each is dealt. sizes: (on, n), each value once, n summing up to total
    at most. None if no value is hot."""
    most = max(LEAST_HOT, total // MOST_HOT)
    hot = sizes.where(F.col("n") > most).select(on, F.ceil(F.col("n") / most).cast("int").alias("deals"))
    return None if hot.isEmpty() else hot


def dealt_join(big: DataFrame, small: DataFrame, on: str, hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """big joined with small, which has few rows for each value of `on`: hot values are dealt by big's column `by`, and their rows
    of small repeated for each deal. At most MOST_HOT rows are broadcast. how: inner or left."""
    if hot is None:
        return big.join(small, on, how)
    deals = F.broadcast(hot)
    one = big.join(deals, on, "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64(by), F.col("deals").cast("long")), F.lit(0)).cast("int")).drop("deals")
    two = small.join(deals, on, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("deals"), F.lit(1)) - 1))).drop("deals")
    return one.join(two, [on, "deal"], how).drop("deal")
