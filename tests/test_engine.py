import random

import pytest

from pipehat.operators.engine import Engine, query
from pipehat.operators.queues import QueueProblem, QueueState, by_time, stored
from pipehat.plans.bind import BindProblem, Semantics

from .samples import ADT_JONES, admission

NOW, HOUR, DAY = 1_700_000_000, 3600, 86400


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def make(spark, root, **how):
    return Engine(spark, root, clock=lambda: NOW, **how)


def filled(spark, root, n, **how):
    e = make(spark, root, **how)
    e.sql("CREATE QUEUE q")
    rows = spark.createDataFrame([(i, admission(i, f"P{i:03d}")) for i in range(n)], "i int, raw_message string")
    e.insert_frame("q", rows, ["i"])
    return e


def controls(df):
    return sorted(r[0] for r in df.select("msh9").collect())


@pytest.fixture(scope="module")
def timed(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('timed')}", clock=lambda: NOW)
    e.sql("CREATE QUEUE q")
    ages = [5 * DAY, 2 * DAY, DAY, 2 * HOUR, HOUR]
    rows = [(i, admission(i, f"P0000{p}", NOW - a), NOW - a) for i, (a, p) in enumerate(zip(ages, (1, 2, 3, 4, 1), strict=True))]
    e.insert_frame("q", spark.createDataFrame(rows, "i int, raw_message string, timestamp bigint"), ["i"])
    return e


@pytest.mark.parametrize(
    "where,n",
    [
        ("timestamp > LAST_N_HOURS(3)", 2), ("timestamp > LAST_N_HOURS(30)", 3), ("timestamp > LAST_N_DAYS(1)", 2), ("timestamp > LAST_N_DAYS(3)", 4), ("timestamp > LAST_N_DAYS(7)", 5),
        (f"timestamp BETWEEN {NOW - 2 * DAY - HOUR} AND {NOW}", 4), ("timestamp BETWEEN LAST_N_DAYS(6) AND LAST_N_DAYS(1)", 3), (f"timestamp >= {NOW - DAY}", 3), (f"timestamp < {NOW - DAY}", 2), (f"timestamp = {NOW - HOUR}", 1),
        ("timestamp > LAST_N_DAYS(7) AND segment.PID[3] = 'P00001'", 2), ("timestamp > LAST_N_DAYS(2) AND segment.PID[3] = 'P00003'", 1), (f"timestamp BETWEEN {NOW} AND {NOW - DAY}", 0),
        ("segment.PID[3] = 'ADT^A01'", 0), ("segment.PID[3] != 'P00001'", 3), ("segment.ZZZ[1] != 'x'", 0), ("segment.PID[3] LIKE 'p%'", 0), ("segment.PID[3] LIKE '%3'", 1), ("segment.PID[1] = 1", 5), ("segment.PID[3] > 5", 0),
    ],
)
def test_time_and_field_predicates(timed, where, n):
    assert timed.sql(f"SELECT timestamp FROM q WHERE {where}").count() == n


def test_zero_hours(spark, timed, root):
    with pytest.raises(BindProblem):
        timed.sql("SELECT * FROM q WHERE timestamp > LAST_N_HOURS(0)")
    e = filled(spark, root, 3, zero_means_all=True)
    assert e.sql("SELECT * FROM q WHERE segment.PID[3] = 'none' AND timestamp > LAST_N_DAYS(0)").count() == 3


def test_wildcard_and_counts(timed):
    assert timed.sql("SELECT * FROM q").columns == ["msg_id", "msg_type", "timestamp", "raw_message"]
    assert timed.sql("SELECT *, timestamp FROM q").columns == ["msg_id", "msg_type", "timestamp", "raw_message"]
    assert timed.sql("SELECT COUNT(*) FROM q").first()[0] == 5
    with pytest.raises(BindProblem):
        timed.sql("SELECT COUNT(*), timestamp FROM q")
    with pytest.raises(BindProblem):
        timed.sql("SELECT * FROM q WHERE COUNT(*) > 1")


def test_shredded_filter_reaches_the_scan(timed):
    def plan(text):
        return timed.sql(text)._jdf.queryExecution().executedPlan().toString()

    assert "EqualTo(pid3,P00001)" in plan("SELECT timestamp FROM q WHERE segment.PID[3] = 'P00001'")
    p = plan(f"SELECT timestamp FROM q WHERE timestamp > {NOW}")
    assert f"GreaterThan(timestamp,{NOW})" in p and "segments" not in p.split("ReadSchema")[1]


def test_queue_life(spark, root):
    e = make(spark, root)
    assert e.run("CREATE QUEUE q").code == 0 and e.run("CREATE QUEUE q").code == 2
    assert e.store.is_empty("q") and not e.store.is_empty("other") and not e.store.has("other")
    for i in (1, 2, 3):
        assert e.sql(f"INSERT MESSAGE INTO q '{admission(i, f'P00{i}')}'") == 1
    assert (e.store.size("q"), e.store.history_size("q")) == (3, 0)
    assert e.run("DROP QUEUE q").code == 2
    first = e.sql("POP MESSAGE FROM q").collect()
    assert [(r.msg_id, r.msg_type) for r in first] == [(1, "MSG001")]
    assert (e.store.size("q"), e.store.history_size("q")) == (2, 1)
    e.sql("POP MESSAGE FROM q")
    assert (e.store.size("q"), e.store.history_size("q")) == (1, 2)
    assert e.sql("SELECT * FROM q.history WHERE segment.PID[3] = 'P001'").count() == 1
    again = make(spark, root)  # what was popped doesn't come back
    assert controls(again.store.active("q")) == ["MSG003"] and controls(again.store.history("q")) == ["MSG001", "MSG002"]
    assert e.sql("CLEAR HISTORY q") == 2
    assert (e.store.size("q"), e.store.history_size("q"), make(spark, root).store.history_size("q")) == (1, 0, 0)
    e.sql("POP MESSAGE FROM q")
    assert e.sql("POP MESSAGE FROM q").count() == 0
    e.sql("DROP QUEUE q")
    e.sql("CREATE QUEUE q")
    assert (e.store.size("q"), e.store.history_size("q"), e.store.names()) == (0, 0, ["q"])
    for bad in ("SELECT * FROM none", "POP MESSAGE FROM none", "CLEAR HISTORY none", "DROP QUEUE none", "INSERT MESSAGE INTO none 'x'"):
        assert e.run(bad).code == 2, bad
    assert e.run("SELEC").code == 1 and e.run(None).code == -1
    assert stored(spark, root)


def test_history_limits(spark, root):
    e = filled(spark, root, 20)
    e.store.pop("q", 10)
    assert e.store.history_size("q") == 10
    e.store.set_history_config(3, True)  # one goes for each that comes
    e.store.pop("q", 2)
    assert e.store.history_size("q") == 10 and controls(e.store.history("q"))[0] == "MSG002"


def test_full_history_keeps_messages(spark, root):
    e = filled(spark, root, 10, history_limit=5)
    assert e.store.pop("q", 10).count() == 5 and e.sql("POP MESSAGE FROM q").count() == 0
    assert (e.store.size("q"), e.store.history_size("q")) == (5, 5)


def test_full_history_may_lose_messages(spark, root):
    e = filled(spark, root, 10, history_limit=5, lossy_reject=True)
    assert e.store.pop("q", 8).count() == 5
    assert (e.store.size("q"), e.store.history_size("q")) == (2, 5)
    e.store.set_history_config(0, False)
    e.store.pop("q", 2)
    assert controls(e.store.history("q")) == [f"MSG00{i}" for i in (0, 1, 2, 3, 4, 8, 9)]


def test_rotation(spark, root):
    e = filled(spark, root, 12, history_limit=5, rotate=True)
    e.store.pop("q", 10)
    assert controls(e.store.history("q")) == [f"MSG00{i}" for i in range(5, 10)]


def test_pops_against_a_plain_version():
    rnd = random.Random(3)
    for _ in range(300):
        q, active, past = QueueState(), [], []
        for _ in range(8):
            limit, rotate, lossy, n = rnd.choice((0, 1, 3, 6)), rnd.random() < 0.5, rnd.random() < 0.5, rnd.randint(0, 7)
            active += range(q.tail, q.tail + (more := rnd.randint(0, 6)))
            q.tail += more
            start, taken = q.head, []
            for _ in range(min(n, len(active))):
                if limit and len(past) >= limit:
                    if not rotate:
                        if not lossy:
                            break
                        active.pop(0)
                        continue
                    past.pop(0)
                taken.append(active.pop(0))
                past.append(taken[-1])
            got = q.take(n, limit, rotate, lossy)
            assert list(range(start, start + got)) == taken and list(range(q.head, q.tail)) == active
            assert [x for x in range(q.history, q.head) if not any(a <= x < b for a, b in q.lost)] == past and q.history_size == len(past)


def test_compaction_keeps_runs_of_ids(spark, root):
    e = filled(spark, root, 3)
    e.sql("CREATE QUEUE other")
    for queue in ("q", "other", "q", "q"):
        e.sql(f"INSERT MESSAGE INTO {queue} '{ADT_JONES}'")
    before = sorted((r.seq, r.msg_id, r.msh9) for r in e.store.active("q").collect())
    e.store.compact("q")
    assert len(e.store.state()[1]["queues"]["q"].batches) == 2 and sorted((r.seq, r.msg_id, r.msh9) for r in e.store.active("q").collect()) == before


def test_several_batches_and_queues(spark, root):
    e = filled(spark, root, 4)
    more = spark.createDataFrame([(i, admission(i, "P")) for i in (11, 10)], "i int, raw_message string")
    assert e.insert_frame("q", more, ["i"]) == (5, 2)
    e.sql("CREATE QUEUE other")
    e.sql(f"INSERT MESSAGE INTO other '{ADT_JONES}'")
    assert [(r.queue, r.seq, r.msg_id) for r in e.store.everything().orderBy("queue", "seq").collect()] == [("other", 0, 7), *(("q", i, i + 1) for i in range(6))]
    assert [r.msh9 for r in e.store.active("q").orderBy("seq").collect()][-2:] == ["MSG010", "MSG011"]
    assert e.sql("SELECT COUNT(*) AS n FROM *").first().n == 7
    assert {(r.queue, r.messages, r.total) for r in e.store.statistics().collect()} == {("q", 6, 6), ("other", 1, 1)}
    before = sorted(map(str, e.store.active("q").collect()))
    e.store.compact("q")
    assert sorted(map(str, e.store.active("q").collect())) == before and len(e.store.state()[1]["queues"]["q"].batches) == 1
    assert [r.position for r in e.store.positions("q").orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6]
    assert e.store.get("q", 2).first().msh9 == "MSG001"
    e.store.pop("q", 2)
    e.store.clear("q")
    assert (e.store.size("q"), e.store.history_size("q")) == (0, 2)


def test_versions_are_pinned(spark, root):
    e = filled(spark, root, 3)
    version = e.store.state()[0]
    e.store.pop("q", 3)
    assert e.store.active("q").count() == 0 and e.store.active("q", version).count() == 3


def test_escaped_returns_and_apostrophes(spark, root):
    e = make(spark, root, extended=True)
    e.sql("CREATE QUEUE q")
    e.sql("INSERT MESSAGE INTO q 'MSH|^~\\&|A\\rPID|1||P1||O''BRIEN^X'")
    assert e.sql("SELECT segment.PID[5] AS n FROM q").first().n == "O'BRIEN"


def test_empty_and_null_batches(spark, root):
    e = make(spark, root)
    e.sql("CREATE QUEUE q")
    assert e.insert_frame("q", spark.createDataFrame([], "raw_message string"), ["raw_message"])[1] == 0
    assert e.sql("SELECT * FROM q").count() == 0 and e.sql("SELECT * FROM *").count() == 0
    e.insert_frame("q", spark.createDataFrame([(None, 1), ("junk", 1)], "raw_message string, extra int"), ["extra"])
    assert e.sql("SELECT * FROM q").count() == 2
    with pytest.raises(QueueProblem):
        e.store.create("no name")


def test_standard_numbering_and_time_range(spark, root):
    e = make(spark, root, numbering="standard")
    e.sql("CREATE QUEUE q")
    e.sql(f"INSERT MESSAGE INTO q '{ADT_JONES}'")
    assert e.sql("SELECT segment.MSH[9] AS t, segment.MSH[10] AS c, segment.MSH[12] AS v FROM q WHERE segment.MSH[9] = 'ADT'").first() == ("ADT", "MSG00001", "2.5")
    assert by_time(e.store.active("q"), 1686817800, 1686817800).count() == 1 and by_time(e.store.active("q"), 1686817801, 1686817900).count() == 0


def test_extended_over_plain_frames(spark):
    df = spark.createDataFrame([(i, i * 10, admission(i, f"P{i % 2}")) for i in range(6)], "msg_id bigint, timestamp bigint, raw_message string")
    how = Semantics(now=NOW, extended=True)
    out = query(df, "SELECT segment.PID[3] AS pid, COUNT(*) AS n, MAX(timestamp) AS m FROM q WHERE NOT msg_id IN (0) GROUP BY pid HAVING COUNT(*) > 1 ORDER BY m DESC LIMIT 5", how)
    assert [tuple(r) for r in out.collect()] == [("P1", 3, 50), ("P0", 2, 40)]
    assert [r[0] for r in query(df, "SELECT DISTINCT segment.PID[3] AS pid FROM q ORDER BY pid DESC", how).collect()] == ["P1", "P0"]
    with pytest.raises(BindProblem):
        query(df, "SELECT segment.PID[3] AS pid, COUNT(*) FROM q GROUP BY timestamp", how)
    with pytest.raises(BindProblem):
        query(df, "SELECT nothing FROM q", how)


def test_results_as_text(spark, root):
    e = filled(spark, root, 1)
    assert e.run("SELECT segment.PID[3] AS pid, segment.ZZZ[1] AS no FROM q").text() == "pid | no\nP000 | NULL\n\n1 row(s) returned"
    assert e.run("SELECT * FROM q WHERE segment.PID[3] = 'x'").text() == "OK (0 rows)"
    assert e.run(f"INSERT MESSAGE INTO q '{admission(2, 'P')}'").text() == "OK (1 rows affected)"
    assert e.run("nonsense").text().startswith("ERROR 1: Parse error")
    shown = e.run("SELECT * FROM q WHERE segment.PID[3] = 'P000'").table(redacted=True)
    assert "..." in shown and "1 row(s) returned (PHI REDACTED)" in shown and "P000" not in shown
    r = e.run("SELECT segment.PID[3] AS pid FROM q WHERE segment.PID[3] = 'P000'")
    assert r.value(0, 0) == "P000" and r.value(1, 0) is None and not r.has_error()
    from pipehat.functions.redact import DEFAULT

    assert e.sql("SELECT segment.PID[3] AS pid, segment.PID[1] AS one FROM q WHERE segment.PID[3] = 'P000'", DEFAULT).first() == ("[REDACTED]", "1")
