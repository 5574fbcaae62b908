import itertools

import pytest

from pipehat.plans import ast
from pipehat.plans.lang import SyntaxProblem, parse

ACCEPTED = [
    "select * from q;", "SELECT * FROM *", "SELECT * FROM ALL", "SELECT segment.PID[3] FROM q.history", "SELECT *, timestamp FROM q", "SELECT COUNT(*) AS n FROM q", "SELECT COUNT(segment.PID[3]) FROM q",
    "SELECT 'a', 1, timestamp FROM q -- note", "SELECT * FROM q\nWHERE (timestamp > 1 OR timestamp < 0) AND timestamp <> 5", "SELECT * FROM q WHERE LAST_N_DAYS(3) < timestamp", "insert message into q 'MSH|^~\\&|\rPID|1'", "CREATE QUEUE q", "DROP QUEUE q;",
    "POP MESSAGE FROM q", "CLEAR HISTORY q", "SELECT * FROM q WHERE segment.PID[3] LIKE segment.PID[4]", "SELECT * FROM q WHERE COUNT(*) > 1",
]
REJECTED = [
    "", "SELECT", "SELECT * FROM q WHERE a AND (b OR c)", "SELECT * FROM q WHERE timestamp > 1 AND (timestamp < 2 OR timestamp = 3)", "SELECT COUNT(*) FROM q GROUP BY timestamp", "SELECT * FROM q WHERE timestamp IN (1, 2)",
    "SELECT * FROM q ORDER BY timestamp", "SELECT * FROM q LIMIT 1", "SELECT * FROM q WHERE NOT timestamp = 1", "SELECT * FROM q WHERE segment.PID[3] IS NULL", "SELECT msg_id FROM q", "SELECT timestamp AS timestamp FROM q",
    "SELECT * FROM q WHERE MSH-9 = 'x'", "SELECT PID.5 FROM q", "CREATE CHANNEL q", "INSERT INTO q VALUES 'x'", "POP MESSAGE FROM q; POP MESSAGE FROM q", "SELECT * FROM q WHERE timestamp > 200.5", "SELECT * FROM q WHERE timestamp > -1",
    "INSERT MESSAGE INTO q 'O''BRIEN'", "CREATE QUEUE message", "SELECT * FROM q\r", "SELECT * FROM q WHERE 'a'", "SELECT * FROM q WHERE ((timestamp = 1)", "SELECT * FROM q;;", "SELECT 'open FROM q",
]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(text):
    parse(text)


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


@pytest.mark.parametrize(
    "text",
    ["SELECT msg_id AS timestamp FROM q WHERE NOT (a IN (1, 2) AND b IS NOT NULL) ORDER BY msg_id DESC, seq LIMIT 3", "SELECT PID-3.1 FROM q WHERE a NOT LIKE 'x'", "SELECT segment.PID[3].1.0 AS x, SUM(msg_id) FROM q GROUP BY x HAVING SUM(msg_id) > -1.5", "CREATE CHANNEL q", "INSERT MESSAGE INTO q 'O''BRIEN'", "SELECT DISTINCT msg_id FROM q"],
)
def test_extended(text):
    parse(text, extended=True)
    with pytest.raises(SyntaxProblem):
        parse(text)


def truth(c, row):
    if c.op in ("AND", "OR"):
        a, b = truth(c.left, row), truth(c.right, row)
        return a and b if c.op == "AND" else a or b
    return row[c.left.value] == c.right.value


@pytest.mark.parametrize("ops", list(itertools.product(["AND", "OR"], repeat=3)))
def test_and_or_bind_alike_to_the_left(ops):
    tree = parse(f"SELECT * FROM q WHERE 'a' = 1 {ops[0]} 'b' = 1 {ops[1]} 'c' = 1 {ops[2]} 'd' = 1").where
    for bits in itertools.product([0, 1], repeat=4):
        value = bool(bits[0])
        for op, bit in zip(ops, bits[1:], strict=True):
            value = value and bool(bit) if op == "AND" else value or bool(bit)
        assert truth(tree, dict(zip("abcd", bits, strict=True))) == value


def test_extended_binds_as_sql():
    tree = parse("SELECT * FROM q WHERE 'a' = 1 OR 'b' = 1 AND 'c' = 1", extended=True).where
    assert tree.op == "OR" and tree.right.op == "AND"


def test_trees():
    s = parse("SELECT segment.pid[3] AS x FROM Q.HISTORY WHERE timestamp BETWEEN 1 AND LAST_N_HOURS(2)")
    assert s.items == (ast.Item(ast.FieldRef("pid", 3), "x"),) and s.source == ast.Source("history", "Q")
    assert s.where == ast.Between(ast.TimestampRef(), ast.Literal(1), ast.LastN("hours", 2))
    assert parse("SELECT *, timestamp FROM q").items is None
    assert parse("SELECT 99999999999999999999 FROM q").items[0].expr.value == 2**63 - 1
