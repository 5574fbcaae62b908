import random

import pytest
from pyspark.sql import functions as F

from pipehat.functions import codec, redact
from pipehat.functions.redact import DEBUG, DEFAULT, FULL, HASH, NONE, OFF, PARTIAL, Redaction

from .samples import ADT_JONES


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "value,full,partial,hashed",
    [
        ("123456789", "[REDACTED]", "1***9***", "[PHI:35cdbb82]"), ("JONES^WILLIAM^A", "[REDACTED]", "J***A***", "[PHI:b409fd70]"), ("AB", "[REDACTED]", "[REDACTED]", None), ("John", "[REDACTED]", "J***", None),
        ("abcd  ", "[REDACTED]", "a***d***", None), ("P001", "[REDACTED]", "P***", "[PHI:7c89c066]"), ("", "[REDACTED]", "[REDACTED]", "[PHI:00001505]"), (None, None, None, None), ("      ", "[REDACTED]", " *** ***", None),
    ],
)
def test_values(spark, value, full, partial, hashed):
    assert one(spark, value, lambda v: redact.redact_value(v, FULL)) == full
    assert one(spark, value, lambda v: redact.redact_value(v, PARTIAL)) == partial
    assert one(spark, value, lambda v: redact.redact_value(v, NONE)) == value
    if hashed:
        assert one(spark, value, lambda v: redact.redact_value(v, HASH)) == hashed


def test_which_fields():
    assert all(map(redact.is_phi_field, ("PID-3", "PID-20", "NK1-5", "IN1-36", "PV1-45", "ZZZ-MRN", "XSSN-1"))) and not any(map(redact.is_phi_field, ("MSH-9", "PID-1", "OBX-5", "PID-33")))
    assert DEBUG.covers("PID-3") and not DEBUG.covers("PID-7") and not OFF.covers("PID-3") and DEFAULT.covers("PID-20")
    assert not Redaction(names=False).covers("NK1-2") and not Redaction(accounts=False).covers("IN1-36") and Redaction(ids=False).covers("PID-18")


def test_phi_predicate(spark):
    df = spark.createDataFrame([("PID-3",), ("MSH-9",), ("A-SSN",)], "f string")
    assert [r.p for r in df.select(redact.phi_predicate(F.col("f")).alias("p")).collect()] == [True, False, True]


def test_messages(spark):
    full = one(spark, ADT_JONES, redact.redact_message).split("\r")
    assert full[2] == "PID|1||[REDACTED]||[REDACTED]||[REDACTED]|M|||[REDACTED]" and full[0] == ADT_JONES.split("\r")[0] and full[4] == ""
    debug = one(spark, ADT_JONES, lambda v: redact.redact_message(v, DEBUG)).split("\r")
    assert debug[2] == "PID|1||1***R***||J***A***||19800515|M|||1***5***"
    assert one(spark, ADT_JONES, lambda v: redact.redact_message(v, OFF)) == ADT_JONES
    assert one(spark, "PID|1||X", redact.redact_message) == "PID|1||[REDACTED]"
    assert one(spark, "PID|1||X", lambda v: redact.redact_message(v, DEFAULT, True)) == "PID|1||"
    assert one(spark, "PID|1||X\r", lambda v: redact.redact_message(v, DEFAULT, True)) == "PID|1||[REDACTED]\r"
    assert one(spark, None, redact.redact_message) is None and one(spark, "", redact.redact_message) == ""


def plain_redacted(text, how):
    out = []
    for line in text.split("\r"):
        fields = line.split("|")
        own = fields[0][:3] if len(fields[0]) >= 3 else ""
        for j, f in enumerate(fields):
            if j and f and how.covers(f"{own}-{j}"):
                fields[j] = "[REDACTED]" if how.mode == FULL or len(f) <= 2 else f[0] + "***" if len(f) <= 4 else f"{f[0]}***{f[-1]}***"
        out.append("|".join(fields))
    return "\r".join(out)


def test_messages_against_a_plain_version(spark):
    rnd = random.Random(2)
    heads = ["MSH", "PID", "PIDX", "NK1", "IN1", "PV1", "MRN", "SSNX", "PI", "", "OBX", "ZMRN"]
    texts = ["\r".join("|".join([rnd.choice(heads), *rnd.choices(["", "a", "abc", "abcde", "x^y~z"], k=rnd.choice((0, 3, 15, 48)))]) for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for how in (DEFAULT, DEBUG, Redaction(names=False, ids=False), Redaction(PARTIAL, phone=False)):
        got = [r.x for r in df.select(redact.redact_message(F.col("v"), how).alias("x")).collect()]
        assert got == [plain_redacted(t, how) for t in texts]


def plain_unescaped(text):
    out, i, known = [], 0, {"r": "\r", "n": "\n", "|": "|", "\\": "\\"}
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in known:
            out.append(known[text[i + 1]])
            i += 2
        elif text[i] == "\\":
            out.append(text[i : i + 2])
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_unescaping_against_a_plain_version(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("\\\\\\rn|ab\x01\n", k=rnd.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r.x for r in df.select(codec.unescape(F.col("v")).alias("x")).collect()] == list(map(plain_unescaped, texts))


def test_frames(spark):
    df = spark.createDataFrame([(ADT_JONES, "123456789", "x")], "raw_message string, pid string, other string")
    row = redact.redact_frame(df, DEFAULT, {"pid": "PID-3", "other": "MSH-9"}).first()
    assert row.pid == "[REDACTED]" and row.other == "x" and "JONES" not in row.raw_message
    assert one(spark, "y" * 60, redact.shortened) == "y" * 47 + "..." and one(spark, "y" * 50, redact.shortened) == "y" * 50


TEXTS = ["", "a|b", "a\\r|b\rc\nd\\", "\\\\n", "\\q", "|", "\r\n", "é你\\|", ADT_JONES]


@pytest.mark.parametrize("text", TEXTS)
def test_escapes(spark, text):
    assert one(spark, text, lambda v: codec.unescape(codec.escape(v))) == text
    coded = one(spark, text, codec.escape)
    assert "\r" not in coded and "\n" not in coded
    assert one(spark, text, lambda v: codec.decode64(codec.encode64(v))) == text


def test_unknown_escapes_stay(spark):
    assert one(spark, "a\\qb\\", codec.unescape) == "a\\qb\\"
    assert one(spark, "not base64!", codec.decode64) is None


def test_lines(spark):
    rows = spark.createDataFrame([(i, 100 + i, t) for i, t in enumerate(TEXTS)], "msg_id long, timestamp long, raw_message string")
    key, wrong = F.lit(b"0123456789abcdef"), F.lit(b"0123456789abcdeX")
    assert codec.from_lines(codec.to_lines(rows)).exceptAll(rows).count() == 0 and codec.from_lines(codec.to_lines(rows)).count() == len(TEXTS)
    coded = codec.to_lines(rows, key)
    assert coded.where("value LIKE 'ENC|%'").count() == len(TEXTS)
    assert sorted(map(str, codec.from_lines(coded, key).collect())) == sorted(map(str, rows.collect()))
    assert codec.from_lines(coded, wrong).count() == 0 and codec.from_lines(coded).count() == 0
    moved = coded.selectExpr("replace(value, 'ENC|1|', 'ENC|9|') AS value")
    assert codec.from_lines(moved, key).count() == len(TEXTS) - 1  # the id is part of what is sealed
    odd = spark.createDataFrame([("7|8|x\\|y",), ("PLN|a|b|c",), ("",), ("PLN|1",), ("ENC|1|2|zz",), ("PLN|1|2|",)], "value string")
    assert [tuple(r) for r in codec.from_lines(odd, key).collect()] == [(7, 8, "x|y"), (1, 2, "")]
