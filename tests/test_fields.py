import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pipehat.functions import hl7

from .samples import ADT_JONES, EDGE, ORU_CBC


def values(spark, text, paths, numbering="as_coded", raw=False):
    df = spark.createDataFrame([(text,)], "raw_message string")
    if not raw:
        df = hl7.parse(df, numbering=numbering)
    read = (lambda p: hl7.read_raw(F.col("raw_message"), p, numbering)) if raw else (lambda p: hl7.read_path(F.col("segments"), F.col("enc"), p, numbering))
    return list(df.select(*(read(p).alias(f"c{i}") for i, p in enumerate(paths))).first())


CASES = [
    (ADT_JONES, "as_coded", {"MSH-1": "", "MSH-2": "SENDING_APP", "MSH-3": "SENDING_FAC", "MSH-6": "20230615083000", "MSH-7": "", "MSH-8": "ADT", "MSH-9": "MSG00001", "MSH-10": "P", "MSH-11": "2.5", "MSH-12": None}),
    (ADT_JONES, "as_coded", {"PID-3": "123456789", "PID-5": "JONES", "PID-7": "19800515", "PID-11": "123 MAIN ST", "PID-12": None, "PV1-3": "2000", "PV1-7": "004777", "PV1-10": "SUR", "PV1-14": "ADM", "PV1-15": "A0", "PV1-19": None}),
    (ADT_JONES, "as_coded", {"PID-3.3": "FACILITY", "PID-5.1": "WILLIAM", "PID-5.9": None, "PID-3.3.0": None, "NTE-1": None, "PID-99": None}),
    (ADT_JONES, "standard", {"MSH-1": "|", "MSH-2": "^~\\&", "MSH-3": "SENDING_APP", "MSH-7": "20230615083000", "MSH-9": "ADT", "MSH-10": "MSG00001", "MSH-11": "P", "MSH-12": "2.5", "PID-3": "123456789"}),
    (ORU_CBC, "as_coded", {"OBX-3": "WBC", "OBX-5": "7.5", "OBX-6": "10", "OBX-6.1": "9/L", "OBR-4": "CBC"}),
    (EDGE, "as_coded", {"ZZZ-1": None, "ZZZ-1.0": "A", "ZZZ-1.0.1": "B", "ZZZ-1.1": "C", "ZZZ-2": "X", "ZZZ-3": "p", "ZZZ-3.1.1": "r", "ZZZ-4": "", "ZZZ-5": None, "PID-1": None, "MSH-4": None}),
    (EDGE.replace("|", "#").replace("^", "@"), "as_coded", {"ZZZ-1.1": "C", "ZZZ-2": "X", "ZZZ-4": "", "MSH-2": "A"}),
    ("bogus", "as_coded", {"PID-3": None, "MSH-1": None}),
    (None, "as_coded", {"PID-3": None, "MSH-1": None}),
    ("", "as_coded", {"MSH-1": None}),
]


@pytest.mark.parametrize("raw", [False, True])
@pytest.mark.parametrize("text,numbering,expected", CASES)
def test_paths(spark, text, numbering, expected, raw):
    assert dict(zip(expected, values(spark, text, expected, numbering, raw), strict=True)) == expected


@pytest.mark.parametrize("raw", [False, True])
def test_repetitions_and_occurrences(spark, raw):
    P = hl7.FieldPath
    paths = [P("ZZZ", 2, repetition=0), P("ZZZ", 2, repetition=1), P("ZZZ", 2, repetition=2), P("ZZZ", 3, repetition=5)]
    assert values(spark, EDGE, paths, raw=raw) == ["X", "Y", None, "p"]
    assert values(spark, ORU_CBC, [P("OBX", 3, occurrence=n) for n in range(4)], raw=raw) == ["WBC", "RBC", "HGB", None]


def test_envelope(spark):
    df = spark.createDataFrame([(1, ADT_JONES), (2, EDGE), (3, "bogus"), (4, "MSH|^~\\&|x\rAB\rPID|1"), (5, None), (6, "")], "id int, raw_message string")
    rows = {r.id: r for r in hl7.parse(df).withColumn("code", hl7.validate(F.col("segments"), F.col("parse_errors"))).collect()}
    assert [len(s.fields) for s in rows[1].segments] == [11, 2, 11, 15]
    assert (rows[1].msg_type, rows[1].msg_type_code, rows[1].version, rows[1].msh7_ts, rows[1].pid3) == ("MSG00001", "UNKNOWN", "unknown", None, "123456789")
    assert [s.id for s in rows[2].segments] == ["MSH", "ZZZ"]
    assert (rows[3].parse_errors, rows[3].num_segments, rows[3].error_message, rows[3].code) == (1, 0, hl7.NO_MSH, -2)
    assert (rows[4].parse_errors, rows[4].num_segments, rows[4].code) == (1, 2, -5)
    assert rows[5].parse_errors is None and rows[5].num_segments == 0
    assert rows[6].parse_errors == 1
    standard = hl7.parse(df.where("id = 1"), numbering="standard").first()
    assert (standard.msg_type, standard.msg_type_code, standard.version, standard.msh7_ts, standard.msh10) == ("ADT", "ADT", "2.5", 1686817800, "MSG00001")


def test_newlines(spark):
    df = spark.createDataFrame([(ADT_JONES.replace("\r", "\r\n"),)], "raw_message string")
    assert hl7.parse(df).first().num_segments == 1
    assert hl7.parse(df, normalize_newlines=True).first().num_segments == 4


def test_segments_have_occurrence_numbers(spark):
    df = hl7.parse(spark.createDataFrame([(ORU_CBC,)], "raw_message string"))
    assert [(s.id, s.idx) for s in df.first().segments] == [("MSH", 0), ("PID", 0), ("OBR", 0), ("OBX", 0), ("OBX", 1), ("OBX", 2)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_epoch(spark, zone):
    cases = {"20230615083000": 1686817800, "20230615": 1686787200, "2023061508": 1686816000, "2023061508300": 1686817800, "20230615083000.25-0500": 1686817800, "junk": None, "2023": None, "20231340": None, "": None}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in cases], "v string")
        assert [r.e for r in df.select(hl7.epoch(F.col("v")).alias("e")).collect()] == list(cases.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("text", ["PID", "PID-", "PID-0", "LONG-1", "PID.3"])
def test_bad_paths(text):
    with pytest.raises(ValueError):
        hl7.FieldPath.parse(text)


def test_index_names():
    assert hl7.index_name("PID", 3) == "pid3" and hl7.index_name("PV1", 19) == "pv119" and hl7.index_name("PID", 4) is None
    assert str(hl7.FieldPath.parse("PID-3.1.0")) == "PID-3.1.0"


field_text = st.text(alphabet="ab ^~&\\1", max_size=6)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["PID", "OBX", "ZZZ"]), st.lists(field_text, max_size=4)), max_size=4))
def test_rebuild_is_the_inverse_of_parse(spark, segments):
    text = "\r".join(["MSH|^~\\&|A", *("|".join([s, *fields]) for s, fields in segments)])
    row = hl7.parse(spark.createDataFrame([(text,)], "raw_message string")).select(hl7.rebuild(F.col("segments"), F.col("enc.field")).alias("t")).first()
    assert row.t == text
