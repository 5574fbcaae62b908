"""A query for each operator, over messages made from the `events` table, and the same in SQL over that table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipehat.functions import codec, hl7, redact
from pipehat.operators import audit, monitor, queues
from pipehat.operators.engine import Engine, query
from pipehat.plans.bind import Semantics
from pipehat.runtime import scratch, table, written
from pipehat.sources import readers

#: 2024-01-31T00:00:00Z, the time that queries count back from.
NOW = 1706659200
KINDS = ("click", "error", "purchase", "signup", "view")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"
PID, KIND, VALUE = "CAST(user_id AS VARCHAR)", "event_type", "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)"
#: The text of raw_messages().
RAW = f"""('MSH|^~\\&|APP|FAC|R|RF|' || strftime(ts, '%Y%m%d%H%M%S') || '||ORU^' || event_type || '|' || event_id || '|P|2.5' || chr(13) || 'PID|1||' || user_id || '^^^FAC&ISO^MR~ALT' || event_id || '||DOE^' || event_type
  || chr(13) || 'OBX|1|NM|' || event_type || '||' || {VALUE} || chr(13) || 'OBX|2|ST|SRC||s' || (user_id % 10))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with epoch seconds and the value's text."""
    return table(spark, sf_dir, "events").withColumns({"epoch": hl7.seconds(F.col("ts").cast("timestamp_ntz")), "shown": F.col("value").cast("decimal(18,2)").cast("string")})


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, timestamp, raw_message, kind): a message with MSH, PID and two OBX for each event."""
    e = events(spark, sf_dir)
    msh = hl7.build_segment("MSH", r"^~\&", "APP", "FAC", "R", "RF", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMddHHmmss"), "", F.concat(F.lit("ORU^"), "event_type"), F.col("event_id").cast("string"), "P", "2.5")
    pid = hl7.build_segment("PID", "1", "", F.concat(F.col("user_id").cast("string"), F.lit("^^^FAC&ISO^MR~ALT"), F.col("event_id").cast("string")), "", F.concat(F.lit("DOE^"), "event_type"))
    obx1 = hl7.build_segment("OBX", "1", "NM", F.col("event_type"), "", F.col("shown"))
    obx2 = hl7.build_segment("OBX", "2", "ST", "SRC", "", F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")))
    row = F.struct(F.col("event_id").alias("msg_id"), F.col("epoch").alias("timestamp"), hl7.build_message(msh, pid, obx1, obx2).alias("raw_message"), F.col("event_type").alias("kind"))
    # texts are made here once, as if they were stored: else conditions on them would carry the making down to the scan
    return e.select(F.inline(F.array(row)))


def messages(spark: SparkSession, sf_dir: str, numbering: str = "as_coded") -> DataFrame:
    return hl7.parse(raw_messages(spark, sf_dir).drop("kind"), numbering=numbering)


def register(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def statement(name: str, text: str, sql: str, extended: bool = False) -> None:
    """A query that is one statement over the messages' text."""
    how = Semantics(now=NOW, extended=extended)
    register(name, sql)(lambda spark, sf_dir: query(raw_messages(spark, sf_dir), text, how))


# -- scans and projections ----------------------------------------------------------------------------------------------
statement("scan_all", "SELECT segment.MSH[9] AS control, segment.PID[3] AS pid, timestamp FROM q", f"SELECT CAST(event_id AS VARCHAR) AS control, {PID} AS pid, {EPOCH} AS timestamp FROM events")
statement("project_fields", "SELECT segment.PID[3] AS pid, segment.OBX[3] AS kind, segment.OBX[5] AS val FROM ALL", f"SELECT {PID} AS pid, {KIND} AS kind, {VALUE} AS val FROM events")
statement("project_literals", "SELECT 'x' AS word, 42 AS num, LAST_N_HOURS(1) AS since, segment.ZZZ[1] AS nothing, segment.MSH[7] AS hollow FROM *", f"SELECT 'x' AS word, CAST(42 AS INTEGER) AS num, CAST({NOW - 3600} AS BIGINT) AS since, CAST(NULL AS VARCHAR) AS nothing, '' AS hollow FROM events")


@register(
    "select_wildcard",
    f"SELECT event_id AS msg_id, CAST(event_id AS VARCHAR) AS msg_type, {EPOCH} AS timestamp, md5({RAW}) AS raw_hash FROM events",
)
def select_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = query(messages(spark, sf_dir), "SELECT * FROM q", Semantics(now=NOW))
    return out.withColumn("raw_hash", F.md5("raw_message")).drop("raw_message")


# -- predicates ---------------------------------------------------------------------------------------------------------
ROWS = "SELECT segment.MSH[9] AS control FROM q WHERE "
ORACLE_ROWS = "SELECT CAST(event_id AS VARCHAR) AS control FROM events WHERE "
for _name, _text, _sql in (
    ("filter_eq", "segment.OBX[3] = 'click'", "event_type = 'click'"),
    ("filter_ne", "segment.OBX[3] <> 'click'", "event_type <> 'click'"),
    ("filter_lt", "segment.PID[3] < 100", "user_id < 100"),
    ("filter_le", "segment.OBX[3] <= 'error'", "event_type <= 'error'"),
    ("filter_gt", "timestamp > 1704800000", f"{EPOCH} > 1704800000"),
    ("filter_ge", "segment.MSH[9] >= 5000", "event_id >= 5000"),
    ("filter_like", "segment.OBX[3] LIKE '%i%u%' ", "event_type LIKE '%i%u%'"),
    ("filter_between", "timestamp BETWEEN 1704300000 AND 1704900000", f"{EPOCH} BETWEEN 1704300000 AND 1704900000"),
    ("filter_between_reversed", "timestamp BETWEEN 1704900000 AND 1704300000", "false"),
    ("filter_and_or_flat", "segment.OBX[3] = 'click' OR segment.OBX[3] = 'view' AND segment.PID[3] = '7'", "(event_type = 'click' OR event_type = 'view') AND user_id = 7"),
    ("filter_paren", "(segment.PID[3] = '7' OR segment.PID[3] = '8') AND segment.OBX[3] = 'click'", "(user_id = 7 OR user_id = 8) AND event_type = 'click'"),
    ("filter_fields", "segment.PID[3] < segment.MSH[9]", f"{PID} < CAST(event_id AS VARCHAR)"),
    ("filter_missing", "segment.ZZZ[1] = 'x' OR segment.PID[3] = '9'", "user_id = 9"),
    ("last_n_hours", "timestamp > LAST_N_HOURS(12)", f"{EPOCH} > {NOW - 12 * 3600}"),
    ("last_n_days", "timestamp > LAST_N_DAYS(25) AND segment.OBX[3] = 'error'", f"{EPOCH} > {NOW - 25 * 86400} AND event_type = 'error'"),
    ("last_n_between", "timestamp BETWEEN LAST_N_DAYS(28) AND LAST_N_DAYS(2)", f"{EPOCH} BETWEEN {NOW - 28 * 86400} AND {NOW - 2 * 86400}"),
):
    statement(_name, ROWS + _text, ORACLE_ROWS + _sql)
for _name, _text, _sql in (
    ("extended_not_in", "NOT segment.OBX[3] IN ('click', 'view') AND (segment.PID[3] = '7' OR segment.PID[3] = '8')", "event_type NOT IN ('click', 'view') AND (user_id = 7 OR user_id = 8)"),
    ("extended_is_null", "segment.ZZZ[1] IS NULL AND segment.MSH[7] IS NOT NULL AND segment.PID[3].4 = 'MR' AND PID-3.3.1 = 'ISO' AND msg_id < 50", "event_id < 50"),
):
    statement(_name, ROWS + _text, ORACLE_ROWS + _sql, extended=True)

# -- aggregates ---------------------------------------------------------------------------------------------------------
statement("count_star", "SELECT COUNT(*) AS n FROM q WHERE segment.OBX[3] = 'view'", "SELECT count(*) AS n FROM events WHERE event_type = 'view'")
statement("count_expr", "SELECT COUNT(segment.ZZZ[1]) AS none, COUNT(segment.PID[3]) AS every FROM q", "SELECT CAST(0 AS BIGINT) AS none, count(user_id) AS every FROM events")
statement("group_by_type", "SELECT segment.OBX[3] AS kind, COUNT(*) AS n FROM q GROUP BY segment.OBX[3]", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type", extended=True)
statement(
    "group_having_order",
    "SELECT segment.PID[3] AS pid, COUNT(*) AS n, MAX(timestamp) AS latest FROM q GROUP BY pid HAVING COUNT(*) > 1 ORDER BY n DESC, pid LIMIT 20",
    f"SELECT {PID} AS pid, count(*) AS n, max({EPOCH}) AS latest FROM events GROUP BY pid HAVING count(*) > 1 ORDER BY n DESC, pid LIMIT 20",
    extended=True,
)
statement("order_limit", "SELECT segment.MSH[9] AS control, timestamp FROM q ORDER BY timestamp DESC, msg_id LIMIT 25", f"SELECT CAST(event_id AS VARCHAR) AS control, {EPOCH} AS timestamp FROM events ORDER BY timestamp DESC, event_id LIMIT 25", extended=True)
statement("select_distinct", "SELECT DISTINCT segment.OBX[3] AS kind FROM q", "SELECT DISTINCT event_type AS kind FROM events", extended=True)


# -- fields -------------------------------------------------------------------------------------------------------------
@register(
    "field_paths",
    f"""SELECT event_id AS msg_id, {PID} AS whole, 'MR' AS component, 'FAC' AS first_sub, 'ISO' AS second_sub, CAST(NULL AS VARCHAR) AS no_sub, 'ALT' || event_id AS repetition, CAST(NULL AS VARCHAR) AS no_repetition,
  {KIND} AS unrepeated, 'SRC' AS second_segment FROM events""",
)
def field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, P = messages(spark, sf_dir), hl7.FieldPath
    paths = {
        "whole": P("PID", 3), "component": P("PID", 3, 4), "first_sub": P("PID", 3, 3), "second_sub": P("PID", 3, 3, 1), "no_sub": P("PID", 3, 4, 0), "repetition": P("PID", 3, repetition=1), "no_repetition": P("PID", 3, repetition=2),
        "unrepeated": P("PID", 5, 1, repetition=3), "second_segment": P("OBX", 3, occurrence=1),
    }
    return m.select("msg_id", *(hl7.read_path(F.col("segments"), F.col("enc"), p).alias(k) for k, p in paths.items()))


@register("all_segments_explode", f"SELECT event_id AS msg_id, 0 AS idx, {KIND} AS code, {VALUE} AS val FROM events UNION ALL SELECT event_id, 1, 'SRC', 's' || (user_id % 10) FROM events")
def all_segments_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("msg_id", F.inline(hl7.all_segments(F.col("segments"), "OBX")))
    return rows.select("msg_id", "idx", hl7.raw_field(F.col("fields"), 3).alias("code"), hl7.raw_field(F.col("fields"), 5).alias("val"))


@register("dtm_epoch", f"SELECT event_id AS msg_id, {EPOCH} AS at, CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS day, CAST(NULL AS BIGINT) AS junk FROM events")
def dtm_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir, "standard")
    at = hl7.read_path(F.col("segments"), F.col("enc"), "MSH-7", "standard")
    return m.select("msg_id", F.col("msh7_ts").alias("at"), hl7.epoch(F.substring(at, 1, 9)).alias("day"), hl7.epoch(F.concat(F.lit("x"), at)).alias("junk"))


@register("types_and_validation", f"SELECT event_id AS msg_id, CASE WHEN event_id % 3 = 0 THEN 'UNKNOWN' ELSE 'ORU' END AS type_code, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE '2.5' END AS version, CASE WHEN event_id % 3 = 0 THEN -2 WHEN event_id % 3 = 1 THEN -5 ELSE 0 END AS code, CASE WHEN event_id % 3 = 0 THEN 'Message missing MSH segment' WHEN event_id % 3 = 1 THEN 'Message has parse errors' ELSE 'Message is valid' END AS told FROM events")
def types_and_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text begins with other letters, every third has a segment that is too short."""
    text, k = F.col("raw_message"), F.col("msg_id") % 3
    raw = raw_messages(spark, sf_dir).withColumn("raw_message", F.when(k == 0, F.concat(F.lit("X"), text)).when(k == 1, F.concat(text, F.lit("\rAB"))).otherwise(text))
    m = hl7.parse(raw, numbering="standard")
    code = hl7.validate(F.col("segments"), F.col("parse_errors"))
    return m.select("msg_id", F.col("msg_type_code").alias("type_code"), "version", code.alias("code"), hl7.validation_text(code).alias("told"))


@register("msh_standard_numbering", "SELECT event_id AS msg_id, '|' AS f1, '^~\\&' AS f2, 'APP' AS f3, 'ORU' AS f9, CAST(event_id AS VARCHAR) AS f10, '2.5' AS f12 FROM events")
def msh_standard_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir, "standard")
    return m.select("msg_id", *(hl7.read_path(F.col("segments"), F.col("enc"), f"MSH-{n}", "standard").alias(f"f{n}") for n in (1, 2, 3, 9, 10, 12)))


@register("rebuild_roundtrip", "SELECT event_id AS msg_id, true AS same, CAST(4 AS INTEGER) AS num_segments FROM events")
def rebuild_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.select("msg_id", (hl7.rebuild(F.col("segments"), F.col("enc.field")) == F.col("raw_message")).alias("same"), "num_segments")


# -- redaction ----------------------------------------------------------------------------------------------------------
@register("redact_full", f"SELECT event_id AS msg_id, '[REDACTED]' AS pid, 'DOE' AS name_shown, {KIND} AS obx FROM events")
def redact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = raw_messages(spark, sf_dir)
    read = lambda p: hl7.read_raw(F.col("raw_message"), p)
    return m.select("msg_id", redact.redact_field("PID-3", read("PID-3")).alias("pid"), redact.redact_field("PID-5", read("PID-5"), redact.OFF).alias("name_shown"), redact.redact_field("OBX-3", read("OBX-3")).alias("obx"))


@register("redact_partial", f"SELECT event_id AS msg_id, CASE WHEN length({PID}) <= 2 THEN '[REDACTED]' WHEN length({PID}) <= 4 THEN left({PID}, 1) || '***' ELSE left({PID}, 1) || '***' || right({PID}, 1) || '***' END AS pid, left(event_type, 1) || CASE WHEN length(event_type) <= 4 THEN '***' ELSE '***' || right(event_type, 1) || '***' END AS kind FROM events")
def redact_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = raw_messages(spark, sf_dir)
    read = lambda p: hl7.read_raw(F.col("raw_message"), p)
    return m.select("msg_id", redact.redact_field("PID-3", read("PID-3"), redact.DEBUG).alias("pid"), redact.redact_value(read("OBX-3"), redact.PARTIAL).alias("kind"))


@register("redact_hash", "SELECT event_id AS msg_id, '[PHI:' || printf('%08x', list_reduce(list_prepend(CAST(5381 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(event_type, '')]), lambda h, c: (h * 33 + c) & 4294967295)) || ']' AS kind FROM events")
def redact_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_messages(spark, sf_dir).select("msg_id", redact.redact_value(hl7.read_raw(F.col("raw_message"), "OBX-3"), redact.HASH).alias("kind"))


@register("redact_message", f"SELECT event_id AS msg_id, 'PID|1||[REDACTED]||[REDACTED]' AS pid_segment, 'OBX|1|NM|' || event_type || '||' || {VALUE} AS obx_segment FROM events")
def redact_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_messages(spark, sf_dir).select("msg_id", F.split(redact.redact_message(F.col("raw_message")), "\r").alias("lines"))
    return lines.select("msg_id", F.get("lines", F.lit(1)).alias("pid_segment"), F.get("lines", F.lit(2)).alias("obx_segment"))


@register("redact_exploded", f"SELECT event_id AS msg_id, 'PID' AS segment, CAST(3 AS INTEGER) AS field, '[REDACTED]' AS value FROM events UNION ALL SELECT event_id, 'PID', 5, '[REDACTED]' FROM events UNION ALL SELECT event_id, 'PID', 1, '1' FROM events UNION ALL SELECT event_id, 'PID', 2, '' FROM events UNION ALL SELECT event_id, 'PID', 4, '' FROM events")
def redact_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hl7.exploded(messages(spark, sf_dir)).where("segment = 'PID'")
    return redact.redact_exploded(rows).select("msg_id", "segment", "field", "value")


# -- codecs -------------------------------------------------------------------------------------------------------------
@register("codec_roundtrip", f"SELECT event_id AS msg_id, {EPOCH} AS timestamp, 'PLN|' || event_id || '|' || {EPOCH} || '|MSH\\|' AS head, {PID} AS pid FROM events")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = codec.to_lines(raw_messages(spark, sf_dir))
    back = hl7.parse(codec.from_lines(lines))
    head = F.concat(F.lit("PLN|"), F.col("msg_id"), F.lit("|"), F.col("timestamp"), F.lit("|"), F.substring(codec.escape(F.col("raw_message")), 1, 5))
    return back.select("msg_id", "timestamp", head.alias("head"), F.col("pid3").alias("pid"))


@register("base64_roundtrip", "SELECT event_id AS msg_id, base64(CAST(event_type AS BLOB)) AS coded, event_type AS plain FROM events")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codec.encode64(F.col("event_type"))
    return events(spark, sf_dir).select(F.col("event_id").alias("msg_id"), coded.alias("coded"), codec.decode64(coded).alias("plain"))


@register("aes_roundtrip", f"SELECT event_id AS msg_id, {PID} AS pid, CAST(NULL AS VARCHAR) AS wrong_key, CAST(NULL AS VARCHAR) AS wrong_id FROM events")
def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, other = F.lit(b"a key of 16 byte"), F.lit(b"A KEY OF 16 BYTE")
    # the vector is made of the id here, so that the query's plan stays deterministic; encrypt() draws one by itself
    iv = F.unhex(F.lpad(F.hex("msg_id"), 24, "0"))
    coded = raw_messages(spark, sf_dir).withColumn("coded", codec.encrypt(F.col("raw_message"), key, F.col("msg_id"), iv))
    plain = coded.withColumn("raw_message", codec.decrypt(F.col("coded"), key, F.col("msg_id")))
    return hl7.parse(plain).select("msg_id", F.col("pid3").alias("pid"), codec.decrypt(F.col("coded"), other, F.col("msg_id")).alias("wrong_key"), codec.decrypt(F.col("coded"), key, F.col("msg_id") + 1).alias("wrong_id"))


# -- queues -------------------------------------------------------------------------------------------------------------
def engine(spark: SparkSession, sf_dir: str, split: bool = False, **how) -> Engine:
    """An engine whose queue events holds all messages in order, or one queue for each kind."""
    out = Engine(spark, scratch(spark, "queues"), clock=lambda: NOW, **how)
    raw = raw_messages(spark, sf_dir)
    for name in KINDS if split else ("events",):
        out.sql(f"CREATE QUEUE {name}")
    if split:
        out.store.insert_dealt(raw, "kind", ["msg_id"])
    else:
        out.insert_frame("events", raw, ["msg_id"])
    return out


@register("union_all_queues", f"SELECT {PID} AS pid, {KIND} AS kind FROM events")
def union_all_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, split=True).sql("SELECT segment.PID[3] AS pid, segment.OBX[3] AS kind FROM *")


@register("fifo_position", "SELECT event_id AS event, row_number() OVER (ORDER BY event_id) AS position, row_number() OVER (ORDER BY event_id) + 5 AS msg_id FROM (SELECT event_id FROM events ORDER BY event_id OFFSET 5)")
def fifo_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After five messages have gone."""
    store = engine(spark, sf_dir).store
    store.pop("events", 5)
    return store.positions("events").select(F.col("msh9").cast("bigint").alias("event"), "position", "msg_id")


@register("pop_k", "SELECT CAST(event_id AS VARCHAR) AS control FROM events ORDER BY event_id LIMIT 7")
def pop_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).store.pop("events", 7).select(F.col("msh9").alias("control"))


@register("history_scan", "SELECT CAST(event_id AS VARCHAR) AS control, 'history' AS place FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 3) UNION ALL SELECT CAST(event_id AS VARCHAR), 'active' FROM (SELECT event_id FROM events ORDER BY event_id OFFSET 3)")
def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.sql("POP MESSAGE FROM events")
    e.store.pop("events", 2)
    past = e.sql("SELECT segment.MSH[9] AS control, 'history' AS place FROM events.history")
    return past.unionAll(e.sql("SELECT segment.MSH[9] AS control, 'active' AS place FROM events"))


@register("history_rotate", "SELECT CAST(event_id AS VARCHAR) AS control FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 5 OFFSET 5)")
def history_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, history_limit=5, rotate=True)
    e.store.pop("events", 10)
    return e.sql("SELECT segment.MSH[9] AS control FROM events.history")


@register("history_full", "SELECT CAST(5 AS BIGINT) AS history, count(*) - 5 AS messages FROM events")
def history_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, history_limit=5)
    e.store.pop("events", 10)
    return e.store.statistics().select("history", "messages")


@register("clear_history", "SELECT CAST(0 AS BIGINT) AS history, count(*) - 4 AS messages FROM events")
def clear_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.store.pop("events", 4)
    e.sql("CLEAR HISTORY events")
    return e.store.statistics().select("history", "messages")


@register("queue_stats", "SELECT event_type AS queue, count(*) AS messages, CAST(0 AS BIGINT) AS history, count(*) AS total FROM events GROUP BY event_type")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, split=True).store.statistics()


@register("index_eq", "SELECT CAST(event_id AS VARCHAR) AS control FROM events WHERE user_id = 13")
def index_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT segment.MSH[9] AS control FROM events WHERE segment.PID[3] = '13'")


@register("index_range", f"SELECT event_id AS event, {EPOCH} AS at FROM events WHERE {EPOCH} BETWEEN 1704300000 AND 1704900000")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = engine(spark, sf_dir, numbering="standard").store.active("events")
    return queues.by_time(stored, 1704300000, 1704900000).select(F.col("msh10").cast("bigint").alias("event"), F.col("msh7_ts").alias("at"))


@register("point_get", "SELECT CAST(event_id AS VARCHAR) AS control FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n = 17")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).store.get("events", 17).select(F.col("msh9").alias("control"))


@register("processed_and_not", "SELECT CAST(event_id AS VARCHAR) AS control, user_id IN (SELECT user_id FROM events ORDER BY event_id LIMIT 50) AS seen FROM (SELECT * FROM events ORDER BY event_id OFFSET 50)")
def processed_and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.store.pop("events", 50)
    active, past = e.store.active("events"), e.store.history("events")
    yes = queues.processed(active, past, "pid3").select(F.col("msh9").alias("control"), F.lit(True).alias("seen"))
    return yes.unionAll(queues.unprocessed(active, past, "pid3").select(F.col("msh9").alias("control"), F.lit(False).alias("seen")))


@register("persisted_export", f"SELECT {PID} AS pid, count(*) AS n FROM events GROUP BY ALL")
def persisted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues written as persisted lines and read again."""
    e, root = engine(spark, sf_dir, split=True), scratch(spark, "export")
    names = readers.export_persisted(e.store, root)
    rows = None
    for name in names:
        part = readers.read_persisted(spark, readers.persisted_path(root, name), parse=False)
        rows = part if rows is None else rows.unionAll(part)
    return rows.groupBy(hl7.read_raw(F.col("raw_message"), "PID-3").alias("pid")).agg(F.count(F.lit(1)).alias("n"))


# -- audit and monitoring -----------------------------------------------------------------------------------------------
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit rows: errors fail, views and purchases touch protected data."""
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    values = {
        "event_id": F.col("event_id"), "timestamp": F.col("epoch"), "event_type": kind, "severity": F.when(kind == "error", 3).when(kind == "purchase", 2).otherwise(1), "user_id": F.col("user_id"),
        "username": F.concat(F.lit("u"), F.col("user_id").cast("string")), "client_ip": F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")), "resource": F.concat(F.lit("q"), (F.col("user_id") % 5).cast("string")),
        "success": kind != "error", "phi_accessed": kind.isin("view", "purchase"), "phi_record_count": F.when(kind.isin("view", "purchase"), F.col("event_id") % 7 + 1).otherwise(0),
    }
    return e.select(*(values.get(k, F.lit(None)).cast(t).alias(k) for k, t in audit.FIELDS.items()))


@register("audit_filter", f"SELECT event_id FROM events WHERE {EPOCH} BETWEEN 1704200000 AND 1705200000 AND event_type IN ('view', 'purchase') AND user_id % 5 = 2 AND CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'purchase' THEN 2 ELSE 1 END >= 2 ORDER BY event_id LIMIT 40")
def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = audit.AuditFilter(start=1704200000, end=1705200000, min_severity=2, phi_only=True, resource="q2", success=True, max_results=40)
    return audit.matching(audit_rows(spark, sf_dir), f).select("event_id")


@register("audit_stats", "SELECT count(*) AS total_events, count(*) FILTER (event_type IN ('view', 'purchase')) AS phi_accesses, count(*) FILTER (event_type = 'error') AS failures, count(DISTINCT user_id) AS unique_users FROM events")
def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.statistics(audit_rows(spark, sf_dir))


CHAIN_FIELDS = ["event_id", "event_type", "user_id"]


GAPS = "event_id % 7 NOT IN (3, 4)"


def chain_sql(rows: str) -> str:
    """SQL whose c0 holds (id, before, sum) of the hash chain over rows (id, h), for ids below 64 ** 3."""
    out = f"WITH RECURSIVE s0 AS ({rows})"
    for k in (1, 2):
        out += f", s{k} AS (SELECT id // 64 AS id, sha256(string_agg(h, '' ORDER BY id)) AS h FROM s{k - 1} GROUP BY id // 64)"
    out += ", c3 AS (SELECT 0 AS id, '' AS before)"
    for k in (2, 1, 0):
        out += f""", n{k} AS (SELECT id, h, id // 64 AS block, row_number() OVER (PARTITION BY id // 64 ORDER BY id) AS n FROM s{k}),
c{k} AS (SELECT a.id, a.block, a.n, u.before, sha256(u.before || '|' || a.h) AS sum FROM n{k} a JOIN c{k + 1} u ON u.id = a.block WHERE a.n = 1
  UNION ALL SELECT b.id, b.block, b.n, c.sum, sha256(c.sum || '|' || b.h) FROM c{k} c JOIN n{k} b ON b.block = c.block AND b.n = c.n + 1)"""
    return out


OWN = "sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}')"


def chain_rows(where: str) -> str:
    return chain_sql(f"SELECT event_id AS id, {OWN} AS h FROM events WHERE {where}") + " SELECT id AS event_id, lag(id) OVER (ORDER BY id) AS previous_event_id, sum AS checksum FROM c0"


@register("audit_chain", chain_rows("true"))
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chained(audit_rows(spark, sf_dir), CHAIN_FIELDS).select("event_id", "previous_event_id", "checksum")


@register("audit_chain_gaps", chain_rows(GAPS))
def audit_chain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of seven ids are missing."""
    return audit.chained(audit_rows(spark, sf_dir).where(GAPS), CHAIN_FIELDS).select("event_id", "previous_event_id", "checksum")


def kept_log(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """A chained log, as it is kept."""
    return written(audit.chained(audit_rows(spark, sf_dir).where(where), CHAIN_FIELDS), "audit")


@register("audit_chain_verify", "SELECT event_id, 'changed' AS problem FROM events WHERE event_id % 1000 = 500")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thousandth row is tampered with after chaining."""
    log = kept_log(spark, sf_dir)
    return audit.broken(log.withColumn("user_id", F.when(F.col("event_id") % 1000 == 500, F.col("user_id") + 1).otherwise(F.col("user_id"))), CHAIN_FIELDS)


@register("audit_chain_gaps_verify", f"SELECT event_id, 'changed' AS problem FROM events WHERE event_id = 505 AND {GAPS} UNION ALL SELECT event_id, 'untouched' FROM events WHERE false")
def audit_chain_gaps_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with gaps: untouched it reports nothing, and one changed row shows."""
    log = kept_log(spark, sf_dir, GAPS)
    one = log.withColumn("event_type", F.when(F.col("event_id") == 505, "x").otherwise(F.col("event_type")))
    return audit.broken(one, CHAIN_FIELDS).unionAll(audit.broken(log, CHAIN_FIELDS).select("event_id", F.lit("untouched").alias("problem")))


@register("audit_chain_forged", f"SELECT event_id, 'link' AS problem FROM events WHERE event_id >= 505 AND {GAPS}")
def audit_chain_forged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row's fields and hash are changed together: all later checksums betray it."""
    log = kept_log(spark, sf_dir, GAPS).withColumn("event_type", F.when(F.col("event_id") == 505, "x").otherwise(F.col("event_type")))
    return audit.broken(log.withColumn("payload_hash", audit.payload_hash(CHAIN_FIELDS)), CHAIN_FIELDS)


@register("anomaly_hours", f"SELECT event_id, {EPOCH} AS timestamp FROM events WHERE event_type IN ('view', 'purchase') AND (hour(ts) < 8 OR hour(ts) >= 18)")
def anomaly_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit_rows(spark, sf_dir).withColumn("user_id", F.col("event_id"))  # the event's id stands for the user's, to tell the rows apart
    return monitor.after_hours(rows).select(F.col("user_id").alias("event_id"), "timestamp")


@register("anomaly_volume", f"WITH d AS (SELECT user_id, CAST(floor({EPOCH} / 86400) AS BIGINT) AS day, sum(event_id % 7 + 1) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL) SELECT user_id, CAST((day + 1) * 86400 AS BIGINT) AS timestamp, CAST(n AS BIGINT) AS records FROM (SELECT *, avg(n) OVER (PARTITION BY user_id) AS usual FROM d) WHERE n > usual * 2")
def anomaly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitor.volume(audit_rows(spark, sf_dir))
    return found.select("user_id", "timestamp", F.regexp_extract("details", "^[0-9]+", 0).cast("bigint").alias("records"))


@register("brute_force", f"SELECT CAST(floor({EPOCH} / 86400) AS BIGINT) * 86400 + 86400 AS timestamp, '10.0.0.' || (user_id % 50) AS client_ip, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 3")
def brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitor.brute_force(audit_rows(spark, sf_dir), failures=3, window="1 day")
    return found.select("timestamp", "client_ip", F.regexp_extract("details", "^[0-9]+", 0).cast("bigint").alias("failures"))


@register("alert_rules", f"SELECT CAST(floor({EPOCH} / 86400) AS BIGINT) * 86400 + 86400 AS timestamp, '10.0.0.' || (user_id % 50) AS client_ip, 'block_ip' AS action FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 3")
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("brute_force", 2, "block_ip", "", True), ("brute_force", 3, "email", "x", True), ("data_exfiltration", 0, "log", "", False)], "event_type string, min_severity int, action string, config string, enabled boolean")
    return monitor.alerts(monitor.brute_force(audit_rows(spark, sf_dir), failures=3, window="1 day"), rules).select("timestamp", "client_ip", "action")
