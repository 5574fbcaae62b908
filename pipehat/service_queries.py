"""Queries for the operators around the engine: stores, files, wire and web, results, redaction, security, streams; with SQL."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipehat.functions import hl7, redact
from pipehat.operators import audit, mfa, monitor, queues, result, security
from pipehat.operators.backup import Backups
from pipehat.operators.engine import Engine, query
from pipehat.operators.queues import QueueProblem, QueueStore
from pipehat.operators.result import Rows
from pipehat.plans.bind import Semantics
from pipehat.plans.lang import parse as parse_statement
from pipehat.queries import EPOCH, KIND, KINDS, NOW, PID, RAW, VALUE, audit_rows, engine, messages, raw_messages, register
from pipehat.runtime import scratch
from pipehat.sources import readers, web
from pipehat.streaming import ingest

FIRST = "(SELECT * FROM events ORDER BY event_id LIMIT {})"


def rows_of(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    """(n, line) of a text's lines, from 1."""
    return rows_of(spark, "n int, line string", [(i, x) for i, x in enumerate(text.split("\n"), 1)])


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a few rows of texts, whole numbers and truth values."""
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({columns})"


def texts(spark: SparkSession, sf_dir: str, n: int) -> list[str]:
    """The first n messages."""
    return [r.raw_message for r in raw_messages(spark, sf_dir).orderBy("msg_id").limit(n).collect()]


# -- scans over all queues, single statements, life of a queue -----------------------------------------------------------
@register("from_all", f"SELECT {PID} AS pid, {KIND} AS kind FROM events")
def from_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, split=True).sql("SELECT segment.PID[3] AS pid, segment.OBX[3] AS kind FROM ALL")


@register("display_order", "SELECT event_type AS queue, CAST(event_id AS VARCHAR) AS control FROM events ORDER BY event_type, event_id LIMIT 100")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.in_display_order(engine(spark, sf_dir, split=True).store.everything()).limit(100).select("queue", F.col("msh9").alias("control"))


@register("single_insert", f"SELECT CAST(event_id AS VARCHAR) AS control, row_number() OVER (ORDER BY event_id) AS msg_id, {NOW} AS timestamp, md5({RAW}) AS raw_hash FROM {FIRST.format(5)}")
def single_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, scratch(spark, "queues"), clock=lambda: NOW)
    e.sql("CREATE QUEUE one")
    for t in texts(spark, sf_dir, 5):
        e.sql(f"INSERT MESSAGE INTO one '{t}'")
    return e.store.active("one").select(F.col("msh9").alias("control"), "msg_id", F.col("timestamp").cast("int").alias("timestamp"), F.md5("raw_message").alias("raw_hash"))


@register(
    "queue_lifecycle",
    "SELECT unnest(['create again', 'missing is there', 'missing is empty', 'names', 'is there', 'is empty', 'size', 'history', 'drop a full one', 'cleared', 'dropped', 'is there then', 'drop a missing one', 'bad name']) AS step, "
    "unnest(['-1', 'false', 'false', 'events', 'true', 'false', CAST(n - 3 AS VARCHAR), '3', '-2', '0', 'OK (0 rows)', 'false', '-1', '-2']) AS outcome FROM (SELECT count(*) AS n FROM events)",
)
def queue_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    s = e.store
    s.pop("events", 3)

    def told(f) -> str:
        try:
            out = f()
        except QueueProblem as problem:
            return str(problem.code)
        return str(out).lower() if isinstance(out, bool) else str(out)

    steps = [
        ("create again", lambda: s.create("events")), ("missing is there", lambda: s.has("none")), ("missing is empty", lambda: s.is_empty("none")), ("names", lambda: ",".join(s.names())), ("is there", lambda: s.has("events")),
        ("is empty", lambda: s.is_empty("events")), ("size", lambda: s.size("events")), ("history", lambda: s.history_size("events")), ("drop a full one", lambda: s.drop("events")),
        ("cleared", lambda: s.clear("events") or s.size("events")), ("dropped", lambda: e.run("DROP QUEUE events").text()), ("is there then", lambda: s.has("events")), ("drop a missing one", lambda: s.drop("events")), ("bad name", lambda: s.create("a b")),
    ]
    return rows_of(spark, "step string, outcome string", [(k, told(f)) for k, f in steps])


@register("index_names", values("segment, field, name", [("PID", 3, "pid3"), ("MSH", 9, "msh9"), ("MSH", 3, "msh3"), ("MSH", 10, "msh10"), ("PV1", 19, "pv119"), ("MSH", 7, "msh7"), ("OBX", 5, None)]))
def index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [("PID", 3), ("MSH", 9), ("MSH", 3), ("MSH", 10), ("PV1", 19), ("MSH", 7), ("OBX", 5)]
    return rows_of(spark, "segment string, field int, name string", [(s, n, hl7.index_name(s, n)) for s, n in asked])


@register("index_list", f"SELECT CAST(event_id AS VARCHAR) AS control, {VALUE} AS obx_5, 'FAC' AS fac FROM events WHERE event_type = 'view'")
def index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose settings name the fields it keeps as columns."""
    config = readers.Config("[index]\nindexed_fields = OBX-3,OBX-5,MSH-9,MSH-3\n")
    e = engine(spark, sf_dir, indexed=readers.index_list(config.text("index", "indexed_fields")))
    again = QueueStore(spark, e.store.root)  # opened anew it knows them
    return again.active("events").where("obx_3 = 'view'").select(F.col("msh9").alias("control"), "obx_5", F.col("msh3").alias("fac"))


# -- files, registries, settings -----------------------------------------------------------------------------------------
@register("registry", "SELECT DISTINCT event_type AS name FROM events WHERE event_type <> 'view' UNION SELECT 'extra'")
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'registry')}/channels.dat"
    readers.write_registry(spark, path, KINDS)
    readers.change_registry(spark, path, add=["extra", "error"])
    readers.change_registry(spark, path, drop=["view", "none"])
    return readers.read_registry(spark, path)


@register("restore_queues", f"SELECT event_type AS queue, CAST(event_id AS VARCHAR) AS control, {EPOCH} AS timestamp FROM events")
def restore_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queues written as persisted files and brought into a new store by their registry."""
    old, root = engine(spark, sf_dir, split=True), scratch(spark, "export")
    readers.export_persisted(old.store, root)
    new = QueueStore(spark, scratch(spark, "queues"), clock=lambda: NOW)
    readers.import_persisted(new, root)
    return new.everything().select("queue", F.col("msh9").alias("control"), "timestamp")


ESCAPED = rf"replace(replace(replace({RAW}, '\', '\\'), chr(13), '\r'), '|', '\|')"


@register("file_stats", f"SELECT count(*) AS messages, CAST(sum(octet_length(encode('PLN|' || event_id || '|' || {EPOCH} || '|' || {ESCAPED})) + 1) AS BIGINT) AS bytes FROM events")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    readers.write_persisted(raw_messages(spark, sf_dir), path)
    return readers.file_stats(spark, path)


@register("atomic_rewrite", f"SELECT event_id AS msg_id, {EPOCH} AS timestamp, {PID} AS pid FROM events WHERE event_id % 3 = 0")
def atomic_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of lines, appended to and then replaced by a third of its own."""
    path, raw = scratch(spark, "lines"), raw_messages(spark, sf_dir)
    for part in (raw.where("msg_id % 2 = 0"), raw.where("msg_id % 2 = 1")):
        readers.write_persisted(part, path)
    readers.write_persisted(readers.read_persisted(spark, path, parse=False).where("msg_id % 3 = 0"), path, mode="overwrite")
    return readers.read_persisted(spark, path).select("msg_id", "timestamp", F.col("pid3").alias("pid"))


@register("settings", values("name, setting", [("port", "2575"), ("host", "h=1"), ("tls", "true"), ("bad", "9"), ("ratio", "0.5"), ("none", "d"), ("odd", "false")]))
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = readers.Config("# settings\n[server]\nport = 2575\nhost = h=1\ntls = Yes\nbad = 1x\n; more\n[storage]\nratio=0.5\nodd = perhaps\n")
    got = [("port", c.whole("server", "port")), ("host", c.text("server", "host")), ("tls", c.flag("server", "tls")), ("bad", c.whole("server", "bad", 9)), ("ratio", c.real("storage", "ratio")), ("none", c.text("none", "x", "d")), ("odd", c.flag("storage", "odd"))]
    return rows_of(spark, "name string, setting string", [(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in got])


@register("backup_restore", "SELECT 'full' AS backup, CAST(event_id AS VARCHAR) AS control FROM events WHERE event_type = 'click' UNION ALL SELECT 'incremental', CAST(event_id AS VARCHAR) FROM events WHERE event_type IN ('click', 'view')")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store backed up whole, then again after more messages; both restored elsewhere and read there."""
    e, raw = Engine(spark, scratch(spark, "queues"), clock=lambda: NOW), raw_messages(spark, sf_dir)
    backups, out = Backups(spark, e.store.root, scratch(spark, "backups"), lambda: NOW), None
    e.sql("CREATE QUEUE q")
    for name, kind in (("full", "click"), ("incremental", "view")):
        e.insert_frame("q", raw.where(F.col("kind") == kind), ["msg_id"])
        made = backups.incremental()  # the first is full
        if made.kind != name or not backups.verify(made.backup_id):
            raise RuntimeError(f"backup {made.backup_id} is no {name} one, or damaged")
        root = scratch(spark, "restored")
        backups.restore(made.backup_id, root)
        part = QueueStore(spark, root).active("q").select(F.lit(made.kind).alias("backup"), F.col("msh9").alias("control"))
        out = part if out is None else out.unionAll(part)
    return out


# -- wire and web --------------------------------------------------------------------------------------------------------
ASKED = [f"SELECT COUNT(*) AS n FROM events WHERE segment.OBX[3] = '{k}'" for k in KINDS]


@register("wire", "SELECT 0 AS status, 'n' || chr(10) || count(*) || chr(10) || chr(10) || '1 row(s) returned' AS answer FROM events GROUP BY event_type UNION ALL SELECT 2, 'ERROR 2: queue none doesn''t exist' UNION ALL SELECT 0, 'OK (1 rows affected)'")
def wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed requests, answered one after the other; framed responses, read again."""
    e = engine(spark, sf_dir)
    data = b"".join(map(readers.request_frame, [*ASKED, "SELECT * FROM none", "INSERT MESSAGE INTO events 'MSH|^~\\&|A'"]))
    answers = b"".join(readers.answer(e, r) for r in readers.read_requests(data))
    return rows_of(spark, "status int, answer string", list(readers.read_responses(answers)))


@register(
    "web",
    f"""SELECT 'queues' AS request, 200 AS status, '{{"queues":[' || string_agg('{{"name":"' || event_type || '","messages":' || n || ',"history":0}}', ',' ORDER BY event_type) || ']}}' AS body FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
UNION ALL SELECT 'statistics', 200, '{{"total_queues":5,"total_messages":' || count(*) || ',"total_history":0,"grand_total":' || count(*) || '}}' FROM events
UNION ALL SELECT 'query', 200, '{{"success":true,"rows_affected":0,"num_rows":1,"rows":[{{"n":"' || count(*) || '","z":"0"}}]}}' FROM events WHERE event_type = 'click' AND user_id % 2 IS NOT NULL
UNION ALL {values("request, status, body", [
        ("health", 200, '{"status":"healthy","version":"1.0.0","features":["persistence","indexing"]}'), ("insert", 200, '{"success":true,"message":"Message inserted successfully"}'), ("no queue", 400, '{"error":"Queue not found"}'),
        ("no message", 400, '{"error":"Invalid HL7 message"}'), ("no query", 400, '{"error":"Missing query parameter"}'), ("no page", 404, "Not Found"), ("wrong query", 200, '{"success":false,"error":"queue none doesn\'t exist"}'),
    ])}
UNION ALL SELECT 'after', 200, '{{"total_queues":5,"total_messages":' || (count(*) + 1) || ',"total_history":0,"grand_total":' || (count(*) + 1) || '}}' FROM events""",
)
def web_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = web.Web(engine(spark, sf_dir, split=True))
    message = texts(spark, sf_dir, 1)[0]
    asked = [
        ("queues", "GET", "/api/queues", ""), ("statistics", "GET", "/api/statistics", ""), ("query", "GET", "/api/query?query=" + quote("SELECT COUNT(*) AS n, COUNT(segment.ZZZ[1]) AS z FROM click"), ""), ("health", "GET", "/api/health", ""),
        ("insert", "POST", "/api/insert", json.dumps({"queue": "click", "message": message})), ("no queue", "POST", "/api/insert", json.dumps({"queue": "none", "message": message})), ("no message", "POST", "/api/insert", json.dumps({"queue": "click", "message": "x"})),
        ("no query", "POST", "/api/query", ""), ("no page", "GET", "/api/none", ""), ("wrong query", "POST", "/api/query", "query=SELECT+*+FROM+none"), ("after", "GET", "/api/statistics", ""),
    ]
    return rows_of(spark, "request string, status int, body string", [(name, *tool.handle(method, path, body)) for name, method, path, body in asked])


@register("json_and_url", f"SELECT event_id AS msg_id, CAST(to_json({RAW}) AS VARCHAR) AS coded, event_type || ' 100% \"' AS plain FROM events")
def json_and_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.concat(F.url_encode("kind"), F.lit("+100%25%20%22"))
    return raw_messages(spark, sf_dir).select("msg_id", web.json_text(F.col("raw_message")).alias("coded"), web.url_text(coded).alias("plain"))


# -- results as text -----------------------------------------------------------------------------------------------------
COUNTED = "SELECT COUNT(*) AS n, COUNT(segment.ZZZ[1]) AS z FROM events WHERE segment.OBX[3] = 'click'"


@register("result_text", "SELECT unnest([1, 2, 3, 4]) AS n, unnest(['n | z', count(*) || ' | 0', '', '1 row(s) returned']) AS line FROM events WHERE event_type = 'click'")
def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, engine(spark, sf_dir).run(COUNTED).text())


@register("result_rows", values("line", [("a | b",), ("1 | NULL",), ("x | y",), ("",), ("2 row(s) returned",), ("value y",), ("value None",), ("columns 2",), ("ERROR 2: no",), ("error True",), ("OK (0 rows)",), ("OK (3 rows affected)",)]))
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results built by hand."""
    rows = Rows(["a", "b"])
    rows.add_row("1")
    rows.add_row("x", "y")
    r, bad = rows.result(spark), result.failure(2, "no")
    lines = [*r.text().split("\n"), f"value {r.value(1, 1)}", f"value {r.value(2, 0)}", f"columns {len(r.columns)}", bad.text(), f"error {bad.has_error()}", Rows(["a"]).result(spark).text(), result.Result(affected=3).text()]
    return rows_of(spark, "line string", [(x,) for x in lines])


@register("redacted_result", f"SELECT unnest([1, 2, 3, 4, 5]) AS n, unnest([rpad('msg_id', 20, ' ') || ' ' || rpad('raw_message', 20, ' ') || ' ', repeat('-', 20) || ' ' || repeat('-', 20) || ' ', rpad('1', 20, ' ') || ' ' || left({RAW}, 47) || '... ', '', '1 row(s) returned (PHI REDACTED)']) AS line FROM {FIRST.format(1)}")
def redacted_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, extended=True)
    return lines_of(spark, e.run("SELECT msg_id, raw_message FROM events WHERE msg_id = 1").table(redacted=True))


SHOWN = f"'Type: ' || event_id || ' (UNKNOWN)' || chr(10) || 'Version: unknown' || chr(10) || 'Segments: 4' || chr(10)"
SEGMENT = "chr(10) || '[{}] {} ({} fields)' || chr(10)"


def raw_line(i: int, segment: str, n: int) -> str:
    return SEGMENT.format(i, segment, n) + f" || '    Raw: ' || string_split({RAW}, chr(13))[{i + 1}] || chr(10)"


@register("print_message", f"SELECT event_id AS msg_id, md5('=== HL7 Message ===' || chr(10) || 'ID: ' || event_id || chr(10) || {SHOWN} || {raw_line(0, 'MSH', 11)} || {raw_line(1, 'PID', 5)} || {raw_line(2, 'OBX', 5)} || {raw_line(3, 'OBX', 5)} || repeat('=', 18) || chr(10)) AS told FROM events")
def print_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("msg_id", F.md5(result.message_text(verbose=True)).alias("told"))


def fields_text(i: int, segment: str, *shown: str) -> str:
    return " || ".join([SEGMENT.format(i, segment, len(shown)), *(f"'    [{n}] ' || {x} || chr(10)" for n, x in enumerate(shown, 1) if x != "NULL")])


# the second field of MSH is its separators in this numbering, whose first component and repetition is empty
@register(
    "print_redacted",
    f"SELECT event_id AS msg_id, md5('=== HL7 Message (PHI REDACTED) ===' || chr(10) || 'ID: ' || event_id || chr(10) || {SHOWN} || "
    + " || ".join([
        fields_text(0, "MSH", "''", "'APP'", "'FAC'", "'R'", "'RF'", "strftime(ts, '%Y%m%d%H%M%S')", "''", "'ORU'", "CAST(event_id AS VARCHAR)", "'P'", "'2.5'"),
        fields_text(1, "PID", "'1'", "''", "'[REDACTED]'", "''", "'[REDACTED]'"),
        fields_text(2, "OBX", "'1'", "'NM'", "event_type", "''", VALUE),
        fields_text(3, "OBX", "'2'", "'ST'", "'SRC'", "''", "'s' || (user_id % 10)"),
    ])
    + " || repeat('=', 35) || chr(10)) AS told FROM events",
)
def print_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("msg_id", F.md5(result.message_text(True, redact.DEFAULT)).alias("told"))


# -- redaction of statements ---------------------------------------------------------------------------------------------
def redacted(name: str, text: str, sql: str, how: redact.Redaction = redact.DEFAULT, guarded: bool = False) -> None:
    """A statement over messages whose protected fields it may not see."""
    semantics = Semantics(now=NOW, extended=True, redaction=how, guarded=guarded)
    register(name, sql)(lambda spark, sf_dir: query(raw_messages(spark, sf_dir), text, semantics))


HIDDEN = f"replace(replace({RAW}, 'PID|1||' || user_id || '^^^FAC&ISO^MR~ALT' || event_id, 'PID|1||[REDACTED]'), 'DOE^' || event_type, '[REDACTED]')"
redacted("redacted_alias", "SELECT segment.PID[3] AS a, segment.OBX[3] AS kind, msg_id FROM q", f"SELECT '[REDACTED]' AS a, {KIND} AS kind, event_id AS msg_id FROM events")
redacted("redacted_component", "SELECT segment.PID[3].4 AS a, PID-3.3.1 AS b, PID-5.1 AS c, segment.OBX[5] AS v FROM q", f"SELECT '[REDACTED]' AS a, '[REDACTED]' AS b, '[REDACTED]' AS c, {VALUE} AS v FROM events")
redacted("redacted_message_alias", "SELECT raw_message AS msg_type, msg_id FROM q WHERE msg_id < 500", f"SELECT {HIDDEN} AS msg_type, event_id AS msg_id FROM events WHERE event_id < 500")
redacted("redacted_aggregate", "SELECT segment.OBX[3] AS kind, MIN(segment.PID[5]) AS low, MAX(segment.PID[3]) AS high, COUNT(DISTINCT segment.PID[3]) AS n FROM q GROUP BY kind", "SELECT event_type AS kind, '[REDACTED]' AS low, '[REDACTED]' AS high, CAST(1 AS BIGINT) AS n FROM events GROUP BY event_type")
redacted("redacted_group", "SELECT segment.PID[3] AS pid, COUNT(*) AS n FROM q GROUP BY pid", "SELECT '[REDACTED]' AS pid, count(*) AS n FROM events")
redacted("redacted_order", "SELECT segment.PID[3] AS pid, msg_id FROM q ORDER BY segment.PID[3], msg_id LIMIT 10", "SELECT '[REDACTED]' AS pid, event_id AS msg_id FROM events ORDER BY event_id LIMIT 10")
redacted("redacted_filter", "SELECT segment.PID[3] AS pid, msg_id FROM q WHERE segment.PID[3] = '7'", "SELECT CASE WHEN user_id < 100 THEN '[REDACTED]' END AS pid, event_id AS msg_id FROM events WHERE user_id = 7", redact.DEBUG)


@register("redacted_refusals", values("statement, code", [("plain", 0), ("field", 2), ("like", 2), ("message", 2), ("order", 0), ("having", 0)]))
def redacted_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session without the right to read protected data may ask."""
    e = engine(spark, sf_dir, extended=True)
    asked = {
        "plain": "SELECT segment.PID[3] AS p FROM events WHERE segment.OBX[3] = 'view'", "field": "SELECT msg_id FROM events WHERE segment.PID[3] = '7'", "like": "SELECT msg_id FROM events WHERE segment.OBX[3] = 'x' OR segment.PID[5] LIKE 'D%'",
        "message": "SELECT msg_id FROM events WHERE raw_message LIKE '%DOE%'", "order": "SELECT msg_id FROM events ORDER BY segment.PID[3]", "having": "SELECT segment.OBX[3] AS k, COUNT(*) AS n FROM events GROUP BY k HAVING MIN(segment.PID[3]) = '7'",
    }
    return rows_of(spark, "statement string, code int", [(k, e.run(t, redact.DEFAULT, guarded=True).code) for k, t in asked.items()])


MORE = "'NK1|1|KIN^ANN|MTH|1 ROAD|555' || user_id", "'IN1|1|ACC' || event_id || '|CO'", "'MRN|' || user_id || '||x'"


@register("redact_segments", "SELECT event_id AS msg_id, 'NK1|1|[REDACTED]|MTH|[REDACTED]|[REDACTED]' AS kin, 'IN1|1|[REDACTED]|CO' AS insurance, 'MRN|[REDACTED]||[REDACTED]' AS named, 'PV1' || repeat('|', 44) || '[REDACTED]|[REDACTED]|z' AS visit, 'IN1|1|ACC' || event_id || '|CO' AS insurance_shown FROM events")
def redact_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next of kin, insurance, visits and segments named for record numbers."""
    e, user = F.col("msg_id").cast("string"), hl7.read_raw(F.col("raw_message"), "PID-3")
    visit = F.lit("PV1" + "|" * 44 + "20240101|20240102|z")
    text = F.concat_ws("\r", "raw_message", F.concat(F.lit("NK1|1|KIN^ANN|MTH|1 ROAD|555"), user), F.concat(F.lit("IN1|1|ACC"), e, F.lit("|CO")), F.concat(F.lit("MRN|"), user, F.lit("||x")), visit)
    some = redact.Redaction(accounts=False)
    lines = raw_messages(spark, sf_dir).select("msg_id", F.split(redact.redact_message(text), "\r").alias("a"), F.split(redact.redact_message(text, some), "\r").alias("b"))
    return lines.select("msg_id", F.get("a", F.lit(4)).alias("kin"), F.get("a", F.lit(5)).alias("insurance"), F.get("a", F.lit(6)).alias("named"), F.get("a", F.lit(7)).alias("visit"), F.get("b", F.lit(5)).alias("insurance_shown"))


# -- types, aggregates ---------------------------------------------------------------------------------------------------
TYPED = ("ADT^A01", "ORU^R01", "ZZZ^Z01", "SIU")
VERSIONED = ("2.3.1", "2.5.1", "9.9")


def pick(values: tuple[str, ...]) -> Column:
    """The values in turn, by msg_id."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("msg_id") % len(values) + 1).cast("int"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of several types and versions; every tenth is none."""
    raw = F.regexp_replace("raw_message", r"\|ORU\^[a-z]+\|", "|@|")
    text = F.replace(F.regexp_replace(raw, r"\|2\.5\r", "|#\r"), F.lit("@"), pick(TYPED))
    return raw_messages(spark, sf_dir).withColumn("raw_message", F.when(F.col("msg_id") % 10 == 9, "junk").otherwise(F.replace(text, F.lit("#"), pick(VERSIONED)))).drop("kind")


KINDS_SQL = "CASE WHEN event_id % 10 = 9 THEN 'UNKNOWN' ELSE ['ADT', 'ORU', 'UNKNOWN', 'SIU'][event_id % 4 + 1] END"


@register("types_and_versions", f"SELECT event_id AS msg_id, {KINDS_SQL} AS type_code, CASE WHEN event_id % 10 = 9 THEN 'unknown' ELSE ['2.3.1', '2.5.1', 'unknown'][event_id % 3 + 1] END AS version, CASE WHEN event_id % 10 = 9 THEN -2 ELSE 0 END AS code, CASE WHEN event_id % 10 = 9 THEN -2 ELSE -3 END AS reversed FROM events")
def types_and_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hl7.parse(typed(spark, sf_dir), numbering="standard")
    check = lambda segments: hl7.validate(segments, F.when(F.col("num_segments") > 0, F.col("parse_errors")).otherwise(0))
    return m.select("msg_id", F.col("msg_type_code").alias("type_code"), "version", check(F.col("segments")).alias("code"), check(F.reverse("segments")).alias("reversed"))


@register("count_beside_columns", values("mode, code, message", [("strict", 2, "COUNT can't stand beside plain columns"), ("extended", 2, "pid is neither grouped nor counted")]))
def count_beside_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, text = Engine(spark, scratch(spark, "queues")), "SELECT segment.PID[3] AS pid, COUNT(*) AS n FROM q"
    e.sql("CREATE QUEUE q")
    out = [("strict", e.run(text))]
    e.extended = True
    return rows_of(spark, "mode string, code int, message string", [(k, r.code, r.message) for k, r in [*out, ("extended", e.run(text))]])


@register("aggregates", "SELECT event_type AS kind, CAST(sum(user_id) AS DOUBLE) AS total, round(avg(user_id), 6) AS mean, min(CAST(event_id AS VARCHAR)) AS low, count(DISTINCT user_id) AS people FROM events GROUP BY event_type")
def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT segment.OBX[3] AS kind, SUM(segment.PID[3]) AS total, AVG(segment.PID[3]) AS mean, MIN(segment.MSH[9]) AS low, COUNT(DISTINCT segment.PID[3]) AS people FROM q GROUP BY kind"
    return query(raw_messages(spark, sf_dir), text, Semantics(now=NOW, extended=True)).withColumn("mean", F.round("mean", 6))


# -- streams -------------------------------------------------------------------------------------------------------------
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "incoming")
    readers.write_persisted(typed(spark, sf_dir), folder)
    return ingest.stream_messages(spark, folder, numbering="standard")


@register("stream_windows", f"SELECT CAST(floor({EPOCH} / 21600) * 21600 AS BIGINT) AS begins, {KINDS_SQL} AS type_code, count(*) AS messages FROM events WHERE event_id % 10 <> 9 GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of six hours, by a stream that ends with its files."""
    counted, name = ingest.counts(streamed(spark, sf_dir), "6 hours"), "windows_" + scratch(spark, "w").rsplit("-", 1)[1]
    counted.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).where("start IS NOT NULL").select(F.unix_timestamp("start").alias("begins"), F.col("msg_type_code").alias("type_code"), "messages")


@register("session_windows", f"WITH t AS (SELECT user_id, {EPOCH} AS moment FROM events), b AS (SELECT *, coalesce(moment - lag(moment) OVER (PARTITION BY user_id ORDER BY moment) >= 86400, true) AS begins FROM t), s AS (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY user_id ORDER BY moment) AS k FROM b) SELECT CAST(user_id AS VARCHAR) AS pid, min(moment) AS begins, max(moment) + 86400 AS ends, count(*) AS messages FROM s GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a patient's messages without a day between."""
    found = ingest.sessions(messages(spark, sf_dir, "standard"), gap="1 day")
    return found.select(F.col("pid3").alias("pid"), F.unix_timestamp("start").alias("begins"), F.unix_timestamp("end").alias("ends"), "messages")


@register("stream_into_queue", f"SELECT event_id AS control, row_number() OVER (ORDER BY event_id) AS msg_id, {KINDS_SQL} AS type_code FROM events WHERE event_id % 10 <> 9")
def stream_into_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of valid messages appended to a queue; run again it adds nothing."""
    store, folder = QueueStore(spark, scratch(spark, "queues"), numbering="standard", clock=lambda: NOW), scratch(spark, "checkpoint")
    store.create("q")
    valid = streamed(spark, sf_dir).where(hl7.validate(F.col("segments"), F.col("parse_errors")) == 0)
    for _ in range(2):
        ingest.into_queue(valid, store, "q", folder).awaitTermination()
    return store.active("q").select(F.col("msh10").cast("bigint").alias("control"), "msg_id", F.col("msg_type_code").alias("type_code"))


@register("stream_route", "SELECT CASE WHEN event_id % 10 = 9 THEN 'rest' ELSE ['ADT', 'ORU', 'rest', 'rest'][event_id % 4 + 1] END AS sink, event_id AS msg_id FROM events")
def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "routed")

    def sink(name: str):
        return lambda batch, _: batch.select(F.lit(name).alias("sink"), "msg_id").write.mode("append").parquet(root)

    ingest.route(streamed(spark, sf_dir), {"ADT": sink("ADT"), "ORU": sink("ORU")}, scratch(spark, "checkpoint"), otherwise=sink("rest")).awaitTermination()
    return spark.read.schema("sink string, msg_id bigint").parquet(root)


@register("consume_loop", "SELECT CAST(event_id AS VARCHAR) AS control, (row_number() OVER (ORDER BY event_id) - 1) // 3000 AS batch FROM events UNION ALL SELECT 'left', 0")
def consume_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 3,000 popped until none is left."""
    store, root, n = engine(spark, sf_dir).store, scratch(spark, "consumed"), iter(range(10**9))
    ingest.consume(store, "events", lambda batch: batch.select(F.col("msh9").alias("control"), F.lit(next(n)).cast("bigint").alias("batch")).write.mode("append").parquet(root), 3000)
    return spark.read.parquet(root).unionAll(rows_of(spark, "control string, batch bigint", [("left", store.size("events"))]))


# -- security ------------------------------------------------------------------------------------------------------------
STATEMENTS = {"select": "SELECT * FROM q", "insert": "INSERT MESSAGE INTO q 'x'", "create": "CREATE QUEUE q", "drop": "DROP QUEUE q", "pop": "POP MESSAGE FROM q", "clear": "CLEAR HISTORY q"}
ALLOWED = {"none": "", "readonly": "", "clinician": "select insert pop", "analyst": "select pop", "integration": "select insert create pop", "admin": "select insert create drop pop clear", "emergency": "select insert pop"}


@register("permissions", values("role, statement, allowed", [(r, s, s in a.split()) for r, a in ALLOWED.items() for s in STATEMENTS]))
def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which role may run which statement."""
    accounts = security.Accounts(lambda: NOW, rounds=1)
    out = []
    for role in security.ROLES:
        accounts.add(role, "long enough", role)
        session = accounts.login(role, "long enough")
        out += [(role, k, security.may(session, parse_statement(t))) for k, t in STATEMENTS.items()]
    return rows_of(spark, "role string, statement string, allowed boolean", out)


BITS = {"none": 0, "readonly": 0x108, "clinician": 0x11B, "analyst": 0x909, "integration": 0x15B, "admin": 0x1FFF, "emergency": 0x211B}


@register("roles", values("role, bits", list(BITS.items())))
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "role string, bits int", [(k, int(v)) for k, v in security.ROLES.items()])


@register(
    "sessions",
    values("step, outcome", [
        (1, "in"), (2, "valid"), (3, "no valid session"), (4, "unknown user or wrong password"), (5, "unknown user or wrong password"), (6, "the account is locked"), (7, "in"), (8, "wrong password"), (9, "changed"), (10, "unknown user or wrong password"),
        (11, "emergency access needs a reason"), (12, "no emergency access"), (13, "emergency"), (14, "out"), (15, "no valid session"),
    ]),
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins, idle ends, lockout, passwords and emergency access, by a clock that the query moves."""
    now = [NOW]
    a = security.Accounts(lambda: now[0], lock_after=2, rounds=1)
    a.add("doc", "long enough", "clinician")
    a.add("hero", "long enough", "emergency")
    held: dict[str, security.Session] = {}

    def login(name: str, password: str, **_):
        held[name] = a.login(name, password)
        return "in"

    def later(seconds: int, then):
        now[0] += seconds
        return then()

    check = lambda n: a.check(held[n].token) and "valid"
    steps = [
        lambda: login("doc", "long enough"), lambda: later(899, lambda: check("doc")), lambda: later(900, lambda: check("doc")), lambda: login("doc", "wrong"), lambda: login("doc", "wrong"), lambda: login("doc", "long enough"),
        lambda: later(900, lambda: login("doc", "long enough")), lambda: a.change_password(held["doc"].token, "wrong", "another one"), lambda: a.change_password(held["doc"].token, "long enough", "another one") or "changed",
        lambda: login("doc", "long enough"), lambda: a.emergency("hero", "long enough", " "), lambda: a.emergency("doc", "another one", "fire"),
        lambda: held.update(hero=a.emergency("hero", "long enough", "fire")) or ("emergency" if held["hero"].permissions & security.P.READ_PHI else "nothing"),
        lambda: a.logout(held["hero"].token) or "out", lambda: check("hero"),
    ]

    def told(f) -> str:
        try:
            return f()
        except security.Denied as e:
            return str(e)

    return rows_of(spark, "step int, outcome string", [(i, told(f)) for i, f in enumerate(steps, 1)])


# The test vectors of RFC 6238, shortened to six digits.
CODES = [(59, "287082"), (1111111109, "081804"), (1111111111, "050471"), (1234567890, "005924"), (2000000000, "279037"), (20000000000, "353130")]


@register("second_factor", "SELECT CAST(second AS BIGINT) AS second, code, verified, again FROM (" + values("second, code, verified, again", [(t, c, True, False) for t, c in CODES]) + ")")
def second_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-time passwords; each works once."""
    out, now = [], [0]
    f = mfa.SecondFactor("doc", b"12345678901234567890", lambda: now[0])
    for now[0], _ in CODES:
        code = mfa.code_at(f.secret, now[0] // mfa.STEP)
        out.append((now[0], code, f.verify(code), f.verify(code)))
    return rows_of(spark, "second bigint, code string, verified boolean, again boolean", out)


@register(
    "secured_statements",
    "SELECT * FROM (" + values("who, code, first, touched", [("clinician", 0, "1", 1), ("readonly", 0, "[REDACTED]", 0), ("none", -3, None, 0), ("nobody", -1, None, 0)]) + ")",
)
def secured_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement on behalf of several users, with what the audit log says."""
    e = Engine(spark, scratch(spark, "queues"), clock=lambda: NOW)
    e.sql("CREATE QUEUE q")
    e.sql("INSERT MESSAGE INTO q 'MSH|^~\\&|A\rPID|1||1||X'")
    accounts, log = security.Accounts(lambda: NOW, rounds=1), audit.AuditLog(spark, scratch(spark, "audit"), lambda: NOW)
    secure, out = security.SecureEngine(e, accounts, log), []
    for who in ("clinician", "readonly", "none", "nobody"):
        token = "no token"
        if who != "nobody":
            accounts.add(who, "long enough", who)
            token = accounts.login(who, "long enough").token
        r = secure.run(token, "SELECT segment.PID[3] AS any FROM q")
        out.append((len(out) + 1, who, r.code, r.value(0, 0)))
    told = rows_of(spark, "event_id bigint, who string, code int, first string", out)
    return told.join(log.read(), "event_id").select("who", "code", "first", F.col("phi_record_count").cast("int").alias("touched"))


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_rows(spark, sf_dir)
    return monitor.brute_force(log, failures=3, window="1 day").unionByName(monitor.after_hours(log)).unionByName(monitor.volume(log))


DETECTED = f"""WITH found AS (
  SELECT 'brute_force' AS event_type, 2 AS severity, CAST(floor({EPOCH} / 86400) AS BIGINT) * 86400 + 86400 AS timestamp FROM events WHERE event_type = 'error' GROUP BY user_id % 50, floor({EPOCH} / 86400) HAVING count(*) >= 3
  UNION ALL SELECT 'after_hours_access', 1, {EPOCH} FROM events WHERE event_type IN ('view', 'purchase') AND (hour(ts) < 8 OR hour(ts) >= 18)
  UNION ALL SELECT 'data_exfiltration', 2, CAST((day + 1) * 86400 AS BIGINT) FROM (SELECT *, avg(n) OVER (PARTITION BY user_id) AS usual FROM (SELECT user_id, CAST(floor({EPOCH} / 86400) AS BIGINT) AS day, sum(event_id % 7 + 1) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL)) WHERE n > usual * 2)"""


@register("security_stats", DETECTED + " SELECT count(*) AS total_events, CAST(0 AS BIGINT) AS critical_events, count(*) FILTER (event_type = 'brute_force') AS brute_force_attempts, count(*) FILTER (event_type <> 'brute_force') AS anomalies, max(timestamp) AS last_event_time FROM found")
def security_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.statistics(events_of(spark, sf_dir))


@register("security_report", DETECTED + " SELECT event_type, severity, count(*) AS events, min(timestamp) AS first, max(timestamp) AS last FROM found WHERE timestamp BETWEEN 1704200000 AND 1705200000 GROUP BY ALL")
def security_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.report(events_of(spark, sf_dir), 1704200000, 1705200000)


@register("brute_force_sliding", f"WITH s AS (SELECT '10.0.0.' || (user_id % 50) AS client_ip, {EPOCH} AS moment FROM events WHERE event_type = 'error'), w AS (SELECT client_ip, unnest(range(CAST(floor(moment / 21600) AS BIGINT) - 3, CAST(floor(moment / 21600) AS BIGINT) + 1)) * 21600 + 86400 AS timestamp FROM s) SELECT timestamp, client_ip, count(*) AS failures FROM w GROUP BY ALL HAVING count(*) >= 4")
def brute_force_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that begin every six hours."""
    found = monitor.brute_force(audit_rows(spark, sf_dir), failures=4, window="1 day", slide="6 hours")
    return found.select("timestamp", "client_ip", F.regexp_extract("details", "^[0-9]+", 0).cast("bigint").alias("failures"))
