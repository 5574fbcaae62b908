import hashlib
import json
import random
import threading
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from pipehat.functions import codec
from pipehat.operators import audit, chain, mfa, monitor
from pipehat.operators.audit import AuditFilter, AuditLog
from pipehat.operators.backup import Backups
from pipehat.operators.engine import Engine
from pipehat.functions.redact import OFF
from pipehat.operators.security import EVERYTHING, ROLES, Accounts, Denied, Permission, SecureEngine
from pipehat.sources import readers
from pipehat.sources.web import Web, json_text
from pipehat.storage import Conflict, Manifest, write_text
from pipehat.streaming import ingest

from .samples import ADT_JONES, ORU_CBC, admission

NOW = 1_700_000_000


class Clock:
    def __init__(self):
        self.now = NOW

    def __call__(self):
        return self.now


def test_manifest(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.read() == (0, {}) and m.commit(0, {"a": 1}) == 1 and m.commit(1, {"a": 2}) == 2
    with pytest.raises(Conflict):
        m.commit(1, {"a": 3})
    assert m.read() == (2, {"a": 2}) and m.read(1) == (1, {"a": 1})


# -- audit --------------------------------------------------------------------------------------------------------------
@pytest.fixture
def log(spark, tmp_path):
    out = AuditLog(spark, f"file://{tmp_path}/audit", Clock())
    out.append([{"event_type": "login", "user_id": 1, "username": "a"}, {"event_type": "query", "user_id": 1, "phi_accessed": True, "phi_record_count": 3, "resource": "q"}])
    out.append([{"event_type": "login", "user_id": 2, "success": False, "severity": 3, "details": "é \"quoted\" \\ /"}])
    return out


def test_audit(log, tmp_path):
    ids = lambda f: [r.event_id for r in log.query(f).orderBy("event_id").collect()]
    assert ids(AuditFilter()) == [1, 2, 3] and ids(AuditFilter(user_id=1, phi_only=True)) == [2] and ids(AuditFilter(success=False)) == [3]
    assert ids(AuditFilter(min_severity=2)) == [3] and ids(AuditFilter(max_results=2)) == [1, 2] and ids(AuditFilter(start=NOW + 1)) == [] and ids(AuditFilter(resource="q", username=None)) == [2]
    assert tuple(log.statistics().first()) == (3, 1, 1, 2)
    assert log.verify().count() == 0
    log.export(f"{tmp_path}/out")
    assert log.spark.read.json(f"{tmp_path}/out").count() == 3
    log.seal(f"file://{tmp_path}/seal.json")
    log.append([{"event_type": "more"}])
    assert log.sealed_is_kept(f"file://{tmp_path}/seal.json") and not log.sealed_is_kept(f"file://{tmp_path}/none")


def test_tampering_shows(log):
    rows = log.read()
    changed = rows.withColumn("username", F.when(F.col("event_id") == 2, "x").otherwise(F.col("username")))
    assert {tuple(r) for r in audit.broken(changed).collect()} == {(2, "changed")}
    # a hash changed to match betrays itself by all later checksums
    forged = changed.withColumn("payload_hash", audit.payload_hash())
    assert {tuple(r) for r in audit.broken(forged).collect()} == {(2, "link"), (3, "link")}
    assert {tuple(r) for r in audit.broken(rows.where("event_id <> 2")).collect()} == {(3, "link")}
    assert audit.broken(rows.limit(0)).count() == 0


@pytest.mark.parametrize("local", [0, 2, 20_000])
def test_chain_against_a_plain_version(spark, local, monkeypatch):
    """Dense ids and ids with gaps, several levels of blocks; grown row by row and made at once."""
    monkeypatch.setattr(chain, "LOCAL", local or 1)
    rnd = random.Random(4)
    for ids in ([], [7], list(range(1, 300)), sorted(rnd.sample(range(20_000), 400)), [1, 2, 5, 6, 64, 4096, 300_000]):
        rows = [(n, hashlib.sha256(str(n).encode()).hexdigest()) for n in ids]
        got = {r.id: (r.previous_id, r.checksum) for r in chain.linked(spark.createDataFrame(rows, "id bigint, hash string")).collect()}
        grown, before, expected = chain.Chain(), None, {}
        for i, (n, h) in enumerate(rows):
            if i % 7 == 0:
                grown = chain.Chain(json.loads(json.dumps(grown.state)))
            expected[n] = (before, grown.add(n, h))
            before = n
        assert got == expected


def test_verification_of_a_log_in_batches(log):
    log.append([{"event_type": "more", "user_id": k} for k in range(200)])
    assert log.verify().count() == 0
    log.compact()
    assert log.read().count() == 203 and log.verify().count() == 0 and log.verify(2, 50).count() == 0
    log.append([{"event_type": "after"}])
    assert log.verify().count() == 0 and len(log.manifest.read()[1]["batches"]) == 2


# -- security -----------------------------------------------------------------------------------------------------------
def test_accounts():
    clock = Clock()
    a = Accounts(clock, rounds=10)
    a.add("doc", "long enough", "clinician")
    a.add("hero", "long enough", Permission.EMERGENCY_ACCESS)
    with pytest.raises(ValueError):
        a.add("doc", "long enough", "clinician")
    s = a.login("doc", "long enough")
    assert a.check(s.token).user.name == "doc"
    for _ in range(5):
        with pytest.raises(Denied):
            a.login("doc", "wrong one")
    with pytest.raises(Denied, match="locked"):
        a.login("doc", "long enough")
    clock.now += 901
    with pytest.raises(Denied):
        a.check(s.token)
    s = a.login("doc", "long enough")
    a.change_password(s.token, "long enough", "another one")
    with pytest.raises(Denied):
        a.login("doc", "long enough")
    with pytest.raises(Denied):
        a.emergency("doc", "another one", "reason")
    with pytest.raises(Denied):
        a.emergency("hero", "long enough", " ")
    assert a.emergency("hero", "long enough", "cardiac arrest").permissions & Permission.READ_PHI
    a.logout(s.token)
    with pytest.raises(Denied):
        a.check(s.token)
    assert not ROLES["readonly"] & Permission.READ_PHI and ROLES["admin"] == EVERYTHING & ~Permission.EMERGENCY_ACCESS


def test_second_factors():
    # the test vectors of RFC 6238, shortened to six digits
    for at, code in ((59, "287082"), (1111111109, "081804"), (20000000000, "353130")):
        assert mfa.code_at(b"12345678901234567890", at // 30) == code
    clock = Clock()
    f = mfa.SecondFactor("doc", clock=clock)
    code = mfa.code_at(f.secret, NOW // 30)
    assert f.verify(code) and not f.verify(code) and not f.verify("x")
    clock.now += 300
    assert not f.verify(code) and f.verify(mfa.code_at(f.secret, clock.now // 30 - 1)) and "otpauth://totp/" in f.uri()
    codes = f.new_backup_codes()
    assert f.use_backup_code(codes[0].upper()) and not f.use_backup_code(codes[0]) and len(f.backup) == 9


def test_secure_statements(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/q", clock=lambda: NOW)
    accounts, log = Accounts(rounds=10), AuditLog(spark, f"file://{tmp_path}/a")
    for name, role in (("admin", "admin"), ("doc", "clinician"), ("reader", "readonly"), ("nobody", "none")):
        accounts.add(name, "long enough", role)
    token = {n: accounts.login(n, "long enough").token for n in accounts.users}
    s = SecureEngine(engine, accounts, log)
    assert s.run(token["admin"], "CREATE QUEUE q").code == 0 and s.run(token["doc"], "CREATE QUEUE r").code == -3
    assert s.run(token["doc"], f"INSERT MESSAGE INTO q '{ADT_JONES}'").code == 0 and s.run(token["reader"], "INSERT MESSAGE INTO q 'x'").code == -3
    ask = "SELECT segment.PID[3] AS pid FROM q"
    assert s.run(token["doc"], ask).value(0, 0) == "123456789" and s.run(token["reader"], ask).value(0, 0) == "[REDACTED]"
    # whatever the expression, the alias, the order or the redaction asked for; and no condition tells what is hidden
    for text in ("SELECT segment.PID[3] AS a FROM q", "SELECT segment.PID[5] AS msg_type FROM q"):
        assert s.run(token["reader"], text, OFF).value(0, 0) == "[REDACTED]"
    for text in ("SELECT * FROM q WHERE segment.PID[3] = '123456789'", "SELECT segment.MSH[3] AS a FROM q WHERE segment.MSH[3] = 'x' OR segment.PID[5] LIKE 'J%'"):
        assert s.run(token["reader"], text).code == 2 and s.run(token["doc"], text).code == 0
    assert "JONES" not in s.run(token["reader"], "SELECT * FROM q").text() and "JONES" in s.run(token["doc"], "SELECT * FROM q").text()
    assert s.run(token["nobody"], ask).code == -3 and s.run("no token", ask).code == -1 and s.run(token["doc"], "nonsense").code == 1
    assert s.run(token["reader"], "POP MESSAGE FROM q").code == -3 and s.run(token["doc"], "CLEAR HISTORY q").code == -3 and s.run(token["admin"], "CLEAR HISTORY q").code == 0
    rows = log.read().collect()
    assert len(rows) == 20 and sum(r.phi_accessed for r in rows) == 5 and log.verify().count() == 0
    assert not any("JONES" in json.dumps(r.asDict()) for r in rows)


# -- monitoring ---------------------------------------------------------------------------------------------------------
def test_detectors(spark):
    day = NOW - NOW % 86400
    rows = [(day + 3600 * h, u, f"10.0.0.{u}", ok, phi, n) for h, u, ok, phi, n in [(3, 1, True, True, 5), (12, 1, True, True, 5), (18, 2, True, True, 1), (3, 3, True, False, 0), (9, 4, False, False, 0), (9, 4, False, False, 0), (9, 4, False, False, 0)]]
    rows += [(day + 86400 * d + 40000, 9, "10.0.0.9", True, True, 100 if d == 9 else 1) for d in range(10)]
    log = spark.createDataFrame(rows, "timestamp bigint, user_id bigint, client_ip string, success boolean, phi_accessed boolean, phi_record_count bigint")
    assert sorted(r.user_id for r in monitor.after_hours(log).collect()) == [1, 2]
    assert [(r.client_ip, r.details) for r in monitor.brute_force(log, 3).collect()] == [("10.0.0.4", "3 failures of 10.0.0.4")] and monitor.brute_force(log, 4).count() == 0
    assert [(r.user_id, r.timestamp) for r in monitor.volume(log).collect()] == [(9, day + 86400 * 10)]
    events = monitor.brute_force(log, 3).unionByName(monitor.after_hours(log))
    rules = spark.createDataFrame([("brute_force", 2, "block_ip", "", True), ("after_hours_access", 2, "email", "", True), ("after_hours_access", 0, "log", "", False)], "event_type string, min_severity int, action string, config string, enabled boolean")
    assert [r.action for r in monitor.alerts(events, rules).collect()] == ["block_ip"] and [r.client_ip for r in monitor.blocked(events, rules).collect()] == ["10.0.0.4"]
    assert tuple(monitor.statistics(events).first())[:4] == (3, 0, 1, 2) and monitor.statistics(events.limit(0)).first().total_events == 0
    assert [(r.event_type, r.events) for r in monitor.report(events, 0, 2 * NOW).collect()] == [("brute_force", 1), ("after_hours_access", 2)]


# -- backups ------------------------------------------------------------------------------------------------------------
def test_backups(spark, tmp_path):
    clock = Clock()
    source = f"file://{tmp_path}/data"
    write_text(spark, f"{source}/a/one", "1")
    b = Backups(spark, source, f"file://{tmp_path}/backups", clock)
    assert b.due(10) and b.incremental().kind == "full"
    clock.now += 10
    write_text(spark, f"{source}/two", "2")
    second = b.incremental()
    assert second.kind == "incremental" and second.bytes == 1 and b.verify(second.backup_id)
    assert b.restore(second.backup_id, f"file://{tmp_path}/restored") == 2 and (tmp_path / "restored/a/one").read_text() == "1"
    assert b.rehearse(second.backup_id, f"file://{tmp_path}/rehearsal") and not (tmp_path / "rehearsal").exists()
    assert b.export(second.backup_id, f"file://{tmp_path}/dr") == 2 and b.listing().count() == 2
    clock.now += 40 * 86400
    third = b.full()
    clock.now += 1
    assert len(b.expire(30)) == 2 and [x.backup_id for x in b.all()] == [third.backup_id]
    (tmp_path / f"backups/{third.backup_id}/two").write_text("3")
    assert not b.verify(third.backup_id)
    with pytest.raises(ValueError):
        b.export(third.backup_id, f"file://{tmp_path}/dr2")
    # two files that change places show
    fourth = b.full()
    one, two = tmp_path / f"backups/{fourth.backup_id}/a/one", tmp_path / f"backups/{fourth.backup_id}/two"
    for path, text in ((one, two.read_text()), (two, one.read_text())):
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
        path.write_text(text)
    assert not b.verify(fourth.backup_id)
    log = spark.createDataFrame([(1,), (5,)], "timestamp bigint")
    assert b.archive(log, 3, f"{tmp_path}/archive") == 1


def test_backup_schedule(spark, tmp_path):
    clock = Clock()
    write_text(spark, f"file://{tmp_path}/data/one", "1")
    b = Backups(spark, f"file://{tmp_path}/data", f"file://{tmp_path}/backups", clock)
    stop = b.schedule(100, full_weekday=time.gmtime(NOW).tm_wday, keep_days=1, look_every=0.02)

    def wait(n):
        end = time.time() + 20
        while len(b.all()) < n and time.time() < end:
            time.sleep(0.05)
        return [x.kind for x in b.all()]

    try:
        assert wait(1) == ["full"]
        clock.now += 100
        assert wait(2) == ["full", "full"]
    finally:
        stop.set()
    assert isinstance(stop, threading.Event)


def test_manifest_pointer_and_old_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Manifest, "STEP", 2)
    m = Manifest(spark, f"file://{tmp_path}/m", kept=4)
    for n in range(12):
        assert m.commit(n, {"n": n + 1}) == n + 1
    assert m.read() == (12, {"n": 12}) and m.versions() == list(range(8, 13))
    for pointer in ("9", "", "77", "x"):  # behind, or caught half written
        write_text(spark, f"file://{tmp_path}/m/manifest.latest", pointer, overwrite=True)
        assert Manifest(spark, f"file://{tmp_path}/m").read()[0] == 12


# -- sources ------------------------------------------------------------------------------------------------------------
def test_readers(spark, tmp_path):
    (tmp_path / "m.hl7").write_text(ADT_JONES + "\n" + ORU_CBC + "\n", newline="")
    rows = readers.read_messages(spark, f"{tmp_path}/m.hl7").collect()
    assert [r.pid3 for r in rows] == ["123456789", "987654321"]
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a").write_text(ORU_CBC, newline="")
    assert readers.read_files(spark, f"{tmp_path}/one").first().num_segments == 6
    frame = spark.createDataFrame([(1, 5, ADT_JONES), (2, 6, ORU_CBC)], "msg_id long, timestamp long, raw_message string")
    readers.write_persisted(frame, f"{tmp_path}/lines", F.lit(b"0123456789abcdef"))
    readers.write_persisted(frame.limit(1), f"{tmp_path}/lines")
    assert readers.read_persisted(spark, f"{tmp_path}/lines", F.lit(b"0123456789abcdef")).count() == 3 and readers.read_persisted(spark, f"{tmp_path}/lines").count() == 1
    assert readers.file_stats(spark, f"{tmp_path}/lines").first().messages == 3
    readers.write_persisted(frame.limit(0), f"{tmp_path}/lines", mode="overwrite")
    assert readers.file_stats(spark, f"{tmp_path}/lines").first().messages == 0
    readers.write_persisted(frame, f"{tmp_path}/lines")
    readers.write_persisted(readers.read_persisted(spark, f"{tmp_path}/lines", parse=False).where("msg_id = 2"), f"{tmp_path}/lines", mode="overwrite")
    assert [r.msg_id for r in readers.read_persisted(spark, f"{tmp_path}/lines").collect()] == [2] and len([p for p in (tmp_path / "lines").iterdir() if p.is_dir()]) == 1
    assert readers.change_registry(spark, f"{tmp_path}/names", add=["b", "a"]) == ["a", "b"] and readers.change_registry(spark, f"{tmp_path}/names", ["c"], ["a", "x"]) == ["b", "c"]
    assert readers.index_list("PID-3, MSH-9,OBX-5") == {"pid3": ("PID", 3), "msh9": ("MSH", 9), "obx_5": ("OBX", 5)}


def test_import_of_a_persisted_folder(spark, tmp_path):
    root = tmp_path / "old/channels"
    for name, texts in (("admissions", [ADT_JONES]), ("lab", [ORU_CBC, "junk"])):
        lines = spark.createDataFrame([(i + 1, 7, t) for i, t in enumerate(texts)], "msg_id long, timestamp long, raw_message string")
        (root / name).mkdir(parents=True)
        (root / name / "messages.dat").write_text("\n".join(r.value for r in codec.to_lines(lines).collect()) + "\nbroken line\n")
    (root / "channels.dat").write_text("admissions\n\nlab\n")
    e = Engine(spark, f"file://{tmp_path}/store", clock=lambda: NOW)
    assert readers.import_persisted(e.store, str(tmp_path / "old")) == {"admissions": 1, "lab": 2}
    assert e.sql("SELECT segment.PID[3] AS p FROM lab WHERE segment.OBX[3] = 'WBC'").first().p == "987654321"


def test_config():
    c = readers.Config("[server]\nport = 2575\nhost = x\ntls = yes\nbad = 1x\n# note\n[storage]\nratio=0.5\n")
    assert c.whole("server", "port") == 2575 and c.text("server", "host") == "x" and c.flag("server", "tls") and c.whole("server", "bad", 9) == 9
    assert c.real("storage", "ratio") == 0.5 and c.text("none", "x", "d") == "d" and not c.flag("server", "host")


def test_frames(spark, tmp_path):
    data = readers.request_frame("SELECT 1") + readers.request_frame("é") + b"\0\0\0\x09abc"
    assert list(readers.read_requests(data)) == ["SELECT 1", "é"]
    for bad in ("", "x" * (readers.MAX_REQUEST + 1)):
        with pytest.raises(ValueError):
            readers.request_frame(bad)
    with pytest.raises(ValueError):
        list(readers.read_requests(b"\0\0\0\0"))
    e = Engine(spark, f"file://{tmp_path}/s")
    assert readers.answer(e, "CREATE QUEUE q") == readers.response_frame(0, "OK (0 rows)") and readers.answer(e, "x")[:4] == b"\0\0\0\1" and readers.answer(e, "DROP QUEUE r")[:4] == b"\0\0\0\2"


def test_web(spark, tmp_path):
    web = Web(Engine(spark, f"file://{tmp_path}/w", clock=lambda: NOW))
    web.engine.sql("CREATE QUEUE q")
    assert web.handle("GET", "/api/health") == (200, '{"status":"healthy","version":"1.0.0","features":["persistence","indexing"]}')
    message = json.dumps(ADT_JONES)
    assert web.handle("POST", "/api/insert", f'{{"queue":"q","message":{message}}}') == (200, '{"success":true,"message":"Message inserted successfully"}')
    for body, error in (("", "Missing request body"), ('{"queue":"q"}', "Missing message parameter"), ('{"message":"x"}', "Missing queue parameter"), ('{"queue":"r","message":%s}' % message, "Queue not found"), ('{"queue":"q","message":"x"}', "Invalid HL7 message")):
        assert web.handle("POST", "/api/insert", body) == (400, f'{{"error":"{error}"}}')
    assert web.handle("GET", "/api/queues")[1] == '{"queues":[{"name":"q","messages":1,"history":0}]}'
    assert web.handle("GET", "/api/statistics")[1] == '{"total_queues":1,"total_messages":1,"total_history":0,"grand_total":1}'
    asked = "SELECT+segment.PID%5B3%5D%20AS%20pid,%20segment.ZZZ%5B1%5D%20AS%20z%20FROM%20q"
    want = (200, '{"success":true,"rows_affected":0,"num_rows":1,"rows":[{"pid":"123456789","z":null}]}')
    assert web.handle("GET", f"/api/query?query={asked}") == web.handle("POST", "/api/query", f"query={asked}") == want
    assert web.handle("GET", "/api/query")[0] == 400 and json.loads(web.handle("GET", "/api/query?query=x")[1])["success"] is False and web.handle("GET", "/x")[0] == 404
    for sample in json.loads(web.handle("GET", "/api/samples")[1])["samples"]:
        assert web.handle("POST", "/api/insert", json.dumps({"queue": "q", "message": sample["message"]}))[0] == 200
    texts = ["plain", 'a"b\\c\r\n\t', "é\x01", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(json_text(F.col("t")).alias("j")).collect()
    assert [json.loads(r.j) for r in got] == texts


# -- streaming ----------------------------------------------------------------------------------------------------------
def lines(spark, path, start, texts):
    rows = spark.createDataFrame([(start + i, NOW, t) for i, t in enumerate(texts)], "msg_id long, timestamp long, raw_message string")
    readers.write_persisted(rows, path)


def test_stream_into_a_queue(spark, tmp_path):
    folder, e = f"{tmp_path}/in", Engine(spark, f"file://{tmp_path}/q", clock=lambda: NOW)
    e.sql("CREATE QUEUE q")
    lines(spark, folder, 1, [admission(1, "A"), admission(2, "B")])
    for n in (2, 3):
        q = ingest.into_queue(ingest.stream_messages(spark, folder), e.store, "q", f"{tmp_path}/cp")
        q.awaitTermination()
        assert e.store.size("q") == n
        lines(spark, folder, 3, [admission(3, "C")]) if n == 2 else None
    taken = []
    assert ingest.consume(e.store, "q", lambda df: taken.append(df.count()), 2) == 3 and taken == [2, 1]


def test_routing_and_windows(spark, tmp_path):
    folder, seen = f"{tmp_path}/in", {"ADT": 0, "ORU": 0, "rest": 0}
    lines(spark, folder, 1, [ADT_JONES, ORU_CBC, ORU_CBC, "junk"])

    def count(name):
        return lambda df, _: seen.update({name: seen[name] + df.count()})

    stream = ingest.stream_messages(spark, folder, numbering="standard")
    ingest.route(stream, {"ADT": count("ADT"), "ORU": count("ORU")}, f"{tmp_path}/cp", otherwise=count("rest")).awaitTermination()
    assert seen == {"ADT": 1, "ORU": 2, "rest": 1}
    for name, frame in (("counted", ingest.counts(stream)), ("sessioned", ingest.sessions(stream))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.msg_type_code, r.messages) for r in spark.table("counted").where("start IS NOT NULL").collect()) == [("ADT", 1), ("ORU", 2)]
    assert sorted((r.pid3, r.messages) for r in spark.table("sessioned").where("start IS NOT NULL").collect()) == [("123456789", 1), ("987654321", 2)]


def test_a_message_just_a_gap_later_begins_another_session(spark, tmp_path):
    from pipehat import service_queries
    from pipehat.queries import ORACLES

    times = [(1, 0), (1, 86399), (1, 86399 + 86400), (2, 0), (2, 0), (2, 86400), (2, 2 * 86400 + 1), (3, 5)]
    rows = [(i, u, t, "view", 1.0, "{}") for i, (u, t) in enumerate(times)]
    frame = spark.createDataFrame(rows, "event_id bigint, user_id bigint, at bigint, event_type string, value double, props string")
    frame.withColumn("ts", F.timestamp_seconds(F.col("at") + NOW).cast("timestamp_ntz")).drop("at").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in service_queries.session_windows(spark, str(tmp_path)).collect())
    assert got == [("1", NOW, NOW + 86399 + 86400, 2), ("1", NOW + 86399 + 86400, NOW + 86399 + 2 * 86400, 1), ("2", NOW, NOW + 86400, 2), ("2", NOW + 86400, NOW + 2 * 86400, 1), ("2", NOW + 2 * 86400 + 1, NOW + 3 * 86400 + 1, 1), ("3", NOW + 5, NOW + 86405, 1)]
    with duckdb.connect() as duck:
        duck.sql("SET timezone = 'UTC'")
        duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(duck.sql(ORACLES["session_windows"]).fetchall())
