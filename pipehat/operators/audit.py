"""The audit log: append, filter, count, verify, export."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipehat.operators.chain import Chain, linked
from pipehat.runtime import remove
from pipehat.storage import Conflict, Manifest, exists, read_text, write_text

SEVERITIES = ("debug", "info", "warning", "error", "critical")
FIELDS = {
    "event_id": "bigint", "timestamp": "bigint", "event_type": "string", "severity": "int", "user_id": "bigint", "username": "string", "session_token": "string",
    "client_ip": "string", "hostname": "string", "resource": "string", "resource_type": "string", "action": "string", "details": "string", "success": "boolean",
    "error_code": "int", "phi_accessed": "boolean", "phi_record_count": "bigint",
}
CHAIN = {"payload_hash": "string", "checksum": "string", "previous_event_id": "bigint"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in (FIELDS | CHAIN).items())


@dataclass(frozen=True)
class AuditFilter:
    """None (or 0 for max_results) leaves a condition out. Times are seconds, both ends included."""

    start: int | None = None
    end: int | None = None
    user_id: int | None = None
    username: str | None = None
    event_type: str | None = None
    min_severity: int | None = None
    phi_only: bool = False
    resource: str | None = None
    success: bool | None = None
    max_results: int = 0


def matching(log: DataFrame, f: AuditFilter) -> DataFrame:
    """The log's rows that pass; with max_results the first of those by event id."""
    conditions: list[Column] = []
    if f.start is not None:
        conditions.append(F.col("timestamp") >= f.start)
    if f.end is not None:
        conditions.append(F.col("timestamp") <= f.end)
    for name in ("user_id", "username", "event_type", "resource", "success"):
        if (v := getattr(f, name)) is not None:
            conditions.append(F.col(name) == v)
    if f.min_severity is not None:
        conditions.append(F.col("severity") >= f.min_severity)
    if f.phi_only:
        conditions.append(F.col("phi_accessed"))
    for c in conditions:
        log = log.where(c)
    return log.orderBy("event_id").limit(f.max_results) if f.max_results else log


def statistics(log: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row: total_events, phi_accesses, failures, unique_users in a range of times."""
    return matching(log, AuditFilter(start, end)).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("phi_accessed")).alias("phi_accesses"),
        F.count_if(~F.col("success")).alias("failures"),
        F.count_distinct("user_id").alias("unique_users"),
    )


def payload_hash(columns: Iterable[str] = FIELDS) -> Column:
    """SHA-256 of a row's fields as JSON in order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def chained(rows: DataFrame, columns: Iterable[str] = FIELDS, first: str = "") -> DataFrame:
    """rows with payload_hash, previous_event_id and checksum, by the hash chain of chain.py over ascending event ids, which may
    have gaps: every checksum depends on all events before it. Event ids are unique."""
    hashed = rows.withColumn("payload_hash", payload_hash(columns))
    links = linked(hashed.select(F.col("event_id").alias("id"), F.col("payload_hash").alias("hash")), first)
    return hashed.join(links.select(F.col("id").alias("event_id"), F.col("previous_id").alias("previous_event_id"), "checksum"), "event_id")


def broken(log: DataFrame, columns: Iterable[str] = FIELDS, first: str = "") -> DataFrame:
    """(event_id, problem) of rows that don't fit: `changed` fields, or a `link`: a checksum that isn't that of the kept hashes
    up to there. A changed row shows as such alone; where its hash was changed to match, or a row was taken out or put in,
    every later row shows."""
    links = linked(log.select(F.col("event_id").alias("id"), F.col("payload_hash").alias("hash")), first)
    joined = log.withColumn("now_hash", payload_hash(columns)).join(links.select(F.col("id").alias("event_id"), F.col("checksum").alias("now_sum")), "event_id")
    problem = F.when(~F.col("now_hash").eqNullSafe(F.col("payload_hash")), "changed").when(~F.col("now_sum").eqNullSafe(F.col("checksum")), "link")
    return joined.select("event_id", problem.alias("problem")).where("problem IS NOT NULL")


class AuditLog:
    """Events below a shared folder, in batches that a manifest numbers; nothing is ever changed."""

    def __init__(self, spark: SparkSession, root: str, clock=time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.manifest = Manifest(spark, f"{self.root}/manifest")

    def append(self, events: list[dict]) -> list[int]:
        """Add a few events in order; their ids."""
        import hashlib

        names = list(FIELDS)
        while True:
            version, doc = self.manifest.read()
            n, last, chain = doc.get("last_id", 0), doc.get("last_checksum", ""), Chain(doc.get("chain"))
            rows = []
            for e in events:
                n += 1
                row = {k: None for k in names} | {"timestamp": int(self.clock()), "severity": 1, "user_id": 0, "success": True, "error_code": 0, "phi_accessed": False, "phi_record_count": 0} | e | {"event_id": n}
                text = json.dumps({k: row[k] for k in names}, separators=(",", ":"), ensure_ascii=False)
                own = hashlib.sha256(text.encode()).hexdigest()
                last = chain.add(n, own)
                rows.append(tuple(row[k] for k in names) + (own, last, n - 1 if n > 1 else None))
            batch = uuid.uuid4().hex
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{self.root}/log/{batch}")
            try:
                self.manifest.commit(version, {"last_id": n, "last_checksum": last, "chain": chain.state, "batches": [*doc.get("batches", []), batch]})
                return [r[0] for r in rows]
            except Conflict:
                remove(self.spark, f"{self.root}/log/{batch}")

    def read(self) -> DataFrame:
        batches = self.manifest.read()[1].get("batches", [])
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.root}/log/{b}" for b in batches))

    def query(self, f: AuditFilter) -> DataFrame:
        return matching(self.read(), f)

    def statistics(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return statistics(self.read(), start, end)

    def verify(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """broken() rows with ids from low to high, both included; also a missing first or last event shows, by the manifest's
        last id, and a last checksum other than the manifest's."""
        log, doc = self.read(), self.manifest.read()[1]
        last = doc.get("last_id", 0)
        ends = self.spark.createDataFrame([(1,), (last,)] if last else [], "event_id bigint").distinct()
        lost = ends.join(log.select("event_id"), "event_id", "left_anti").withColumn("problem", F.lit("missing"))
        other = log.where((F.col("event_id") == last) & (F.col("checksum") != doc.get("last_checksum", ""))).select("event_id", F.lit("link").alias("problem"))
        found = broken(log).unionByName(lost).unionByName(other).distinct()
        return found.where(F.col("event_id").between(1 if low is None else low, last if high is None else high))

    def compact(self, files: int = 1) -> None:
        """Rewrite all batches as one; readers of an earlier version have to read again."""
        version, doc = self.manifest.read()
        old, batch = doc.get("batches", []), uuid.uuid4().hex
        if len(old) < 2:
            return
        self.read().repartitionByRange(files, "event_id").sortWithinPartitions("event_id").write.parquet(f"{self.root}/log/{batch}")
        try:
            self.manifest.commit(version, doc | {"batches": [batch]})
        except Conflict:  # someone has appended: another time
            remove(self.spark, f"{self.root}/log/{batch}")
            return
        remove(self.spark, *(f"{self.root}/log/{b}" for b in old))

    def export(self, path: str, start: int | None = None, end: int | None = None, form: str = "json") -> None:
        """The events of a range of times as JSON lines or CSV."""
        writer = matching(self.read(), AuditFilter(start, end)).write.mode("overwrite")
        writer.option("header", True).csv(path) if form == "csv" else writer.json(path)

    def seal(self, path: str) -> None:
        """Write the last id and checksum, which all events up to there enter, to a file elsewhere, to compare with later."""
        doc = self.manifest.read()[1]
        write_text(self.spark, path, json.dumps({k: doc.get(k) for k in ("last_id", "last_checksum")}), overwrite=True)

    def sealed_is_kept(self, path: str) -> bool:
        """Whether the log still holds all events up to the one a seal names, unchanged."""
        if not exists(self.spark, path):
            return False
        seal = json.loads(read_text(self.spark, path))
        if not seal["last_id"]:
            return True
        kept = self.read().where(F.col("event_id") <= seal["last_id"])
        named = kept.where((F.col("event_id") == seal["last_id"]) & (F.col("checksum") == seal["last_checksum"]))
        return bool(named.take(1)) and broken(kept).isEmpty()
