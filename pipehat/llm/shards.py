"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Compaction puts shards of similar size together in tiers and merges
every tier with enough of them into files of the target size; Spark's own packing of small files into read partitions makes
each merge a scan and a write, without a shuffle. A merge takes at most MERGE_BYTES of shards; what a tier holds beyond that
follows in further merges. Shards of at least half the target size are left alone.

A version's manifest names lists of shards and, for each list, how many shards and bytes it has in each tier. A list is a small
immutable file of at most LIST_SHARDS shards; an append adds lists of its own shards and a manifest of the lists' names, so a
commit doesn't grow with all shards. Compaction reads and replaces only the lists that have shards in its tier, and packs small lists together.
Manifests are written beside their place and renamed there, which fails if that version exists, so that readers see whole
versions only and of two writers one starts again. Old versions stay readable until vacuum().

Defined results: rows keep all columns and values, nulls and repeats included; an empty arrival commits a version without new
shards; a store without arrivals has version 0 and no rows to read.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pipehat.runtime import hadoop_path, remove
from pipehat.storage import Conflict, Manifest, read_text, write_text

TARGET_BYTES, TIER_WIDTH, LEAST_RUN = 128 << 20, 4.0, 4
MERGE_BYTES, LIST_SHARDS = 64 << 30, 5_000


class ShardStore:
    """Shards, lists and manifests below one folder of a file system that all executors share."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        target_bytes: int = TARGET_BYTES,
        tier_width: float = TIER_WIDTH,
        least_run: int = LEAST_RUN,
        merge_bytes: int = MERGE_BYTES,
        list_shards: int = LIST_SHARDS,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.tier_width, self.least_run, self.merge_bytes, self.list_shards = target_bytes, tier_width, least_run, merge_bytes, list_shards
        self.manifests = Manifest(spark, f"{self.root}/manifests", "v", kept=None)
        self.fs = self.manifests.fs

    # -- manifests ------------------------------------------------------------------------------------------------
    def _path(self, name: str):
        return hadoop_path(self.spark, f"{self.root}/{name}")[1]

    def versions(self) -> list[int]:
        return self.manifests.versions()

    def manifest(self, version: int | None = None) -> dict:
        """{'version', 'schema', 'lists': [{'path', 'tiers': {tier: shards}}]} of a version, the newest unless told."""
        version, doc = self.manifests.read(version)
        return {"version": version, "schema": doc.get("schema"), "lists": doc.get("lists", [])}

    def commit(self, base: int, schema: str | None, lists: list[dict]) -> int:
        """Make the version after base; Conflict if it exists."""
        return self.manifests.commit(base, {"schema": schema, "lists": lists})

    def shards(self, lists: Iterable[dict]) -> list[dict]:
        """[{'path', 'bytes', 'rows', 'tier'}] of some lists."""
        return [s for x in lists for s in json.loads(read_text(self.spark, f"{self.root}/{x['path']}"))]

    def _lists(self, shards: Sequence[dict]) -> list[dict]:
        """Lists written for these shards."""
        out = []
        for at in range(0, len(shards), self.list_shards):
            some, path = shards[at : at + self.list_shards], f"lists/{uuid.uuid4().hex}.json"
            write_text(self.spark, f"{self.root}/{path}", json.dumps(some))
            out.append({"path": path, "tiers": {str(t): n for t, n in Counter(s["tier"] for s in some).items()}})
        return out

    # -- shards ---------------------------------------------------------------------------------------------------
    def tier(self, size: int) -> int:
        """Tiers grow by tier_width downwards from the target size; 0 holds what needs no merging."""
        n, bound = 0, self.target_bytes / 2
        while size < bound:
            n, bound = n + 1, bound / self.tier_width
        return n

    def _listed(self, folder: str) -> list[dict]:
        """The shards written to a folder, with rows counted from their footers."""
        sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        found = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).count().collect()
        rows = {r["name"]: r["count"] for r in found}
        for name in sizes.keys() - rows.keys():  # files without rows
            self.fs.delete(self._path(f"{folder}/{name}"), False)
        return [{"path": f"{folder}/{n}", "bytes": sizes[n], "rows": rows[n], "tier": self.tier(sizes[n])} for n in sorted(rows)]

    def append(self, df: DataFrame, rows_per_shard: int = 0) -> int:
        """Add the rows as shards of at most rows_per_shard rows, one or more for each partition; the new version."""
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_per_shard).parquet(f"{self.root}/{folder}")
        new = self._lists(self._listed(folder))
        while True:
            now = self.manifest()
            try:
                return self.commit(now["version"], now["schema"] or df.schema.json(), now["lists"] + new)
            except Conflict:
                continue

    def runs(self, shards: Sequence[dict]) -> list[list[dict]]:
        """Shards of one tier to merge together, those of the smallest tiers first: enough of them, and at most merge_bytes."""
        tiers: dict[int, list[list[dict]]] = {}
        for s in shards:
            runs = tiers.setdefault(s["tier"], [[]])
            if runs[-1] and sum(x["bytes"] for x in runs[-1]) + s["bytes"] > self.merge_bytes:
                runs.append([])
            runs[-1].append(s)
        return [r for t in sorted(tiers, reverse=True) if t for r in tiers[t] if len(r) >= self.least_run]

    def merge(self, run: Sequence[dict], schema: str) -> list[dict]:
        """Write the rows of the run's shards to files of about the target size."""
        # a session of its own, whose settings no other thread sees
        session, folder = self.spark.newSession(), f"shards/{uuid.uuid4().hex}"
        for k, v in {"spark.sql.files.maxPartitionBytes": self.target_bytes, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1}.items():
            session.conf.set(k, str(v))
        session.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(f"{self.root}/{s['path']}" for s in run)).write.parquet(f"{self.root}/{folder}")
        return self._listed(folder)

    def compact(self) -> int:
        """Merge tiers until none has a run whose merge lessens its shards; the version then."""
        tried: set[frozenset[str]] = set()
        while True:
            now = self.manifest()
            run = self._next_run(now, tried)
            if run is None:
                return now["version"]
            merged, gone = self.merge(run, now["schema"]), {s["path"] for s in run}
            tried.add(frozenset(s["path"] for s in merged))
            if len(merged) >= len(run):
                tried.add(frozenset(gone))
                remove(self.spark, *(f"{self.root}/{s['path']}" for s in merged))
            elif not self._replace(gone, run[0]["tier"], merged):
                remove(self.spark, *(f"{self.root}/{s['path']}" for s in merged))

    def _next_run(self, now: dict, tried: set[frozenset[str]]) -> list[dict] | None:
        counts: Counter[int] = Counter()
        for x in now["lists"]:
            counts.update({int(t): n for t, n in x["tiers"].items()})
        for tier in sorted(counts, reverse=True):
            if tier and counts[tier] >= self.least_run:
                held = [s for s in self.shards(x for x in now["lists"] if str(tier) in x["tiers"]) if s["tier"] == tier]
                for run in self.runs(held):
                    if frozenset(s["path"] for s in run) not in tried:
                        return run
        return None

    def _replace(self, gone: set[str], tier: int, merged: list[dict]) -> bool:
        """Commit merged shards in place of those gone, all of one tier. Appends may come between; False if another compaction
        has taken any of them."""
        while True:
            now = self.manifest()
            touched = [x for x in now["lists"] if str(tier) in x["tiers"]]
            held = self.shards(touched)
            if not gone <= {s["path"] for s in held}:
                return False
            kept = [x for x in now["lists"] if x not in touched]
            small = [x for x in kept if sum(x["tiers"].values()) < self.list_shards // 4]
            if len(small) > 32:  # many appends' short lists become a few long ones
                held, kept = held + self.shards(small), [x for x in kept if x not in small]
            new = self._lists([s for s in held if s["path"] not in gone] + merged)
            try:
                self.commit(now["version"], now["schema"], kept + new)
                return True
            except Conflict:
                remove(self.spark, *(f"{self.root}/{x['path']}" for x in new))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless told."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise LookupError("nothing has been appended")
        schema, shards = StructType.fromJson(json.loads(m["schema"])), self.shards(m["lists"])
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in shards))

    def vacuum(self) -> int:
        """Delete the versions before the newest, and the lists and shards that only they name; how many shards went."""
        newest = self.manifest()
        lists, kept, gone = {x["path"] for x in newest["lists"]}, {s["path"] for s in self.shards(newest["lists"])}, set()
        old: dict[str, dict] = {}
        for v in self.versions():
            if v != newest["version"]:
                old |= {x["path"]: x for x in self.manifest(v)["lists"] if x["path"] not in lists}
                self.manifests.drop(v)
        gone = {s["path"] for s in self.shards(old.values())} - kept
        remove(self.spark, *(f"{self.root}/{p}" for p in (*gone, *old)))
        return len(gone)
