"""Named first-in-first-out queues with a history, over an append-only log.

A queue is a range of sequence numbers. Its messages lie in Parquet batches below `data/`; a batch's name in the manifest tells
the numbers of its first row and its length. The manifest says where the queue begins (head), ends (tail) and where its
history begins. POP, CLEAR HISTORY and DROP only
move these numbers, so each is one small commit however long the queue is, and a query pins one version of the manifest.

Ids never change. `seq` is dense within a queue; `msg_id` is dense over all queues, from 1.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipehat.functions import hl7
from pipehat.runtime import remove
from pipehat.storage import Conflict, Manifest, exists, size_of

#: Up to so many batches, a row of numbers each, their table is broadcast.
BROADCAST_BATCHES = 100_000
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("msg_id", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("raw_message", T.StringType()),
        T.StructField("enc", T.StructType([T.StructField(n, T.StringType()) for n in ("field", "component", "repetition", "escape", "subcomponent")])),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("idx", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType()))]))),
        T.StructField("parse_errors", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("num_segments", T.IntegerType()),
        T.StructField("msg_type", T.StringType()),
        T.StructField("msg_type_code", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("msh7_ts", T.LongType()),
        T.StructField("queue", T.StringType()),
    ]
)


class QueueProblem(ValueError):
    """A queue operation that can't be done; code is -1 (missing, existing) or -2 (not empty, history full, bad name)."""

    def __init__(self, text: str, code: int = -1):
        super().__init__(text)
        self.code = code


@dataclass
class QueueState:
    """head <= seq < tail are active, history <= seq < head past, without the ranges [from, to) in lost."""

    head: int = 0
    tail: int = 0
    history: int = 0
    lost: list[list[int]] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)

    @property
    def active_size(self) -> int:
        return self.tail - self.head

    def lose(self, low: int, high: int) -> None:
        """Put [low, high) neither here nor there; ranges come in rising order."""
        if self.lost and self.lost[-1][1] == low:
            self.lost[-1][1] = high
        elif high > low:
            self.lost.append([low, high])

    def forget(self, n: int) -> None:
        """Forget the oldest n past messages."""
        self.skip()
        while n > 0 and self.history < self.head:
            step = min(n, (self.lost[0][0] if self.lost else self.head) - self.history)
            self.history, n = self.history + step, n - step
            self.skip()

    def take(self, n: int, limit: int, rotate: bool, lossy: bool) -> int:
        """Pop up to n messages; how many of them were taken, from the old head on. limit 0 means none."""
        n, start, room = min(n, self.active_size), self.head, max(0, limit - self.history_size)
        kept = n if not limit or rotate else min(n, room)
        self.head += n if lossy else kept
        self.lose(start + kept, self.head)
        if limit and rotate:
            self.forget(max(0, kept - room))  # one for each that comes
        return kept

    def skip(self) -> None:
        while self.lost and self.lost[0][0] <= self.history:
            self.history = max(self.history, self.lost.pop(0)[1])

    @property
    def history_size(self) -> int:
        return self.head - self.history - sum(b - a for a, b in self.lost)


class QueueStore:
    """Queues below a folder that all executors share. history_limit 0 means none. indexed: fields kept as columns of their own,
    by the columns' names, the usual ones unless told; a store keeps to what it was made with."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        numbering: str = "as_coded",
        history_limit: int = 0,
        rotate: bool = False,
        lossy_reject: bool = False,
        clock: Callable[[], float] = time.time,
        indexed: Mapping[str, tuple[str, int]] | None = None,
    ):
        self.spark, self.root, self.numbering, self.clock, self.lossy_reject = spark, root.rstrip("/"), numbering, clock, lossy_reject
        self.manifest = Manifest(spark, f"{self.root}/manifest")
        version, state = self.manifest.read()
        fields = hl7.SHREDDED[numbering] if indexed is None or version else indexed
        usual = {k: list(v) for k, v in fields.items() if k != "msh7"}
        if version == 0:
            state = {"queues": {}, "next_id": 1, "history_limit": history_limit, "rotate": rotate, "indexed": usual}
            self.manifest.commit(0, state)
        self.indexed = {k: tuple(v) for k, v in state.get("indexed", usual).items()}  # older stores have the usual ones
        self.schema = T.StructType([*LOG_SCHEMA.fields[:-1], *(T.StructField(k, T.StringType()) for k in self.indexed), LOG_SCHEMA.fields[-1]])

    # -- state --------------------------------------------------------------------------------------------------------
    def state(self, version: int | None = None) -> tuple[int, dict]:
        version, doc = self.manifest.read(version)
        doc["queues"] = {k: QueueState(**v) for k, v in doc["queues"].items()}
        return version, doc

    def change(self, edit: Callable[[dict], object]):
        """Apply edit to the newest state and commit, again from the start if another writer was first."""
        while True:
            version, doc = self.state()
            out = edit(doc)
            try:
                self.manifest.commit(version, doc | {"queues": {k: vars(v) for k, v in doc["queues"].items()}})
                return out
            except Conflict:
                continue

    @staticmethod
    def _queue(doc: dict, name: str) -> QueueState:
        if name not in doc["queues"]:
            raise QueueProblem(f"queue {name} doesn't exist")
        return doc["queues"][name]

    def names(self) -> list[str]:
        return sorted(self.state()[1]["queues"])

    def has(self, name: str) -> bool:
        return name in self.state()[1]["queues"]

    def is_empty(self, name: str) -> bool:
        """Whether an existing queue has no active message; a missing queue isn't empty."""
        q = self.state()[1]["queues"].get(name)
        return q is not None and q.active_size == 0

    def size(self, name: str) -> int:
        return self._queue(self.state()[1], name).active_size

    def history_size(self, name: str) -> int:
        q = self.state()[1]["queues"].get(name)
        return q.history_size if q else 0

    def set_history_config(self, limit: int, rotate: bool) -> None:
        """Lowering the limit trims nothing by itself."""
        self.change(lambda doc: doc.update(history_limit=limit, rotate=rotate))

    # -- queues -------------------------------------------------------------------------------------------------------
    def create(self, name: str) -> None:
        if not NAME.fullmatch(name or ""):
            raise QueueProblem(f"not a queue name: {name!r}", -2)

        def edit(doc):
            if name in doc["queues"]:
                raise QueueProblem(f"queue {name} exists")
            doc["queues"][name] = QueueState()

        self.change(edit)

    def drop(self, name: str) -> None:
        """Only an empty queue; its history goes with it."""
        gone: list[str] = []

        def edit(doc):
            if self._queue(doc, name).active_size:
                raise QueueProblem(f"queue {name} isn't empty", -2)
            gone[:] = doc["queues"].pop(name).batches

        self.change(edit)
        remove(self.spark, *(self._batch(name, b) for b in gone))

    # -- messages -----------------------------------------------------------------------------------------------------
    def insert(self, queue: str, raw: str, timestamp: int | None = None) -> int:
        """One message; its id. Two-character escapes of CR are read as CR if the text has no real one."""
        if "\r" not in raw and "\\r" in raw:
            raw = raw.replace("\\r", "\r")
        t = int(self.clock()) if timestamp is None else timestamp
        self._queue(self.state()[1], queue)
        row, batch = self.spark.createDataFrame([(raw, t, 0)], "raw_message string, timestamp bigint, offset bigint"), uuid.uuid4().hex
        hl7.parse(row, numbering=self.numbering, shred=self.indexed).coalesce(1).write.parquet(f"{self.root}/data/{batch}/q={queue}")

        def edit(doc):
            state = self._queue(doc, queue)
            n = doc["next_id"]
            state.batches.append(f"{batch}/q={queue}-{state.tail}-{n}-1")
            state.tail += 1
            doc["next_id"] += 1
            return n

        try:
            return self.change(edit)
        except QueueProblem:  # dropped meanwhile
            remove(self.spark, f"{self.root}/data/{batch}")
            raise

    def insert_frame(self, queue: str, df: DataFrame, order_by: Sequence[Column | str], also: Callable[[dict], object] | None = None) -> tuple[int, int]:
        """All rows of df (raw_message and, if it has it, timestamp), in the given order; (first id, number). `also` edits the
        manifest in the same commit.

        Rows are dealt into ranges of the order and written as they are; the ranges' sizes then give each row its place.
        """
        self._queue(self.state()[1], queue)
        name = F.lit(queue)
        return self._insert(df, name, order_by, also).get(queue) or (self.state()[1]["next_id"], 0)

    def insert_dealt(self, df: DataFrame, by: str, order_by: Sequence[Column | str]) -> dict[str, tuple[int, int]]:
        """All rows of df into the queues that its column `by` names, in one pass and one commit; (first id, number) of each
        queue that got any."""
        return self._insert(df, F.col(by).cast("string"), order_by, None)

    def _insert(self, df: DataFrame, queue: Column, order_by: Sequence[Column | str], also: Callable[[dict], object] | None) -> dict[str, tuple[int, int]]:
        order = F.struct(*order_by) if order_by else F.lit(0)
        kept = df.select(queue.alias("q"), "raw_message", (F.col("timestamp").cast("bigint") if "timestamp" in df.columns else F.lit(int(self.clock()))).alias("timestamp"), order.alias("o"))
        if order_by:
            # the whole row breaks ties, so that the order doesn't hang on how rows lie
            keys = [F.col(c) for c in ("q", "o", "timestamp", "raw_message")]
            kept = kept.repartitionByRange(*keys).sortWithinPartitions(*keys)
        staged, batch = f"{self.root}/staged/{uuid.uuid4().hex}", uuid.uuid4().hex
        kept.select("q", "raw_message", "timestamp", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        # a queue's rows lie one after the other, in a partition and from one to the next
        counts = sorted((r.q, r.part, r.first, r.n) for r in rows.groupBy("q", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).collect())
        total: dict[str, int] = {}
        shifts = []
        for q, part, first, n in counts:
            shifts.append((q, part, total.get(q, 0) - first))
            total[q] = total.get(q, 0) + n
        try:
            doc = self.state()[1]
            for q in total:
                self._queue(doc, q)
            if total:
                shift = self.spark.createDataFrame(shifts, "q string, part int, shift bigint")
                rows = rows.join(F.broadcast(shift), ["q", "part"]).withColumn("offset", F.col("place") + F.col("shift")).drop("part", "place", "shift")
                hl7.parse(rows, numbering=self.numbering, shred=self.indexed).write.partitionBy("q").parquet(f"{self.root}/data/{batch}")

            def edit(doc):
                out = {}
                for q, n in total.items():
                    state = self._queue(doc, q)
                    # numbers must be known before the rows are written and may change until the commit, so rows keep their
                    # offset and the batch's name carries the numbers
                    state.batches.append(f"{batch}/q={q}-{state.tail}-{doc['next_id']}-{n}")
                    out[q] = doc["next_id"], n
                    state.tail += n
                    doc["next_id"] += n
                if also:
                    also(doc)
                return out

            return self.change(edit) if total or also else {}
        except QueueProblem:  # a queue isn't there, or was dropped meanwhile
            remove(self.spark, f"{self.root}/data/{batch}")
            raise
        finally:
            remove(self.spark, staged)

    def _batch(self, queue: str, batch: str) -> str:
        return f"{self.root}/data/{batch.split('-')[0]}"

    def messages(self, doc: dict, wanted: dict[str, tuple[int, int]], lost: dict[str, list[list[int]]] | None = None) -> DataFrame:
        """Rows of the queues' ranges of seq [from, to); batches outside the ranges aren't opened."""
        parts = []
        for name, (low, high) in sorted(wanted.items()):
            for b in doc["queues"][name].batches:
                _, first_seq, first_id, n = b.split("-")
                first_seq, first_id, n = int(first_seq), int(first_id), int(n)
                if first_seq < high and first_seq + n > low:
                    parts.append((name, self._batch(name, b), first_seq, first_id, max(low, first_seq) - first_seq, min(high, first_seq + n) - first_seq))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        # one scan of all batches; a small table by folder gives each its queue and numbers
        table = {p[1].rsplit("/data/", 1)[1]: p for p in parts}
        rows = self.spark.read.schema(T.StructType([*(f for f in self.schema if f.name not in ("seq", "msg_id", "queue")), T.StructField("offset", T.LongType())])).parquet(*(p[1] for p in parts))
        if len(parts) == 1:
            name, _, first_seq, first_id, low, high = parts[0]
            rows = rows.where(F.col("offset").between(low, high - 1)).withColumns({"seq": F.col("offset") + first_seq, "msg_id": F.col("offset") + first_id, "queue": F.lit(name)})
        else:
            info = self.spark.createDataFrame([(k, p[0], p[2], p[3], p[4], p[5]) for k, p in table.items()], "folder string, queue string, first_seq bigint, first_id bigint, low bigint, high bigint")
            rows = rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "^.*/data/(.*)/[^/]+$", 1)).join(F.broadcast(info) if len(parts) <= BROADCAST_BATCHES else info, "folder")
            rows = rows.where("offset >= low AND offset < high").withColumns({"seq": F.col("offset") + F.col("first_seq"), "msg_id": F.col("offset") + F.col("first_id")})
        gone = [(name, low, high) for name, ranges in (lost or {}).items() for low, high in ranges]
        if gone:
            ranges = F.array(*(F.struct(F.lit(q).alias("queue"), F.lit(low).alias("low"), F.lit(high).alias("high")) for q, low, high in gone))
            rows = rows.where(~F.exists(ranges, lambda r: (r["queue"] == F.col("queue")) & (r["low"] <= F.col("seq")) & (F.col("seq") < r["high"])))
        return rows.select(*self.schema.fieldNames())

    def active(self, name: str, version: int | None = None) -> DataFrame:
        doc = self.state(version)[1]
        q = self._queue(doc, name)
        return self.messages(doc, {name: (q.head, q.tail)})

    def history(self, name: str, version: int | None = None) -> DataFrame:
        doc = self.state(version)[1]
        q = self._queue(doc, name)
        return self.messages(doc, {name: (q.history, q.head)}, {name: q.lost})

    def positions(self, name: str, version: int | None = None) -> DataFrame:
        """The active messages with position: 1 for the oldest. Numbers are dense, so no window is needed."""
        version, doc = self.state(version)
        return self.active(name, version).withColumn("position", F.col("seq") - (self._queue(doc, name).head - 1))

    def everything(self, version: int | None = None) -> DataFrame:
        """The active messages of all queues."""
        doc = self.state(version)[1]
        return self.messages(doc, {k: (q.head, q.tail) for k, q in doc["queues"].items()})

    def get(self, name: str, msg_id: int) -> DataFrame:
        return self.active(name).where(F.col("msg_id") == msg_id)

    def pop(self, name: str, n: int = 1) -> DataFrame:
        """The oldest n active messages, now history. With a full history that doesn't rotate they stay, or with lossy_reject
        go nowhere, and nothing is returned; a rotating history loses its oldest message for each one that comes."""
        taken: list[tuple[int, int]] = []

        def edit(doc):
            q = self._queue(doc, name)
            start = q.head
            taken[:] = [(start, start + q.take(n, doc["history_limit"], doc["rotate"], self.lossy_reject))]

        self.change(edit)
        return self.messages(self.state()[1], {name: taken[0]})

    def clear_history(self, name: str) -> int:
        """Forget the history for good; how many messages it had. Batches nothing names any more are deleted."""
        gone: list[str] = []

        def edit(doc):
            q = self._queue(doc, name)
            size = q.history_size
            q.history, q.lost = q.head, []
            over = lambda b: int(b.split("-")[1]) + int(b.split("-")[3]) <= q.history
            gone[:] = [b for b in q.batches if over(b)]
            q.batches = [b for b in q.batches if not over(b)]
            return size

        out = self.change(edit)
        remove(self.spark, *(self._batch(name, b) for b in gone))
        return out

    def clear(self, name: str) -> None:
        """Drop all active messages without a trace."""

        def edit(doc):
            q = self._queue(doc, name)
            q.lose(q.head, q.tail)
            q.head = q.tail
            q.skip()

        self.change(edit)

    def statistics(self) -> DataFrame:
        """(queue, messages, history, total) of every queue."""
        doc = self.state()[1]
        rows = [(k, q.active_size, q.history_size, q.active_size + q.history_size) for k, q in sorted(doc["queues"].items())]
        return self.spark.createDataFrame(rows, "queue string, messages bigint, history bigint, total bigint")

    def compact(self, name: str, file_bytes: int = 128 << 20) -> None:
        """Rewrite runs of a queue's batches whose ids follow one another as one batch each, in files of about file_bytes; numbers
        stay as they are."""
        doc = self.state()[1]
        q = self._queue(doc, name)
        runs: list[list[tuple[int, int, int, str]]] = []
        for b in sorted(q.batches, key=lambda b: int(b.split("-")[1])):
            s, i, n = map(int, b.split("-")[1:])
            if runs and (x := runs[-1][-1])[0] + x[2] == s and x[1] + x[2] == i:
                runs[-1].append((s, i, n, b))
            else:
                runs.append([(s, i, n, b)])
        merged: dict[str, str] = {}  # old batch -> the one that takes its place
        for run in runs:
            if len(run) > 1:
                start, ident, end = run[0][0], run[0][1], run[-1][0] + run[-1][2]
                rows = self.messages(doc, {name: (start, end)})
                size = sum(size_of(self.spark, self._batch(name, b)) for *_, b in run)
                batch = uuid.uuid4().hex
                rows = rows.withColumn("offset", F.col("seq") - start).drop("seq", "msg_id", "queue").repartitionByRange(max(1, -(-size // file_bytes)), "msh7_ts", "offset")
                rows.sortWithinPartitions("msh7_ts", "offset").write.parquet(f"{self.root}/data/{batch}")
                merged |= dict.fromkeys((b for *_, b in run), f"{batch}-{start}-{ident}-{end - start}")
        if not merged:
            return

        def edit(new):
            now = self._queue(new, name)
            if not set(merged) <= set(now.batches):
                raise QueueProblem(f"queue {name} was changed meanwhile", -2)
            now.batches = list(dict.fromkeys(merged.get(b, b) for b in now.batches))

        self.change(edit)
        remove(self.spark, *(self._batch(name, b) for b in merged))


def in_display_order(df: DataFrame) -> DataFrame:
    """Messages for display: by queue and, within one, as they came in."""
    return df.orderBy("queue", "seq")


def unprocessed(queue: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Messages whose key isn't in the history."""
    return queue.join(history.select(key).distinct(), key, "left_anti")


def processed(queue: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Messages whose key is in the history."""
    return queue.join(history.select(key).distinct(), key, "left_semi")


def by_type(df: DataFrame) -> DataFrame:
    """Messages of each type."""
    return df.groupBy("msg_type_code").agg(F.count(F.lit(1)).alias("messages"))


def by_time(df: DataFrame, low: int, high: int) -> DataFrame:
    """Messages whose MSH time lies between low and high, both ends included, by time and then by arrival."""
    return df.where(F.col("msh7_ts").between(low, high)).orderBy("msh7_ts", "seq")


def by_index(df: DataFrame, column: str, value: str) -> DataFrame:
    """Messages with this value in a shredded column."""
    return df.where(F.col(column) == value)


def stored(spark: SparkSession, root: str) -> bool:
    """Whether a store lies there."""
    return exists(spark, f"{root.rstrip('/')}/manifest")
