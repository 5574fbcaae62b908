"""Continuous ingest, routing and monitoring with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pipehat.functions import codec, hl7
from pipehat.operators.queues import QueueStore


def stream_messages(spark: SparkSession, folder: str, numbering: str = "as_coded", files_per_trigger: int = 100) -> DataFrame:
    """Parsed messages of persisted line files as they arrive in a folder."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).option("lineSep", "\n").text(folder)
    return hl7.parse(codec.from_lines(lines), numbering=numbering)


def into_queue(messages: DataFrame, store: QueueStore, queue: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a queue, each batch in order of its ids. A batch that is run again after a failure is recognised by
    its number, which the queue's manifest gets in the same commit as the rows."""

    def add(batch: DataFrame, number: int) -> None:
        done = store.state()[1].get("streams", {}).get(checkpoint, -1)
        if number > done:
            taken = lambda doc: doc.setdefault("streams", {}).update({checkpoint: number})
            store.insert_frame(queue, batch.select("raw_message", "timestamp", "msg_id"), ["msg_id"], taken)

    return _start(messages.writeStream.foreachBatch(add), checkpoint, once)


def route(messages: DataFrame, sinks: Mapping[str, Callable[[DataFrame, int], None]], checkpoint: str, by: str = "msg_type_code", otherwise: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Hand each batch's valid messages to the sink of their type; invalid ones and those of other types go to `otherwise`."""
    valid = hl7.validate(F.col("segments"), F.col("parse_errors")) == 0

    def spread(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for value, sink in sinks.items():
                sink(batch.where(valid & (F.col(by) == value)), number)
            if otherwise:
                otherwise(batch.where(~(valid & F.col(by).isin(*sinks))), number)
        finally:
            batch.unpersist()

    return _start(messages.writeStream.foreachBatch(spread), checkpoint, once)


def counts(messages: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: str = "msg_type_code") -> DataFrame:
    """Messages of each type in windows of their MSH time; those later than `late` don't count."""
    at = messages.withColumn("at", F.timestamp_seconds("msh7_ts")).withWatermark("at", late)
    return at.groupBy(F.window("at", window, slide or window).alias("w"), by).agg(F.count(F.lit(1)).alias("messages")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "messages")


def sessions(messages: DataFrame, key: str = "pid3", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a patient's messages, each less than gap after the one before; a message just gap later begins another run. A run
    ends gap after its last message."""
    at = messages.withColumn("at", F.timestamp_seconds("msh7_ts")).withWatermark("at", late)
    # Spark joins windows that touch: these are an instant shorter, so that only those that overlap are joined
    runs = at.groupBy(F.session_window("at", f"{gap} -1 microseconds").alias("w"), key).agg(F.count(F.lit(1)).alias("messages"))
    return runs.select(F.col("w.start").alias("start"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"), key, "messages")


def recent(messages: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """Messages no older than so many hours before the present."""
    at = messages.withColumn("at", F.timestamp_seconds("msh7_ts")).withWatermark("at", late)
    return at.where(F.col("at") > F.current_timestamp() - F.expr(f"INTERVAL {int(hours)} HOURS")).drop("at")


def consume(store: QueueStore, queue: str, work: Callable[[DataFrame], None], batch: int = 1000) -> int:
    """Pop messages in batches and hand each batch to work until the queue is empty; how many."""
    n = 0
    while not store.is_empty(queue):
        before = store.size(queue)
        taken = store.pop(queue, batch)
        moved = before - store.size(queue)
        if moved <= 0:
            break
        work(taken)
        n += moved
    return n


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
