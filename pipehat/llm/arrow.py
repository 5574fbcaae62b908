"""Arrow batches in and out of the Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from pipehat.runtime import ship

#: Characters of text that a worker handles at a time, so that memory doesn't follow the batch.
SLICE_CHARS = 2_000_000
#: Bounds of the batches that Spark hands over, where the session says nothing.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def map_batches(df: DataFrame, columns: Sequence[Column | str], work: Callable, schema: str) -> DataFrame:
    """mapInArrow over just these columns; other columns, whatever their names, are not read."""
    prepare(df.sparkSession)
    return df.select(*columns).mapInArrow(tidy(work), schema)


def tidy(work: Callable) -> Callable:
    """work that gives free memory back to the system when a task ends: workers live on, and else keep what they once took."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return over


def give_back() -> None:
    """Give free memory of this process back to the system, which numpy's and Arrow's allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Let the driver give up what no step uses any more: free memory of its Python, garbage of its JVM, and with that the shuffles
    and broadcasts of finished steps on all machines, which Spark keeps until the driver's heap happens to fill."""
    gc.collect()
    give_back()
    spark._jvm.System.gc()


def prepare(spark: SparkSession) -> None:
    """Ship the code and bound the batches."""
    ship(spark)
    for key, bound in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, bound)


_caches: list[dict] = []


def claim(cache: dict) -> None:
    """Empty the caches of other operators that have run in this worker: one works at a time."""
    for other in _caches:
        if other is not cache:
            other.clear()
    _caches[:] = [cache]


def strings(column: pa.Array) -> list[str | None]:
    """The column's strings; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: int, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of the batches of at most so many characters or one row, with the strings of column number `text`."""
    for batch in batches:
        values = strings(batch.column(text))
        start = size = 0
        for i, x in enumerate(values):
            n = len(x or "")
            if i > start and size + n > chars:
                yield batch.slice(start, i - start), values[start:i]
                start, size = i, 0
            size += n
        if start < len(values):
            yield batch.slice(start), values[start:]


def rewrite(df: DataFrame, text_col: str, work: Callable[[list[str | None]], tuple[list[bool] | None, list[str | None] | None]]) -> DataFrame:
    """df with rows dropped or texts replaced in one pass; all columns stay as they are otherwise, whatever their names.

    work gets the texts of a slice and returns which rows stay (None: all) and new texts (None: the same), before dropping.
    """
    at = df.columns.index(text_col)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, at):
            stay, new = work(texts)
            if new is not None:
                columns = list(batch.columns)
                columns[at] = pa.array(new, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch if stay is None else batch.filter(pa.array(stay, pa.bool_()))

    prepare(df.sparkSession)
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    return plain.mapInArrow(tidy(over), plain.schema).toDF(*df.columns)
