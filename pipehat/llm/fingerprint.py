"""Document fingerprints of statistically improbable features.

Every window of WINDOW bytes has a Shannon entropy and, by how rare that entropy is in ordinary text, a rank. Every run of
consecutive windows votes for its window of the least rank, equal ranks by the window's hash; windows that win the votes of at
least VOTES times a run's length of neighbouring runs are the text's features, each once. A run is a DENSITY-th of the text's
windows, 1 at least and POPULAR at most, so all texts go by one rule, and as features of longer runs are among those of shorter
ones, texts of different sizes stay comparable. The features' hashes go into Bloom filters of FILTER_BITS bits and at most
FILTER_FEATURES features, a new filter being chained on when one is full. Two fingerprints are compared filter by filter: the
bits in common beyond what chance gives, over the most there could be; each filter of the shorter chain takes its best partner,
and the likeness is their mean, weighted by features.

The rank follows a rule with two parameters, the usual entropy of text windows and its spread, so that a fingerprint depends on
its text alone. Windows of hardly any entropy rank last. A text of fewer than WINDOW bytes is padded to one window; an empty text
has no filter and is like an empty text only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipehat.llm.arrow import map_batches, slices, strings
from pipehat.runtime import written

WINDOW, POPULAR, DENSITY, VOTES = 16, 64, 16, 0.25
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Entropy in bits of ordinary text windows and its spread; windows under WEAK bits rank last.
USUAL, SPREAD, WEAK = 3.15, 0.25, 1.0
#: Bytes worked on at a time, so that the arrays stay in the processor's cache.
BLOCK = 1 << 16
#: c * log2(c) in units of 2**-16 bits, for counts up to a window.
LOGS = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(1, np.arange(WINDOW + 1))) * 65536).astype(np.int32)
GAIN = np.diff(LOGS)
#: The rank after all others.
LAST = 4095
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def ranks(data: np.ndarray) -> np.ndarray:
    """A rank for each window of WINDOW bytes: the rarer its entropy, the less; LAST for windows of hardly any."""
    n = len(data) - WINDOW + 1
    behind = np.zeros(len(data), np.uint8)  # equal bytes among the WINDOW - 1 before
    ahead = np.zeros(len(data), np.uint8)
    for start in range(0, len(data), BLOCK):
        part = data[max(0, start - WINDOW) : start + BLOCK + WINDOW]
        b, a = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for k in range(1, WINDOW):
            same = (part[k:] == part[:-k]).view(np.uint8)
            b[k:] += same
            a[:-k] += same
        skip = start - max(0, start - WINDOW)
        behind[start : start + BLOCK] = b[skip : skip + BLOCK]
        ahead[start : start + BLOCK] = a[skip : skip + BLOCK]
    first = LOGS[np.bincount(data[:WINDOW], minlength=256)].sum()
    # a window's sum loses the byte that leaves it and gains the one that enters
    delta = GAIN[behind[WINDOW:]] - GAIN[ahead[: n - 1]]
    # the entering byte is counted without the leaving one, the leaving one without the entering one
    total = np.concatenate(([0], np.cumsum(delta, dtype=np.int64))) + int(first)
    entropy = np.log2(WINDOW) - total / (65536.0 * WINDOW)
    rarity = np.abs(entropy - USUAL) / SPREAD
    out = (LAST - 1 - np.minimum(rarity * 256, LAST - 1)).astype(np.uint64)
    out[entropy < WEAK] = LAST
    return out


def features(key: np.ndarray) -> np.ndarray:
    """The keys, in text order, that are the least of enough runs one after another. Equal windows win together."""
    n = len(key)
    run = max(1, min(POPULAR, n // DENSITY))
    low, step = key, 1
    while 2 * step <= run:  # doubling: the least of 2, 4, ... windows
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < run:
        low = np.minimum(low[: step - run], low[run - step :])
    start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return low[start[np.diff(np.r_[start, len(low)]) >= VOTES * run]]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every window of WINDOW bytes."""
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    n = len(data) - WINDOW + 1
    h = np.full(n, WINDOW, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, WINDOW, 8):
            h = mix(h * M2 + eights[k : k + n] + np.uint64(1))
    return h


def selected(text: str) -> np.ndarray:
    """Hashes of the features in text order, each once."""
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").ljust(WINDOW, b"\0"), np.uint8)
    # least rank first, then by hash
    chosen = features((ranks(data) << np.uint64(52)) | (window_hashes(data) >> np.uint64(12)))
    _, first = np.unique(chosen, return_index=True)
    return mix(chosen[np.sort(first)])


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chained Bloom filters as rows of bits."""
    chain = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), bool)
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for k in range(HASHES):
        chain[row, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return chain


def sizes(n: int) -> np.ndarray:
    """Features in each filter of a chain of n features."""
    return np.minimum(FILTER_FEATURES, n - FILTER_FEATURES * np.arange(-(-n // FILTER_FEATURES)))


class Print:
    """A fingerprint: number of features and chained filters."""

    __slots__ = ("count", "bits")

    def __init__(self, text: str):
        h = selected(text)
        self.count, self.bits = len(h), filters(h)

    def text(self) -> str:
        """features:filters, the filters packed and in base64."""
        return f"{self.count}:{base64.b64encode(self.packed()).decode()}"

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def likeness(self, other: Print) -> float:
        if not self.count or not other.count:
            return float(self.count == other.count)
        a, b = (self, other) if (len(self.bits), self.count) <= (len(other.bits), other.count) else (other, self)
        one, two = a.bits.astype(np.float32), b.bits.astype(np.float32)
        common, na, nb = one @ two.T, one.sum(axis=1)[:, None], two.sum(axis=1)[None, :]
        chance, most = na * nb / FILTER_BITS, np.minimum(na, nb)
        score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)
        weight = sizes(a.count)
        return float((score.max(axis=1) * weight).sum() / weight.sum())


def parse(text: str) -> Print:
    """The fingerprint that Print.text() shows."""
    out = Print.__new__(Print)
    count, _, packed = text.partition(":")
    out.count = int(count)
    out.bits = np.unpackbits(np.frombuffer(base64.b64decode(packed), np.uint8)).astype(bool).reshape(-1, FILTER_BITS)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many code points of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) in ranges of falling ids, sorted within each. Rows of one id are dealt by their texts' hash, equal rows by
    their place, so that no id and no copies of a row need share a task."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    keys = [F.desc_nulls_last("id"), F.desc("tie"), F.desc("place")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")


RESULT = "n_chars long, edited_sha256 string, count long, filters binary, edited_count long, edited_filters binary, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def result(text: str, own: Print, following: str, its: Print) -> tuple:
    """What RESULT names."""
    new = edited(text, following)
    other = Print(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, own.count, own.packed(), other.count, other.packed(), own.likeness(other), own.likeness(its)


def columns(found: list[tuple | None]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.float64(), pa.float64()]
    return [pa.array([None if x is None else x[i] for x in found], k) for i, k in enumerate(kinds)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next row is that of the next lower id (equal ids: by the texts' hash; null ids last), after the last the first; a single
    row follows itself. Ids are of any type that sorts. Null texts are empty ones.

    Tasks go through ranges of ids. Each range's first and last rows are kept beside the results; the last rows are then
    compared with the first ones of the ranges after them.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), True, None  # held: (id, text, fingerprint) that waits for its follower
        for batch, texts in slices(batches, 1):
            ids, found = ([held[0]] if held else []), []
            prints = [Print(t) for t in texts]
            if first:
                yield rows(part, "first", batch.column(0)[:1], [None], texts[:1])
                first = False
            before = [held[1:], *zip(texts, prints, strict=True)] if held else list(zip(texts, prints, strict=True))
            for (text, own), (following, its) in pairwise(before):
                found.append(result(text, own, following, its))
            of = pa.concat_arrays([*ids, batch.column(0)])[: len(found)]
            held = batch.column(0)[-1:], texts[-1], prints[-1]
            yield rows(part, "inner", of, found, [None] * len(found))
        if held:
            yield rows(part, "last", held[0], [None], [held[1]])

    def rows(part: int, role: str, ids: pa.Array, found: list, texts: list) -> pa.RecordBatch:
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([role] * n, pa.string()), ids, pa.array(texts, pa.string()), *columns(found)], names=["part", "role", "id", "text", *NAMES])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            found = [result(t, Print(t), f, Print(f)) for t, f in zip(texts, strings(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(found)], names=["id", *NAMES])

    done = written(map_batches(in_order(df, id_col, text_col), ["id", "text"], work, f"part int, role string, id {kind}, text string, {RESULT}"), "fingerprints")
    inner, first, last = done.where("role = 'inner'").select("id", *NAMES), done.where("role = 'first'"), done.where("role = 'last'")
    # as many numbers as the shuffle has partitions
    parts = sorted(r.part for r in last.select("part").collect())
    links = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next int")
    pairs = last.select("part", "id", "text").join(F.broadcast(links), "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
    out = inner.unionAll(map_batches(pairs, ["id", "text", "following"], ends, f"id {kind}, {RESULT}"))
    shown = lambda count, bits: F.concat(F.col(count), F.lit(":"), F.replace(F.base64(F.col(bits)), F.lit("\r\n"), F.lit("")))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", shown("count", "filters").alias("fingerprint"), shown("edited_count", "edited_filters").alias("edited_fingerprint"), "near_edited", "near_next"
    )
