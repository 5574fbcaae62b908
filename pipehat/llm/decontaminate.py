"""Benchmark decontamination by greedy string tiling.

Words of a document that occur in the benchmark become numbers; a rolling (Karp-Rabin) hash of SEED_WORDS of them, looked up
among the benchmark's own, joins documents to items by shared seeds. The places of an item that a document's different seeds
reach bound the coverage from above, before anything is listed by pairs. For pairs that can count, runs of equal words are grown
along all diagonals of the seeds' places; the longest is marked, then the longest of what is still unmarked on both sides, and so
on: tiles never overlap, and their order is free, so reordered passages still cover the item. A pair counts when its tiles cover
at least `least` of the item's words. Work on a pair grows with the item's words times the document's words under seeds of it, in
arrays as long as the latter, however often words repeat.

The benchmark is dealt with in blocks whose size is checked (BLOCK_CHARS), each broadcast once and, if there are several,
released before the next; documents are only scanned, never shuffled. Defined results: items of fewer words than a seed must
occur whole; items without words, null items, null and empty documents match nothing; repeated items count once, repeated
documents come out repeatedly; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipehat.llm.arrow import map_batches, rewrite, slices
from pipehat.runtime import remove, written

WORD = re.compile(r"\w+")
SEED_WORDS, COVERAGE = 5, 0.5
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 16_000_000
BASE = np.uint64(1_000_003)


def rolling(ids: np.ndarray, m: int) -> np.ndarray:
    """Hash of every window of m numbers."""
    n = len(ids) - m + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            h = h * BASE + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    return h


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple], seed: int = SEED_WORDS):
        self.vocab: dict[str, int] = {}
        self.names, self.items = [], []
        for name, text in items:
            words = WORD.findall((text or "").lower())
            if words:
                self.names.append(name)
                self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int64))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in {min(seed, len(x)) for x in self.items}:
            found = [(h, k, j) for k, x in enumerate(self.items) if min(seed, len(x)) == m for j, h in enumerate(rolling(x, m).tolist())]
            h = np.array([f[0] for f in found], np.uint64)
            order = np.argsort(h, kind="stable")
            self.seeds[m] = h[order], np.array([f[1] for f in found])[order], np.array([f[2] for f in found])[order]

    def candidates(self, texts: list[str | None], least: float) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(text, item, seed length, numbers of the text's words, places of its seeds) of pairs that may count."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        get = self.vocab.get
        flat = np.fromiter((get(w, -1) for w in chain.from_iterable((*x, "") for x in words)), np.int64)
        ends = np.cumsum([len(x) + 1 for x in words])
        unknown = np.cumsum(np.r_[0, flat < 0])
        for m, (hashes, items, places) in self.seeds.items():
            whole = np.flatnonzero(unknown[m:] == unknown[: len(unknown) - m])
            h = rolling(flat, m)[whole]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            some = hi > lo
            at, lo, hi = whole[some], lo[some], hi[some]
            of = np.searchsorted(ends, at, side="right")
            for t, a, b in zip(*bounds(of), strict=True):
                start = int(ends[t]) - len(words[t]) - 1
                ids = flat[start : ends[t] - 1]
                # each different seed once, with its places in all items
                first, which = np.unique(lo[a:b], return_inverse=True)
                n = np.searchsorted(hashes, hashes[first], "right") - first
                seed = np.repeat(np.arange(len(first)), n)
                where = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(seed))
                order = np.lexsort((places[where], items[where]))
                where, seed = where[order], seed[order]
                item, place = items[where], places[where]
                # a place reaches m words, or as many as lie before the next place
                reach = np.full(len(item), m)
                same = item[1:] == item[:-1]
                reach[:-1][same] = np.minimum(m, np.diff(place)[same])
                for k, c, d in zip(*bounds(item), strict=True):
                    if reach[c:d].sum() >= least * len(self.items[k]):
                        mine = np.zeros(len(first), bool)
                        mine[seed[c:d]] = True
                        yield t, k, m, ids, at[a:b][mine[which]] - start

    def matches(self, texts: list[str | None], least: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(text, item, coverage, tiles) of the pairs that count."""
        for t, k, m, ids, at in self.candidates(texts, least):
            tiles = tile(ids, self.items[k], at, m)
            covered = sum(n for _, _, n in tiles) / len(self.items[k])
            if covered >= least:
                yield t, k, covered, tiles


def bounds(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The values, each once, of a sorted array, where each begins and where it ends."""
    start = np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]][: len(values)])
    return values[start].tolist(), start.tolist(), [*start[1:].tolist(), len(values)][: len(start)]


def runs(text: np.ndarray, item: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Rows (-length, place in the text, place in the item), sorted, of all longest runs of m equal words or more that lie under
    seeds at the given places of the text."""
    place = np.unique((at[:, None] + np.arange(m)).ravel())
    # pieces of the text that no seed joins are kept apart by a number that no word has
    cut = np.flatnonzero(np.diff(place) > 1) + 1
    own, place = np.insert(text[place], cut, -2), np.insert(place, cut, -1)
    length, found = np.zeros(len(own) + 1, np.int64), []  # of the run that ends before each place and the item's next word
    for j in range(len(item) + 1):
        longer = np.zeros_like(length)
        if j < len(item):
            same = own == item[j]
            longer[1:][same] = length[:-1][same] + 1
        done = np.flatnonzero(length >= m)
        done = done[longer[np.minimum(done + 1, len(own))] * (done < len(own)) == 0]
        if len(done):
            n = length[done]
            found.append(np.stack((-n, place[done - 1] - n + 1, np.full(len(done), j) - n), axis=1))
        length = longer
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]


def tile(text: np.ndarray, item: np.ndarray, at: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """(place in the text, place in the item, length) of greedily chosen tiles, by place in the text."""
    whole, nth, parts = runs(text, item, at, m), 0, []
    used_text, used_item, tiles, left = np.zeros(len(text), bool), np.zeros(len(item), bool), [], len(item)
    while left >= m and (nth < len(whole) or parts):
        if parts and (nth == len(whole) or parts[0] < tuple(whole[nth].tolist())):
            n, i, j = heapq.heappop(parts)
        else:
            n, i, j = whole[nth].tolist()
            nth += 1
        n = -n
        free = ~(used_text[i : i + n] | used_item[j : j + n])
        if free.all():
            used_text[i : i + n] = used_item[j : j + n] = True
            tiles.append((i, j, n))
            left -= n
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= m:
                heapq.heappush(parts, (a - b, i + a, j + a))
    return sorted(tiles)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list[tuple], int]]:
    """The distinct items in blocks of about block_chars characters of text, and how many blocks there are."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_chars))
    for b in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield sorted(((r.item, r.text) for r in block.collect()), key=str), n


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, coverage, tiles) for every document and item whose tiles cover at least `least` of the item."""
    spark, item_type = docs.sparkSession, benchmark.schema[item_col].dataType
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item {item_type.simpleString()}, coverage double, tiles array<struct<doc_word: int, item_word: int, words: int>>"
    columns, out = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], None
    for items, n in blocks(benchmark, item_col, item_text_col, block_chars):
        index = spark.sparkContext.broadcast(Index(items))
        part = map_batches(docs, columns, scanner(index, least, item_type), schema)
        if n > 1:  # one index at a time
            part = written(part, "found")
            index.unpersist()
        out = part if out is None else out.unionAll(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, that find() has no item for."""
    spark, before = docs.sparkSession, None
    for items, n in blocks(benchmark, item_col, item_text_col, block_chars):
        index = spark.sparkContext.broadcast(Index(items))
        docs = rewrite(docs, text_col, outside(index, least))
        if n > 1:
            docs = written(docs, "outside")
            index.unpersist()
            remove(spark, before)
            before = docs.path
    return docs


def outside(index, least: float):
    def work(texts: list[str | None]) -> tuple[list[bool], None]:
        hit = {t for t, _, _, _ in index.value.matches(texts, least)} if index.value.items else set()
        return [i not in hit for i in range(len(texts))], None

    return work


def scanner(index, least: float, item_type):
    """The function that runs over batches of (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        found = index.value
        tile_type = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))
        for batch, texts in slices(batches, 1):
            rows = list(found.matches(texts, least)) if found.items else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([found.names[r[1]] for r in rows], to_arrow_type(item_type)),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([[{"doc_word": i, "item_word": j, "words": n} for i, j, n in r[3]] for r in rows], tile_type),
                ],
                names=["id", "item", "coverage", "tiles"],
            )

    return work
