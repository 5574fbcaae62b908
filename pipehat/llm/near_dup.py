"""Near duplicates: DartMinHash signatures, banded joining, exact verification, connected components.

A text is a weighted set: its shingles of five words, weighted by how often they occur. Darts are thrown into the plane of
weight and rank of every element, cut into unit cells that each hold a Poisson(1) number of darts from the element's own
hash, so equal elements get equal darts in every text. Darts under an element's weight and under the text's rank limit count;
of those, each of the signature's coordinates keeps the one with the least rank. Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity.

Texts that agree in all coordinates of a band meet in a bucket. The most popular text of a bucket, which shares most buckets
with most others, leads it: all others are compared with it, on their whole texts, and links join to classes by connected
components. Where texts of several classes are left in a bucket, an exact similarity join by prefixes of rare shingles finds
the links between them. So no bucket is capped, none emits all its pairs, and a dense one costs about as many comparisons as it
has texts. Hot values of joins (copies of a text, large buckets, popular texts, large classes) are dealt over many tasks.

Defined results: copies of a text share a class. A text of fewer than five words is one shingle of all its words; a text
without words, or null, is like its exact copies only (nulls stay alone). A class is named by the least id in it. Repeated rows
come out as often as they came in. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipehat.llm.arrow import claim, map_batches, settle, slices, strings
from pipehat.llm.components import components
from pipehat.llm.hot import dealt_join, hot_values
from pipehat.runtime import remove, written

WORD = re.compile(r"\w+")
SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Longs of 64 bits in a sketch.
SKETCH_WORDS = 16
CACHE_WORDS = 150_000
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Cumulated probabilities of 0 to 11 darts in a unit cell, by the rule of Poisson(1).
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output looks random (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


_word_hashes: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    from hashlib import blake2b

    cache = _word_hashes
    claim(cache)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def weighted_sets(texts: list[str | None], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of all distinct shingles, by text and hash."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = word_hashes(list(chain.from_iterable(words)))
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(texts)), count)
    if not len(of):
        return of, np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.repeat(np.cumsum(n) - n - (np.cumsum(count) - count), count) + np.arange(len(of))
    size = np.minimum(n, k)[of]
    with np.errstate(over="ignore"):
        s = np.zeros(len(of), np.uint64)
        for j in range(k):
            s = np.where(j < size, mix(s * GOLD + h[np.minimum(first + j, len(h) - 1)] + np.uint64(j + 1)), s)
    order = np.lexsort((s, of))
    of, s = of[order], s[order]
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (s[1:] != s[:-1])])
    return of[new], s[new], np.diff(np.r_[new, len(s)])


def signatures(of: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int, seed: int = 1) -> np.ndarray:
    """k dart hashes for each text; 0 throughout where a text has no element."""
    total = np.bincount(of, weight, texts)
    need = np.flatnonzero(total)
    best = np.full((texts, k), np.iinfo(np.uint64).max, np.uint64)
    darts = k * np.log(k) + 2 * k
    while len(need):
        limit = np.zeros(texts)
        limit[need] = darts / total[need]
        some = limit[of] > 0
        throw(of[some], element[some], weight[some], limit, best, k, seed)
        need = need[(best[need] == np.iinfo(np.uint64).max).any(axis=1)]
        darts *= 2
    return np.where(total[:, None] > 0, best & np.uint64(0xFFFFFFFF), np.uint64(0))


def throw(of: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, best: np.ndarray, k: int, seed: int) -> None:
    """Throw the darts of all regions that a weight and a rank limit reach, and keep the least rank of each coordinate.

    Region (v, r) spans the weights from 2**v - 1 to 2**(v+1) - 1 and ranks likewise. Its unit cells are dealt with in blocks.
    """
    flat = best.reshape(-1)
    with np.errstate(over="ignore"):
        base = mix(element + np.uint64(seed) * GOLD)
        for v in range(int(np.log2(1 + weight.max())) + 1 if len(weight) else 0):
            heavy = np.flatnonzero(weight > 2**v - 1)
            top = limit[of[heavy]]
            for r in range(int(np.log2(1 + top.max())) + 1 if len(top) else 0):
                e = heavy[top > 2**r - 1]
                # whole cells under the weight and the rank limit, so that no work follows the region's full size
                wide = np.minimum(weight[e] - (2**v - 1), 2**v).astype(np.int64)
                high = np.ceil(np.minimum(limit[of[e]] - (2**r - 1), 2**r)).astype(np.int64)
                cells = wide * high
                for part in np.split(np.arange(len(e)), np.searchsorted(np.cumsum(cells), np.arange(1, cells.sum() // 2_000_000 + 1) * 2_000_000)):
                    if len(part):
                        cast(e[part], wide[part], high[part], v, r, of, base, weight, limit, flat, k)


def cast(e, wide, high, v, r, of, base, weight, limit, flat, k) -> None:
    cells = wide * high
    who = np.repeat(np.arange(len(e)), cells)
    at = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
    x, y = at // high[who], at % high[who]
    cell = mix(base[e][who] ^ mix(x.astype(np.uint64) * GOLD + (y.astype(np.uint64) << np.uint64(32)) + np.uint64(v * 64 + r + 1)))
    count = np.searchsorted(POISSON, unit(cell), side="right")
    hit = np.repeat(np.arange(len(who)), count)
    j = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(cell[hit] + (j + 1).astype(np.uint64) * GOLD)
    w = (2**v - 1) + x[hit] + unit(mix(dart ^ M1))
    rank = (2**r - 1) + y[hit] + unit(mix(dart ^ M2))
    el = e[who[hit]]
    text = of[el]
    ok = (w < weight[el]) & (rank < limit[text])
    dart, rank, text = dart[ok], rank[ok], text[ok]
    key = text * k + (dart % np.uint64(k)).astype(np.int64)
    # rank in the high half as ordered float bits, the dart's hash in the low half
    packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart >> np.uint64(32))
    np.minimum.at(flat, key, packed)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLD), (len(sig), bands)).copy()
        for j in range(rows):
            key = mix(key * GOLD + sig[:, j::rows][:, :bands])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def text_key(text):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def sign(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(id, key, bands, total) of every row whose text isn't null; bands is null where the text has no word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 2):
            of, s, w = weighted_sets(texts)
            total = np.bincount(of, w, len(texts)).astype(np.int64)
            keys = band_keys(signatures(of, s, w, len(texts), bands * rows), bands, rows)
            some = np.bincount(of, minlength=len(texts)) > 0
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands, mask=np.r_[~some, False])
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(total)], names=["id", "key", "bands", "total"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return map_batches(df.where(text.isNotNull()), [F.col(id_col).alias("id"), text_key(text).alias("key"), text.alias("text")], work, f"id {kind}, key binary, bands array<long>, total long")


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (a, b), each once, with `same`: whether their texts are similar enough. texts: (key, text). A text of very many
    pairs is dealt to many tasks."""
    n = pairs.count()
    both = pairs
    for side, other in ("a", "b"), ("b", "a"):
        sizes = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        both = dealt_join(both, texts.toDF(side, f"text_{side}"), side, hot_values(sizes, side, n), other)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in slices(batches, 2):
            of, s, w = weighted_sets(first)
            at = np.searchsorted(of, np.arange(len(first) + 1))
            result, seen, set_b = [], None, None
            for i, b in enumerate(strings(batch.column(3))):
                if b != seen:  # rows of one b come together
                    seen, set_b = b, weighted_sets([b])[1:]
                own = slice(at[i], at[i + 1])
                result.append(similarity((s[own], w[own]), set_b) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(result, pa.bool_())], names=["a", "b", "same"])

    return map_batches(both, ["a", "b", "text_a", "text_b"], work, "a binary, b binary, same boolean")


def _led(members: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(bucket, key, total, leader) of all members beside their bucket's most popular text."""
    best = members.groupBy("bucket").agg(F.max(F.struct("popularity", "key")).alias("best"))
    return dealt_join(members, best.select("bucket", F.col("best.key").alias("leader")), "bucket", hot, "key").where("key <> leader").select("bucket", "key", "total", "leader")


def _open(led: DataFrame, labels: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(key, label, total, lightest) of the texts that meet texts of other classes among those that don't lead their bucket;
    lightest is the least total of what they meet there."""
    now = led.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("root", "key"))
    mixed = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("total").alias("lightest")).where("low <> high")
    met = dealt_join(now, mixed.select("bucket", "lightest"), "bucket", hot, "key")
    return met.groupBy("key").agg(F.min("label").alias("label"), F.min("total").alias("total"), F.min("lightest").alias("lightest"))


def _prefix_pairs(texts: DataFrame, least: float) -> tuple[DataFrame, list[str]]:
    """Pairs (a, b) of different classes that may be similar enough, and tables to remove after; texts: (key, text, label,
    total, lightest).

    Two texts that similar share a weight of at least least / (1 + least) of both totals. With every text's shingles in one
    order, the rarest first, such texts share one among the first that leave less than that weight behind: so only those are
    joined. Between edited copies of one text the rarest shingles are those of the edits, which few share. Pairs whose sketches
    differ too much to be similar go within the join. Neither test can lose a link.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in slices(batches, 1):
            of, h, w = weighted_sets(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(h.view(np.int64)), pa.array(w)], names=["key", "shingle", "weight"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in sketch(*weighted_sets(own), len(own)).T)], names=["key", *(f"s{i}" for i in range(SKETCH_WORDS))])

    rows = written(map_batches(texts, ["key", "text"], shingles, "key binary, shingle long, weight long"), "shingles")
    sketched = map_batches(texts, ["key", "text"], sketches, "key binary, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS)))
    total = rows.count()
    spread = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "spread", total)
    hot = hot_values(spread, "shingle", total)
    order = Window.partitionBy("key").orderBy("spread", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    # what only one text has comes first, by its own order
    ranked = dealt_join(rows, spread.withColumnRenamed("n", "spread"), "shingle", hot, "key", "left").fillna(1, ["spread"]).withColumn("before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    facts = texts.select("key", "label", "total", "lightest")
    # a shingle counts while the weight from it on still reaches the least that a similar text must share
    needed = (F.col("total") + F.col("lightest")) * (least / (1 + least)) - 1e-6
    prefix = ranked.where("spread > 1").join(facts, "key").where((F.col("total") - F.col("before")) >= needed).select("shingle", "key", "label", "total")
    # pairs of one class aren't wanted: of every two classes at least one isn't the shingle's largest
    sizes = prefix.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("shingle").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    prefix = written(dealt_join(prefix, largest.drop("classes"), "shingle", hot, "key").join(sketched, "key"), "prefix")
    one, two = (prefix.toDF(*(f"{c}{i}" if c != "shingle" else c for c in prefix.columns)) for i in (1, 2))
    apart = sum((F.bit_count(F.col(f"s{i}1").bitwiseXOR(F.col(f"s{i}2"))) for i in range(SKETCH_WORDS)), F.lit(0))
    close = apart <= (F.col("total1") + F.col("total2")) * ((1 - least) / (1 + least)) + 1e-6
    found = one.where("label1 <> largest1").join(two, "shingle").where((F.col("label1") != F.col("label2")) & close)
    return found.select(F.greatest("key1", "key2").alias("a"), F.least("key1", "key2").alias("b")).distinct(), [rows.path, spread.path, prefix.path]


def sketch(of: np.ndarray, h: np.ndarray, w: np.ndarray, texts: int) -> np.ndarray:
    """64 * SKETCH_WORDS parities for each text: every occurrence of a shingle flips one bit. Two texts differ in at least as
    many occurrences as their sketches in bits, which bounds their similarity from above."""
    each = np.repeat(np.arange(len(of)), w)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(w) - w, w)
    with np.errstate(over="ignore"):
        bit = (mix(h[each] + nth.astype(np.uint64) * GOLD) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    odd = np.bincount(of[each] * (64 * SKETCH_WORDS) + bit, minlength=texts * 64 * SKETCH_WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(texts, SKETCH_WORDS)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of df: its id, class_id (the least id of its class) and is_representative (the id is that)."""
    out = classes(df, id_col, text_col, least, bands, rows).select(F.col("id").alias(id_col), "class_id")
    nulls = df.where(F.col(text_col).isNull()).select(id_col, F.col(id_col).alias("class_id"))
    return out.unionAll(nulls).withColumn("is_representative", F.col(id_col).eqNullSafe(F.col("class_id")))


def classes(df: DataFrame, id_col: str, text_col: str, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, key, class_id, class_key) of every row with a text; (class_id, class_key) is the least (id, key) of the row's class,
    null ids last. Written."""
    spark = df.sparkSession
    settle(spark)
    signed = written(sign(df, id_col, text_col, bands, rows), "signed")
    total = signed.count()
    distinct = written(signed.groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("total").alias("total"), F.count(F.lit(1)).alias("n")), "distinct", total)
    members, hot, met, spent = _meetings(distinct, total * bands)
    spent += [signed.path, distinct.path]
    texts = written(_fetch(df, id_col, text_col, members.select("key").distinct().join(distinct.select("key", "id"), "key")), "texts")
    led = written(_led(members, hot), "led", met)
    first = written(led.select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct(), "pairs", met)
    compares = first.count()
    compared = written(verify(first, texts, least).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "same").distinct(), "compared", compares)
    labels = components(compared.where("same").select("a", "b"), compares)
    rest = written(texts.join(_open(led, labels, hot), "key"), "rest")
    settle(spark)
    candidates, made = _prefix_pairs(rest, least)
    pairs = written(candidates.join(compared, ["a", "b"], "left_anti"), "pairs")
    settle(spark)
    more = written(verify(pairs, rest.select("key", "text"), least), "compared")
    spent += [texts.path, led.path, first.path, compared.path, labels.path, rest.path, *made, pairs.path, more.path]
    # nodes order by id, so that a component's root names its class
    node = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    nodes = distinct.select("key", node.alias("node"))
    links = compared.unionAll(more).where("same").select("a", "b")
    links = links.join(nodes.toDF("a", "node_a"), "a").join(nodes.toDF("b", "node_b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    roots = components(links, compares + pairs.count())
    spent.append(roots.path)
    names = roots.select("node.key", "root")
    names = distinct.select("key", node.alias("own"), "n").join(names, "key", "left").select("key", F.coalesce("root", "own").alias("root"))
    copies = hot_values(distinct.select("key", "n"), "key", total)
    # dealt by their place in the table, since copies may share even their id
    named = dealt_join(signed.select("id", "key", F.monotonically_increasing_id().alias("place")), names, "key", copies, "place")
    out = written(named.select("id", "key", F.col("root.id").alias("class_id"), F.col("root.key").alias("class_key")), "classes", total)
    remove(spark, *spent)
    settle(spark)
    return out


def _meetings(distinct: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None, int, list[str]]:
    """(bucket, key, total, popularity) of the texts that meet others, hot buckets, the number of rows, and tables to remove after:
    popularity sums the sizes of a text's buckets. most: of all texts, how many bands there are at most."""
    rows = distinct.where("bands IS NOT NULL").select("key", "total", F.explode("bands").alias("bucket"))
    sizes = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes", most)
    n = sizes.agg(F.sum("n")).first()[0] or 0
    hot = hot_values(sizes, "bucket", n)
    met = written(dealt_join(rows, sizes, "bucket", hot, "key"), "met", most)
    popular = met.groupBy("key").agg(F.sum("n").alias("popularity"))
    out = written(met.drop("n").join(popular, "key"), "members", n)
    remove(distinct.sparkSession, met.path)
    settle(distinct.sparkSession)
    return out, hot, n, [sizes.path, out.path]


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df, all columns, one of each class: that with the least id, of several texts with that id the one of the
    least digest, of equal rows any one. Rows without a text all stay."""
    kept = classes(df, id_col, text_col, **how).where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
    name = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name")
    rows = df.where(F.col(text_col).isNotNull()).select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col).cast("string")).alias("key"))
    rows = rows.select("row", "key", name, F.col("id").isNull().alias("none")).join(kept.select("key", name, F.col("id").isNull().alias("none")).distinct(), ["key", "name", "none"])
    return rows.dropDuplicates(["key", "name", "none"]).select("row.*").unionAll(df.where(F.col(text_col).isNull()))


def _fetch(df: DataFrame, id_col: str, text_col: str, need: DataFrame) -> DataFrame:
    """(key, text), once for each key of need (key, id). Joined on both, so that copies of a text spread by their ids."""
    name = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name")
    text = F.col(text_col).cast("string")
    rows = df.where(text.isNotNull()).select(F.col(id_col).alias("id"), text.alias("text")).select(text_key(F.col("text")).alias("key"), name, "text")
    found = rows.join(need.select("key", name), ["key", "name"])
    return found.groupBy("key", "name").agg(F.first("text").alias("text")).select("key", "text")
