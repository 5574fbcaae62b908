"""Language identification: words first, then back off to shorter and shorter character n-grams.

A word known from training scores by its log frequency in each language. An unseen word scores by its character n-grams, the
longest length at which any of them is known, from MAX_GRAM down to 1. A text's score for a language is the sum over its
words; the prediction's score is its posterior under equal priors.

Training reads all different texts of each label, or about max_docs of them at most, chosen by their hash (the bound is on the
expected number), copies once; so neither null or repeated ids nor copies lift the bound. Their words are counted where they lie,
all of them, then the n-grams of all words; those seen twice at least, in whatever languages, reach the driver, as 64-bit keys and
numbers of languages, one length after the other. Labels are taken to be languages: tables have a column for each. Defined results: null texts and texts without a letter are `und` with score 0; rows with a null
label train nothing; with nothing to train on every text is `und`; ties between languages go to the first by name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Hashable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipehat.llm.arrow import claim, map_batches, rewrite, settle, slices, strings
from pipehat.runtime import remove, written

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
MAX_DOCS_PER_LANG, MAX_GRAM, CACHE_WORDS = 2500, 5, 100_000
#: Characters whose words a worker counts at a time, and counts that it keeps, which bounds its memory; Spark adds them up.
COUNT_CHARS, KEPT_COUNTS = 250_000, 50_000
#: Hash values that the choice of texts distinguishes, and labels up to which their shares are broadcast.
HASHES, BROADCAST_LABELS = 1 << 40, 100_000
#: What stands for a word's start and end in its n-grams.
EDGE = {"start": "\x02", "end": "\x03"}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    marked = EDGE["start"] + word + EDGE["end"]
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def with_grams(counts: dict[tuple[Hashable, str], int]) -> dict[tuple[int, str, Hashable], int]:
    """(size, text, language): counts of words (size 0) and of their n-grams (size n)."""
    out: dict[tuple[int, str, str], int] = Counter()
    for (lang, word), k in counts.items():
        out[0, word, lang] += k
        for n in range(1, MAX_GRAM + 1):
            for g in grams(word, n):
                out[n, g, lang] += k
    return out


def keys_of(texts: Iterable[str]) -> np.ndarray:
    """64 bits that stand for each text."""
    return np.frombuffer(b"".join([blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in texts]), "<i8")


class Rows:
    """The row numbers of texts by their sorted keys: no text is kept, which makes a table a tenth of a dict."""

    def __init__(self, sorted_keys: np.ndarray):
        self.sorted = sorted_keys

    def __len__(self) -> int:
        return len(self.sorted)

    def __iter__(self) -> Iterator[int]:
        return iter(self.sorted.tolist())

    def keys(self) -> set[int]:
        return set(self)

    def __getitem__(self, key: int | str) -> int:
        at = int(self.find(keys_of([key]) if isinstance(key, str) else np.array([key]))[0])
        if at < 0:
            raise KeyError(key)
        return at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        if not len(self.sorted):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return np.where(self.sorted[at] == keys, at, -1)


class Table:
    """Log frequencies of texts in each language, less their mean over the languages; of those seen twice at least."""

    def __init__(self, keys: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int):
        """Counts n of keys in languages by their numbers, each pair once."""
        own, row = np.unique(keys, return_inverse=True)
        seen = np.bincount(row, n, len(own)) >= 2
        self.rows = Rows(own[seen])
        at = (np.cumsum(seen) - 1)[row]
        keep = seen[row]
        c = np.full((len(self.rows), langs), 0.5)
        c[at[keep], lang[keep]] += n[keep]
        c /= c.sum(axis=0)
        self.logs = np.log(c, out=c)
        if langs:
            self.logs -= self.logs.mean(axis=1, keepdims=True)


class Model:
    """Tables of words and n-grams that were seen twice at least, in whatever languages."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        total: dict[tuple[str, str], int] = Counter()
        for lang, word, n in counts:
            total[lang, word] += n
        by, langs = with_grams(total), sorted({lang for lang, _ in total})
        size, lang = (np.array([f(k) for k in by], np.int64) for f in (lambda k: k[0], lambda k: langs.index(k[2])))
        keys, n = keys_of(k[1] for k in by), np.array(list(by.values()), np.int64)
        self._build(langs, [Table(keys[size == k], lang[size == k], n[size == k], len(langs)) for k in range(MAX_GRAM + 1)])

    @classmethod
    def of(cls, langs: list[str], tables: list[Table]) -> Model:
        """The model of the tables of words and of n-grams by their length."""
        out = cls.__new__(cls)
        out._build(langs, tables)
        return out

    def _build(self, langs: list[str], tables: list[Table]) -> None:
        self.langs = langs
        self.words, *self.grams = tables
        self.cache: dict[str, np.ndarray] = {}

    def unseen(self, words: list[str]) -> np.ndarray:
        """The scores of words that aren't known: of each the mean of its longest n-grams of which any is."""
        out, left = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        for n in range(MAX_GRAM, 0, -1):
            table, own = self.grams[n - 1], [grams(words[i], n) for i in left]
            of, at = np.repeat(left, [len(x) for x in own]), table.rows.find(keys_of(chain.from_iterable(own)))
            of, at = of[at >= 0], at[at >= 0]
            hits = np.bincount(of, minlength=len(words))
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(of, table.logs[at, k], len(words)) / np.maximum(hits, 1)
            left = left[hits[left] == 0]
            if not len(left):
                break
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) for t in texts]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs or not any(words):
            return langs, scores
        claim(self.cache)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        number = {w: i for i, w in enumerate(set(chain.from_iterable(words)))}
        cache = self.cache
        known = self.words.rows.find(keys_of(number))
        table = np.empty((len(number), len(self.langs)))
        table[known >= 0] = self.words.logs[known[known >= 0]]
        rest = [(w, i) for w, i in number.items() if known[i] < 0]
        new = [w for w, _ in rest if w not in cache]
        for k in range(0, len(new), 10_000):
            cache.update(zip(new[k : k + 10_000], self.unseen(new[k : k + 10_000]), strict=True))
        for w, i in rest:
            table[i] = cache[w]
        lengths = np.array([len(x) for x in words])
        some = np.flatnonzero(lengths)
        flat = table[np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64)]
        starts = (np.cumsum(lengths) - lengths)[some]
        total = np.add.reduceat(flat, starts, axis=0)
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        for i, k, x in zip(some.tolist(), total.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
            langs[i], scores[i] = self.langs[k], x
        return langs, scores


def sample(df: DataFrame, usable: Column, text_col: str, lang_col: str, max_docs: int | None) -> DataFrame:
    """(lang, text) of the different texts of each label, of about max_docs of them at most if there is a bound."""
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    rows = df.where(usable & lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    counted = [] if max_docs is None else rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).where(F.col("n") > max_docs).collect()
    if counted:  # labels with fewer texts need no choice
        shares = df.sparkSession.createDataFrame([(r.lang, max_docs * HASHES // r.n) for r in counted], "lang string, share long")
        rows = rows.join(F.broadcast(shares) if len(counted) <= BROADCAST_LABELS else shares, "lang", "left").where(F.col("share").isNull() | (F.pmod("h", F.lit(HASHES)) < F.col("share")))
    return rows.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def train(df: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", max_docs: int | None = MAX_DOCS_PER_LANG) -> Model:
    """A model of the usable rows with a label and a text; of all of them if max_docs is None."""
    chosen = sample(df, usable, text_col, lang_col, max_docs)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter[str]] = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            for lang, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c, pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "word", "n"])
            by.clear()

        for batch, texts in slices(batches, 1, COUNT_CHARS):
            for lang, t in zip(strings(batch.column(0)), texts, strict=True):
                by[lang].update(words_of(t))
            if sum(map(len, by.values())) > KEPT_COUNTS:
                yield from told()
        yield from told()

    spark = df.sparkSession
    words = written(map_batches(chosen, ["lang", "text"], count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    number = {lang: i for i, lang in enumerate(langs)}

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str, int], int] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            columns = [pa.array([k[0] for k in sums], pa.int32()), pa.array(keys_of(k[1] for k in sums)), pa.array([k[2] for k in sums], pa.int32()), pa.array(sums.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["size", "key", "lang", "n"])
            sums.clear()

        for batch in batches:
            own = [number[x] for x in strings(batch.column(0))]
            counts = dict(zip(zip(own, strings(batch.column(1)), strict=True), batch.column(2).to_pylist(), strict=True))
            for k, n in with_grams(counts).items():
                sums[k] += n
            if len(sums) > KEPT_COUNTS:
                yield from told()
        yield from told()

    by_lang = map_batches(words, ["lang", "word", "n"], count_grams, "size int, key long, lang int, n long").groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))
    pairs = F.collect_list(F.struct("lang", "n")).alias("pairs")
    # what was seen once is in no table
    seen = written(by_lang.groupBy("size", "key").agg(F.sum("n").alias("n"), pairs).where("n >= 2").select("size", "key", F.explode("pairs").alias("pair")).select("size", "key", "pair.lang", "pair.n"), "counts")

    def of_size(size: int) -> Table:
        counts = seen.where(F.col("size") == size).select("key", "lang", "n").toArrow()
        return Table(*(c.to_numpy() for c in counts.columns), len(langs))

    try:
        model = Model.of(langs, [of_size(k) for k in range(MAX_GRAM + 1)])
    finally:
        remove(spark, words.path, seen.path)
    settle(spark)
    return model


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id alone unless named), lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = keep or [id_col]
    schema = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, len(keep)):
            langs, scores = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f"c{i}" for i in range(len(keep))), "lang_pred", "score"])

    out = map_batches(df, [*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text")], work, f"{schema}, lang_pred string, score double")
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(keep)})


def accepted(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df, all columns, whose language is known with a score of at least `least`."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> tuple[list[bool], None]:
        langs, scores = shared.value.predict(texts)
        return [a != UNKNOWN and s >= least for a, s in zip(langs, scores, strict=True)], None

    return rewrite(df, text_col, work)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that train nothing: crc32 of the id as text leaves 2 when divided by 4. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
