"""Secret scan: fixed patterns, and two character Markov models compared by their log-likelihood ratio.

Base patterns find assignments to password-like names, access keys and long hexadecimal runs. Beside them every run of 16 or more
identifier characters is scored by a first-order Markov model of random strings and one of ordinary identifiers: it is a secret
when the log-likelihood ratio of its transitions passes a threshold. Both models are trained on labelled samples: random strings
drawn by a seeded generator from the usual alphabets, and identifiers, numbers and long words put together from the words of
all texts outside their base spans, copies once. The texts fall into halves by their hash. Both halves train; for the threshold
each half's identifiers are scored by what the other trained, and FALSE_ALARMS of all of them pass. Only transition counts and a
histogram of scores reach the driver.

A run is scored wherever it lies, so that a markov span may lie on, beside or around a base span. Offsets are code points, ends
exclusive. Null or empty text has no spans. Rows are independent; ties, repeated rows and null ids pass through. A table without
texts trains on the random strings and a few ordinary names only.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipehat.llm.arrow import map_batches, rewrite, slices
from pipehat.llm.hot import dealt_join, hot_values
from pipehat.runtime import remove, written

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Cheap signs that an assignment can stand in a text.
NAMES = ("passw", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
NO_HEX = np.ones(256, bool)
NO_HEX[[ord(c) for c in "0123456789abcdef"]] = False
TRAIN_STRINGS, FALSE_ALARMS = 6_000, 0.0005
#: Characters that training takes at a time, and sums that a worker keeps before it hands them on.
COUNT_CHARS, KEPT_SUMS = 250_000, 200
#: Texts with copies up to which their numbers of copies are broadcast.
BROADCAST_COPIES = 1 << 20
#: The least log-likelihood ratio of a secret: random strings are taken to be so much rarer than ordinary ones.
LEAST = math.log(1000)
#: Scores above this count as this when the threshold is sought.
MOST_STEPS = 10_000
ORDINARY = ("identifier", "document", "version", "number", "value", "index", "config", "update", "default", "example", "page", "item", "user", "order", "count")
WORDS = re.compile(r"(?a)\b[A-Za-z]{2,}\b")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    low = text.lower() if text.isascii() else None
    spans = []
    if low is None or any(n in low for n in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if longest_hex(text) >= 24:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def longest_hex(text: str) -> int:
    """The length of the longest run of hexadecimal digits in small letters."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return int(np.diff(np.flatnonzero(NO_HEX[b]), prepend=-1, append=len(b)).max()) - 1


def random_string(rnd: random.Random) -> str:
    letters, digits = string.ascii_letters, string.digits
    alphabet = rnd.choice((letters + digits, letters + digits + "+/", string.ascii_uppercase + "234567", string.ascii_lowercase + digits, "0123456789abcdef", "0123456789ABCDEF", letters + digits + "_-", string.ascii_lowercase, letters))
    return "".join(rnd.choices(alphabet, k=rnd.randint(16, 64)))


#: One character again and again, characters in their usual order, and numbers of up to 1 to 4 digits, each kind as often.
REPEATED = [c * n for c in ALPHABET for n in range(16, 65)]
IN_ORDER = [(string.digits + letters)[i:] for letters in (string.ascii_lowercase, string.ascii_uppercase) for i in range(16)]
NUMBERS = [str(n) for most in (10, 100, 1000, 10_000) for n in range(most) for _ in range(10_000 // most)]


def identifiers(words: list[str], seed: str) -> list[str]:
    """Every 2 to 4 words in turn as one identifier, in one style after another: joined as programs, addresses and languages join
    them, every other time with a number; or a number, one character again and again, or characters in their usual order."""
    if not words:
        return []
    rnd, out = random.Random(seed), []
    ends = list(accumulate(rnd.choices((2, 3, 4), k=len(words) // 2 + 1)))
    ends = ends[: bisect_left(ends, len(words)) + 1]
    parts, first, r = list(zip([0, *ends], ends)), rnd.randrange(22), rnd.random
    for turn in range(22):
        own, style = parts[(turn - first) % 22 :: 22], turn % 11
        if style == 8:
            out += [f"{rnd.getrandbits(70) % 10**20:020d}"[: 16 + int(r() * 5)] for _ in own]
        elif style == 9:
            out += rnd.choices(REPEATED, k=len(own))
        elif style == 10:
            out += rnd.choices(IN_ORDER, k=len(own))
        else:
            mark = ("", "", "_", "_", "-", "/", "", "")[style]
            new = [words[a:b] for a, b in own]
            if turn > 10 and style < 6:
                for x, number in zip(new, rnd.choices(NUMBERS, k=len(own)), strict=True):
                    x.insert(int(r() * (len(x) + 1)), number)
            if style < 2:
                new = ["".join(map(str.capitalize, x)) for x in new]
                out += [x[0].lower() + x[1:] for x in new] if style else new
            elif style in (2, 7):
                out += [mark.join(x).upper() for x in new]
            else:
                out += [mark.join(x).lower() for x in new]
    return out


def steps(samples: list[str]) -> np.ndarray:
    """The number of every transition in the samples, one after another, each ended by a transition into and out of nothing."""
    c = CODE[np.frombuffer("\n".join((*samples, "")).encode(), np.uint8)]
    return c[:-1] * (len(ALPHABET) + 1) + c[1:]


def transitions(samples: list[str]) -> np.ndarray:
    """How often each character follows each other."""
    n = len(ALPHABET)
    return np.bincount(steps(samples), minlength=(n + 1) ** 2).reshape(n + 1, n + 1)[:n, :n]


class Model:
    """Transition logs of random strings less those of ordinary identifiers, whose transitions are given."""

    def __init__(self, ordinary: np.ndarray, seed: int = 11):
        rnd = random.Random(seed)
        secrets = [random_string(rnd) for _ in range(TRAIN_STRINGS)]
        plain = identifiers(list(ORDINARY) * 200, str(seed))
        half = TRAIN_STRINGS // 2
        self.ratio = self._logs(transitions(secrets[:half])) - self._logs(ordinary + transitions(plain))
        self.threshold, self.tests = LEAST, secrets[half:]

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        c = counts + 0.2
        return np.log(c / c.sum(axis=1, keepdims=True))

    def score(self, s: str) -> float:
        """The log-likelihood ratio of a run's transitions."""
        c = CODE[np.frombuffer(s.encode(), np.uint8)]
        return float(self.ratio[c[:-1], c[1:]].sum())

    def scores(self, samples: list[str]) -> np.ndarray:
        """The log-likelihood ratios of many runs, none of them empty."""
        if not samples:
            return np.empty(0)
        lengths = np.fromiter(map(len, samples), np.int64, len(samples))
        return np.add.reduceat(np.pad(self.ratio, ((0, 1), (0, 1))).ravel()[steps(samples)], np.cumsum(lengths + 1) - lengths - 1)

    @property
    def recall(self) -> float:
        """The share of random strings, other than those trained on, that pass."""
        return sum(self.score(s) > self.threshold for s in self.tests) / len(self.tests)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Runs that look random."""
        return [(*m.span()[:1], 3, m.end()) for m in CANDIDATE.finditer(text) if self.score(m.group()) > self.threshold]


def ordinary(text: str) -> list[str]:
    """Identifiers made of a text's words outside its base spans."""
    return identifiers(WORDS.findall(masked(text, base_spans(text), " ")), text[:100])


def train(df: DataFrame, text_col: str = "text") -> Model:
    """A model whose ordinary identifiers are made of the words of all texts, copies once."""
    text = F.col(text_col).cast("string")
    rows = df.where(text.isNotNull()).select(text.alias("text")).withColumn("h", F.xxhash64("text"))
    copies = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    n = copies.count()
    if n <= BROADCAST_COPIES:
        rows = rows.join(F.broadcast(copies), "h", "left")
    else:
        rows = dealt_join(rows.withColumn("place", F.monotonically_increasing_id()), copies, "h", hot_values(copies.withColumnRenamed("copies", "n"), "h", copies.agg(F.sum("copies")).first()[0]), "place", "left")
    half = F.pmod(F.shiftright("h", 40), F.lit(2)).cast("int")
    rows = rows.select(half.alias("half"), F.coalesce("copies", F.lit(1)).alias("copies"), "text")

    def summed(tell: Callable[[int, list[str]], np.ndarray]) -> list:
        """(half, what, n): the sums of tell(half, identifiers), which counts by `what`; copies count once, for what n rows of a
        text tell is summed and divided by n."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}

            def told() -> Iterator[pa.RecordBatch]:
                for (half, copies), x in sums.items():
                    at = np.flatnonzero(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), half, np.int32)), pa.array(np.full(len(at), copies)), pa.array(at), pa.array(x[at])], names=["half", "copies", "what", "n"])
                sums.clear()

            for batch, texts in slices(batches, 2, COUNT_CHARS):
                made: dict[tuple[int, int], list[str]] = {}
                for half, copies, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                    made.setdefault((half, copies), []).extend(ordinary(t))
                for key, samples in made.items():
                    x = tell(key[0], samples)
                    sums[key] = sums[key] + x if key in sums else x
                if len(sums) > KEPT_SUMS:
                    yield from told()
            yield from told()

        out = map_batches(rows, ["half", "copies", "text"], work, "half int, copies long, what long, n long").groupBy("half", "copies", "what").agg(F.sum("n").alias("n"))
        return out.groupBy("half", "what").agg(F.sum(F.expr("n div copies")).alias("n")).collect()

    try:
        counts = np.zeros((2, len(ALPHABET) ** 2), np.int64)
        for r in summed(lambda _, samples: transitions(samples).ravel()):
            counts[r.half, r.what] = r.n
        counts = counts.reshape(2, len(ALPHABET), -1)
        model, others = Model(counts.sum(axis=0)), [Model(counts[1]), Model(counts[0])]
        scored: dict[int, int] = {}
        for r in summed(lambda half, samples: np.bincount(np.clip(np.ceil(others[half].scores(samples)), 0, MOST_STEPS).astype(np.int64), minlength=MOST_STEPS + 1)):
            scored[r.what] = scored.get(r.what, 0) + r.n
    finally:
        remove(df.sparkSession, copies.path)
    allowed = FALSE_ALARMS * sum(scored.values())
    for step in sorted(scored, reverse=True):
        allowed -= scored[step]
        if allowed < 0:
            model.threshold = max(LEAST, float(step))
            break
    return model


def find_spans(text: str | None, model: Model | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind number, end) by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + model.spans(text)) if model else base


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join((*out, text[at:]))


def scan(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, n_assign, n_access, n_hex, base_spans and spans (kind:start:end)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            found = [find_spans(t, shared.value) for t in texts]
            columns = [batch.column(0), *(pa.array([sum(x[1] == k for x in b) for b, _ in found], pa.int64()) for k in range(3))]
            columns += [pa.array([shown(x[i]) for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return map_batches(df, [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], work, schema).withColumnRenamed("id", id_col)


def mask(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, every secret of their texts masked."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> tuple[None, list[str | None]]:
        found = [find_spans(t, shared.value)[1] for t in texts]
        return None, [masked(t, a) if a else t for t, a in zip(texts, found, strict=True)]

    return rewrite(df, text_col, work)
