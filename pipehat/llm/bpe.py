"""BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each distinct word. A segmentation is the one BPE gives exactly when every
two adjacent tokens would also come out side by side if their joined text were encoded alone, so one vectorised pass over
all adjacent pairs accepts most words. Words with a failing pair are merged exactly, by rank, with a heap.

Holds for vocabularies whose id order is the merge order and whose tokens encode to themselves (``self_consistent`` tells).
Null or empty text gives no tokens and an empty decoded text. Rows are independent: ties, repeated rows and null ids pass
through as they are. Memory is bounded by a slice of the batch and by CACHE_WORDS.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipehat.llm.arrow import claim, map_batches, slices

CACHE_WORDS = 200_000
#: Texts of these characters alone are normalised and split here; any other text goes through the library's own normaliser.
PLAIN = re.compile(r"[\x09\x0A\x0D\x20-\x7E¡-¬®-įı-ž‐-‧€]*+")
LETTERS, NUMBERS = "a-zªµºß-öø-ÿĀ-ž", "0-9²³¹¼-¾"  # of PLAIN texts in lower case
WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
#: Up to so many symbols a scan for the lowest rank beats the heap.
SHORT = 40
END = "</w>"


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Model:
    """A tokenizers JSON file of a BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = t
        self.library = Tokenizer.from_file(path)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): self.vocab[a + b] for a, b in pairs}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        codes = np.array([(a << 32) | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.made = codes[order], np.fromiter(self.merges.values(), np.int64)[order]
        self.left = np.arange(len(self.tokens), dtype=np.int64)
        self.right = self.left.copy()
        for (a, b), c in self.merges.items():
            self.left[c], self.right[c] = a, b
        self.alphabet = byte_alphabet()
        self.latin = {b: c for b, c in self.alphabet.items() if chr(b) != c}
        self.cache: dict[str, tuple[int, ...]] = {}

    # -- words of a text ------------------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return WORDS.findall(text.lower())
        lib, back = self.library, {c: b for b, c in self.alphabet.items()}
        pieces = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [bytes(back[c] for c in p).decode("utf-8") for p, _ in pieces]

    def parts(self, text: str) -> list[list[str] | int]:
        """Words between the special tokens, whose ids stand for themselves."""
        if self.specials is None or "<|" not in text:
            return [self.words(text)]
        return [self.added[x] if i % 2 else self.words(x) for i, x in enumerate(self.specials.split(text))]

    # -- tokens of words ------------------------------------------------------------------------------------------
    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.latin)

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left."""
        s, find, longest, out, i = self.symbols(word), self.vocab.get, self.longest, [], 0
        n = len(s)
        while True:
            if n - i <= longest and (t := find(s[i:] + END)) is not None:
                out.append(t)
                return out
            j = n - 1 if n - 1 < i + longest else i + longest
            while (t := find(s[i:j])) is None:
                j -= 1
            out.append(t)
            i = j

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of tokens, whether BPE leaves them side by side: undo merges next to the seam, the latest first, and
        fail where a merge across the seam would have come before the one undone."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            code = (a << 32) | b
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            bad = (self.codes[k] == code) & (self.made[k] < limit)
            good[at[bad]] = False
            right_a, left_b = self.right[a], self.left[b]
            use_a = (a > b) & (right_a != a) | (a <= b) & (left_b == b) & (right_a != a)
            use_b = ~use_a & (left_b != b)
            limit = np.where(use_a, a, np.where(use_b, b + 1, limit))
            a, b = np.where(use_a, right_a, a), np.where(use_b, left_b, b)
            go = ~bad & (use_a | use_b)
            a, b, limit, at = a[go], b[go], limit[go], at[go]
        return good

    def exact(self, word: str) -> list[int]:
        """Merges by rank, leftmost first, in n log n."""
        s = self.symbols(word)
        ids = [self.vocab[c] for c in s[:-1]] + [self.vocab[s[-1] + END]]
        n = len(ids)
        if n <= SHORT:
            get, never = self.merges.get, len(self.tokens)
            ranks = [get(p, never) for p in zip(ids, ids[1:])]
            while ranks and (m := min(ranks)) < never:
                i = ranks.index(m)
                ids[i : i + 2] = [m]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], m), never)
                if i < len(ranks):
                    ranks[i] = get((m, ids[i + 1]), never)
            return ids
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = m, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for p, q in ((prev[i], i), (i, nxt[i])):
                if p >= 0 and q < n and (x := self.merges.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (x, p, ids[p], ids[q]))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def learn(self, words: set[str]) -> None:
        """Put the tokens of new words in the cache."""
        new = list(words)
        proposed = [self.propose(w) for w in new]
        flat = np.fromiter(chain.from_iterable(proposed), np.int64)
        of = np.repeat(np.arange(len(new)), [len(p) for p in proposed])
        if len(flat) > 1:
            inside = np.flatnonzero(of[1:] == of[:-1])
            code, back = np.unique((flat[inside] << 32) | flat[inside + 1], return_inverse=True)
            good = self.compatible(code >> 32, code & 0xFFFFFFFF)
            for w in np.unique(of[inside[~good[back]]]).tolist():
                proposed[w] = self.exact(new[w])
        self.cache.update(zip(new, map(tuple, proposed), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        parts = [self.parts(t) if t else [] for t in texts]
        claim(self.cache)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = {w for ps in parts for p in ps if isinstance(p, list) for w in p if w not in cache}
        if new:
            self.learn(new)
        return [list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(cache.__getitem__, p)) for p in ps)) for ps in parts]

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def self_consistent(self) -> bool:
        """Whether each merge's parts, encoded from their bytes, end as that merge."""
        return all(self.exact_symbols(t) == [i] for t, i in self.vocab.items())

    def exact_symbols(self, token: str) -> list[int]:
        """exact() for a token's own symbols, with or without a word end."""
        s, end = token.removesuffix(END), token.endswith(END)
        ids = [self.vocab[c] for c in s]
        if end:
            ids[-1] = self.vocab[s[-1] + END]
        while True:
            found = [(m, i) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1]))) is not None]
            if not found:
                return ids
            m, i = min(found)
            ids[i : i + 2] = [m]


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """doc id, ids array<int> and the text decoded from them. tokenizer: the file's path, readable on every executor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(tokenizer)
        for batch, texts in slices(batches, 1):
            ids = m.encode_batch(texts)
            out = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if decode:
                out.append(pa.array([m.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])

    kind = df.schema[id_col].dataType.simpleString()
    out = map_batches(df, [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], work, f"id {kind}, ids array<int>" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Counts and SHA-256 of what encode_decode() gives, then the kept columns."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *keep,
    )
