"""Token counts by linear longest match.

A trie of the vocabulary gets a failure link at every node: where the string down to a node is cut into its greedy longest
tokens, the link leads to the node of what is left, and a count says how many tokens were cut off. One pass over a word then
follows children, and failure links where there is no child, adding up counts: linear in the word, and no piece is ever built.

Words are the runs between white space; each begins with the vocabulary's mark for a leading space. The vocabulary holds
every single byte, so no word is unknown. Null or empty text has no words and no pieces. Rows are independent.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipehat.llm.arrow import claim, map_batches, slices
from pipehat.llm.bpe import byte_alphabet

CACHE_WORDS = 300_000


class Automaton:
    def __init__(self, tokens: list[bytes]):
        """Nodes are numbers; 0 is the root. next[node << 8 | byte] is a child."""
        self.next: dict[int, int] = {}
        parents, is_token = [(0, 0)], [False]
        for t in tokens:
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in self.next:
                    self.next[key] = len(parents)
                    parents.append((node, b))
                    is_token.append(False)
                node = self.next[key]
            is_token[node] = is_token[node] or bool(t)
        children: dict[int, list[int]] = {}
        for child, (parent, _) in enumerate(parents[1:], 1):
            children.setdefault(parent, []).append(child)
        self.fail: list[int] = [-1] * len(parents)  # -1: nothing to fall back to
        self.popped = [0] * len(parents)
        queue = deque([0])
        while queue:
            for v in children.get(queue[0], ()):
                queue.append(v)
                if is_token[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                u, b = parents[v]
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and (z << 8 | b) not in self.next:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z << 8 | b], n
            queue.popleft()
        self.cache: dict[str, int] = {}

    def count(self, data: bytes) -> int:
        """Number of greedy longest tokens of data, or -1 if no cut of it exists."""
        node, n, find, fail, popped = 0, 0, self.next.get, self.fail, self.popped
        for b in data:
            while (child := find(node << 8 | b)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = child
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return n

    def lengths(self, words: list[str]) -> list[int]:
        """Pieces of each word, a space put before it."""
        cache = self.cache
        claim(cache)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.count(b" " + w.encode("utf-8", "surrogatepass"))
        return list(map(cache.__getitem__, words))


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Of the tokens of a byte-level tokenizers file."""
    back = {c: b for b, c in byte_alphabet().items()}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    return Automaton([bytes(back[c] for c in t) for t in spec["model"]["vocab"] if t not in special])


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_pieces, longest_word): longest_word is the most pieces of a word, 0 without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(tokenizer)
        for batch, texts in slices(batches, 1):
            words = [t.split() if t else [] for t in texts]
            flat, at, rows = a.lengths(list(chain.from_iterable(words))), 0, []
            for w in words:
                own = flat[at : at + len(w)]
                at += len(w)
                rows.append((len(w), sum(own), max(own, default=0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=["id", "n_words", "n_pieces", "longest_word"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df, [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], work, f"id {kind}, n_words long, n_pieces long, longest_word long").withColumnRenamed("id", id_col)
