"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipehat.llm import bpe, decontaminate, fingerprint, html_text, language, licenses, near_dup, secrets, wordpiece
from pipehat.llm.shards import ShardStore
from pipehat.runtime import scratch, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
ARRIVALS = 4


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE)))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS batches, are compacted, and come from the last version."""
    docs, store = table(spark, sf_dir, "documents"), ShardStore(spark, scratch(spark, "store"))
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~language.held_out())
    return language.identify(docs.withColumn("held_out", language.held_out()), model, keep=["doc_id", "held_out"])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").cast("long").alias("n_tiles"), F.aggregate("tiles", F.lit(0), lambda n, t: n + t["words"]).cast("long").alias("n_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_licenses, op3_html_text, op4_near_duplicates, op5_token_counts, op6_fingerprints, op7_shards, op8_language, op9_secrets, op10_decontaminate)
}

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents),
d AS (SELECT text, min(doc_id) AS id, any_value(ws) AS ws FROM w WHERE text IS NOT NULL GROUP BY text),
s AS (
  SELECT id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END AS sh
  FROM d WHERE len(ws) > 0
),
x AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(sh) AS g FROM s) GROUP BY id, g),
t AS (SELECT id, sum(n) AS total FROM x GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS common FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
e AS (SELECT a, b FROM c JOIN t p ON p.id = a JOIN t q ON q.id = b WHERE common >= 0.8 * (p.total + q.total - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, root) AS (SELECT id, id FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id),
k AS (SELECT id, min(root) AS class_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(k.class_id, w.doc_id) AS class_id, w.doc_id = coalesce(k.class_id, w.doc_id) AS is_representative
FROM w LEFT JOIN d ON d.text = w.text LEFT JOIN k ON k.id = d.id
"""

ORACLES: dict[str, str] = {
    "op4_near_duplicates": NEAR_DUPLICATES_SQL,
    "op7_shards": "SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM documents",
}
