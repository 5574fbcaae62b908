"""From documents to token ids: language ID, near-dedup, decontamination, secrets, BPE.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the last return the columns of
documents. Decisions take effect: texts without a known language go, one document of each near-duplicate class stays,
documents that hold benchmark passages go, secrets are masked, texts become token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipehat.llm import bpe, decontaminate, language, near_dup, secrets
from pipehat.llm.queries import WORD_BPE, tokenizer
from pipehat.runtime import remove, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop null texts, texts without a letter and texts whose language stays in doubt (score under one half)."""
    return language.accepted(docs, language.train(docs, F.lit(True), max_docs=None))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each class of near duplicates."""
    return near_dup.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose tiles cover a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets; n_chars follows the text."""
    out = secrets.mask(docs, secrets.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids."""
    encoded = bpe.encode_decode(docs, tokenizer(WORD_BPE))
    return bpe.digests(encoded, keep=["ids"])


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", token_ids),
]

#: Signatures, a trained model, tiles and merges by rank can't be said in SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = written(stage(spark, docs, sf_dir), name.split()[0].lower())
        remove(spark, before)
        docs, before = out, out.path
    return docs
