"""Stages from raw documents to encoded training text; each reads what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.llm import byte_bpe, exact_dedup, language_id, minhash, mixing
from shelfspark.llm.queries import BYTE_RANKS
from shelfspark.llm.rows import pick, row_key
from shelfspark.runtime import scratch_path


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the known languages; ``lang`` stays as declared."""
    named = language_id.identify(docs, declared="lang", host="source")
    return pick(docs, named.filter("accepted"), once=False)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The owner of each text."""
    return pick(docs, exact_dedup.exact_dedup(docs).filter("kept"), once=True)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each class of near copies."""
    return pick(docs, minhash.near_copies(docs).filter("kept"), once=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    plan = mixing.mix_plan(docs).filter("copies > 0").select("doc_id", "raw_sha256", "copies").distinct()
    key_id, key_text = row_key(docs)
    named = plan.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("__key_id"), F.col("raw_sha256").alias("__key_text"), F.col("copies").alias("__copies")
    )
    found = docs.withColumns({"__key_id": key_id, "__key_text": key_text}).join(named, ["__key_id", "__key_text"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return byte_bpe.bpe_digests(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("byte_bpe", encoded),
]

#: Language scores, signatures and byte pairs have no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
