"""Registered queries of the operators and their SQL twins; nothing here reads less than the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.llm import alignment, byte_bpe, conversation_repair, exact_dedup, fingerprints, html_extract, language_id, minhash, mixing, suffix_dedup, token_counts, toxicity, trie_bpe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, d))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` declare a language and name a source, which stands for the host; they have no address."""
    found = language_id.identify(documents(spark, d), declared="lang", host="source")
    return found.select("doc_id", "declared", "host", "text_language", "language", "probability", "accepted")


@query("language_of_pages")
def language_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """``pages`` declare a language in their markup and have an address."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    said = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    rows = pages.select("page_id", "url", bare.alias("text"), said.alias("markup"))
    found = language_id.identify(rows, id_col="page_id", declared="markup", address="url")
    return found.select(F.col("doc_id").alias("page_id"), "declared", "host", "text_language", "language", "probability", "accepted")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('mix:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
  FROM d GROUP BY source),
t AS (SELECT CAST(sum(source_size) AS BIGINT) AS words, CAST(sum(w) AS BIGINT) AS weights FROM s),
o AS (
  SELECT s.*, words, weights,
    coalesce(sum(3 * source_size) OVER before, 0) AS gone_words, coalesce(sum(w) OVER before, 0) AS gone_weights
  FROM s, t WINDOW before AS (ORDER BY source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w * (words - gone_words) >= 3 * source_size * (weights - gone_weights) AS full_up FROM o),
l AS (SELECT CAST(max(words) - coalesce(sum(3 * source_size) FILTER (full_up), 0) AS DOUBLE) AS words,
        CAST(max(weights) - coalesce(sum(w) FILTER (full_up), 0) AS DOUBLE) AS weights FROM c),
target AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), l.words * w / CASE WHEN l.weights = 0 THEN 1.0::DOUBLE ELSE l.weights END) AS target
  FROM c, l),
r AS (
  SELECT doc_id, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM r
"""


@query("op3_source_mix", MIX_SQL)
def op3_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, d)).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, d))


@query("op5_near_copies")
def op5_near_copies(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_copies(documents(spark, d)).select("doc_id", "class_id", "class_size", "kept")


@query("op6_main_text")
def op6_main_text(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{d}/pages.parquet"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.bpe_digests(documents(spark, d), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose crc32 of the id leaves 2 of 4 are held out of the training."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = toxicity.score(documents(spark, d), labels.filter(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


DEDUP_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""


@query("op9_exact_dedup", DEDUP_SQL)
def op9_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, d)).drop("raw_sha256")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """The cache starts empty, so that every distinct content is encoded."""
    return token_counts.token_counts(documents(spark, d), public_tokenizers.path(WORD_TOKENIZER), token_counts.fresh_cache(spark))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(documents(spark, d), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


@query("op12_trie_bpe")
def op12_trie_bpe(spark: SparkSession, d: str) -> DataFrame:
    return trie_bpe.digests(documents(spark, d), public_tokenizers.path(WORD_TOKENIZER))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return conversation_repair.repair(spark.read.parquet(f"{d}/conversations.parquet"))
