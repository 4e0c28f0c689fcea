"""What the operators share: the two input columns, Arrow batches of a bounded size, rows picked by a list."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 32 << 20

#: White space between words, as a Java and RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 32 MB, whatever the length of the texts; a smaller setting of the session stays."""
    now = int(spark.conf.get(BATCH_BYTES_KEY, str(2**31 - 1)))
    if now > BATCH_BYTES or now <= 0:
        spark.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone, so that no other column of the input can clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *more
    )


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of an Arrow text column."""
    return column.cast(pa.binary()).to_pylist()


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that name a row by its id and the SHA-256 of its text; rows that share both are copies of one row."""
    return [
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("none")).alias("__key_id"),
        F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("__key_text"),
    ]


def pick(docs: DataFrame, listed: DataFrame, once: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows of ``docs`` whose (doc_id, raw_sha256) is in ``listed``.

    ``once`` keeps one of the rows that share id and text. Both sides are
    shuffled by the pair, which is spread evenly even when one text or a
    missing id is frequent, unless both repeat together.
    """
    keyed = docs.withColumns(dict(zip(("__key_id", "__key_text"), row_key(docs, id_col, text_col), strict=True)))
    names = listed.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("__key_id"), F.col("raw_sha256").alias("__key_text")
    )
    found = keyed.join(names, ["__key_id", "__key_text"], "left_semi")
    if once:
        found = found.dropDuplicates(["__key_id", "__key_text"])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def join_hot(left: DataFrame, right: DataFrame, key: str, share: int = 64) -> DataFrame:
    """Left join on ``key``, which is unique in ``right``; frequent keys are not shuffled.

    A key with more than 1/``share`` of the rows is frequent, so there are fewer
    than ``share`` of them: their rows of ``right`` are broadcast. Rows without a
    key have no partner and are not shuffled either. ``left`` is read several
    times: a written table.
    """
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = [r[key] for r in counts.filter(F.col("__n") > max(1000, left.count() // share)).select(key).collect()]
    added = [F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c != key]
    bare = left.filter(F.col(key).isNull()).select("*", *added)
    rest = left.filter(F.col(key).isNotNull())
    if not hot:
        return rest.join(right, key, "left").unionByName(bare)
    listed = F.col(key).isin(hot)
    few = rest.filter(listed).join(F.broadcast(right.filter(listed)), key, "left")
    return rest.filter(~listed).join(right, key, "left").unionByName(few).unionByName(bare)
