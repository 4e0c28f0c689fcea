"""Writers: snapshots with a content digest, run manifests, CSV, line JSON, keyed JSON, vector tables."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

DATA_SOURCES = ("real", "simulated")


def row_hash(df: DataFrame):
    """64-bit hash of a row; columns in name order, so column order does not matter."""
    return F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))


def content_digest(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest). Invariant under row order and partitioning: a sum over row hashes."""
    hashed = df.select(row_hash(df).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"),
    )


def write_snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write once, then digest what was written. Returns the one-row digest."""
    df.write.mode("errorifexists").parquet(path)
    return content_digest(df.sparkSession.read.parquet(path))


def run_manifest(
    metrics: DataFrame, run: str, params: dict, data_source: str, started: datetime, digest: str | None = None
) -> DataFrame:
    """One manifest row out of a one-row metrics frame; doubles are rounded to 6 places."""
    if data_source not in DATA_SOURCES:
        raise ValueError(f"data_source must be one of {DATA_SOURCES}")
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    return metrics.select(
        F.lit(run).alias("run"),
        F.lit(data_source).alias("data_source"),
        F.lit(json.dumps(params, sort_keys=True)).alias("params"),
        F.to_json(F.struct(*rounded)).alias("metrics"),
        F.lit(digest).alias("dataset_digest"),
        F.lit(started.isoformat()).alias("start_time"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. Arrays and structs are written as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def keyed_json(df: DataFrame, namespace: str, id_col: str, order_col: str | None = None) -> DataFrame:
    """(namespace, id, value JSON): null ids skipped; the latest row by ``order_col`` wins per id."""
    kept = df.filter(F.col(id_col).isNotNull())
    body = F.struct(*df.columns)
    if order_col is not None:
        kept = kept.groupBy(id_col).agg(F.max_by(body, order_col).alias("v"))
    else:
        kept = kept.select(id_col, body.alias("v"))
    return kept.select(F.lit(namespace).alias("namespace"), F.col(id_col).cast("string").alias("id"), F.to_json("v").alias("value"))


def lookup_keyed(store: DataFrame, namespace: str, key: str) -> DataFrame:
    return store.filter((F.col("namespace") == namespace) & (F.col("id") == key))


def vector_points(rows: DataFrame, vector: str = "vector", vector_alt: str | None = None, max_synopsis: int | None = None) -> DataFrame:
    """(id, vector[, vector_vi], payload struct): the shape of the vector table."""
    synopsis = F.coalesce("synopsis", F.lit(""))
    payload = F.struct(
        "mal_id",
        "title",
        F.array_join("genres", ", ").alias("genres"),
        "year",
        "score",
        "image_url",
        (synopsis if max_synopsis is None else F.substring(synopsis, 1, max_synopsis)).alias("synopsis"),
    ).alias("payload")
    cols = [F.col("mal_id").alias("id"), F.col(vector).alias("vector")]
    if vector_alt:
        cols.append(F.col(vector_alt).alias("vector_vi"))
    return rows.select(*cols, payload)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int = 64) -> None:
    """Bucketed table so that later upserts and look-ups by ``key`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
