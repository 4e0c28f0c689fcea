"""Interaction log operators: filters, time split, indices, matrix shape, list constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfspark import schemas
from shelfspark.functions import values
from shelfspark.operators import skew
from shelfspark.runtime import cut_lineage

STATUSES = ["watching", "completed", "on_hold", "dropped", "plan_to_watch"]


def keep_frequent(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """Rows whose key occurs often enough: counts combine map-side, then a semi join."""
    often = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least).select(key)
    return df.join(often, key, "left_semi")


def min_count_filter(df: DataFrame, min_user: int = 5, min_item: int = 5) -> DataFrame:
    """Users, then items, below their minimum are dropped; two rounds, not a fixed point.

    Each round reads its input twice per key, so a round starts from a written
    table instead of repeating everything before it.
    """
    for _ in range(2):
        df = cut_lineage(df, "min-count")
        df = keep_frequent(keep_frequent(df, "user_id", min_user), "item_id", min_item)
    return df


def time_split(df: DataFrame, test_frac: float = 0.2, max_rows: int = skew.MAX_ROWS_PER_KEY) -> DataFrame:
    """Adds ``split``: each user's last rows by (ts, item) are 'test'.

    k = min(max(1, half-even round(n * frac)), n - 1): a single row stays in train.
    """
    ranked = skew.row_numbers(df, ["user_id"], [F.desc("ts"), F.desc("item_id")], "_rn", max_rows)
    counts = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    k = F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(test_frac), 0).cast("long")), F.col("_n") - 1)
    split = F.when(F.col("_rn") <= k, "test").otherwise("train")
    return ranked.join(counts, "user_id").withColumn("split", split).drop("_rn", "_n")


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def interaction_gap(
    df: DataFrame, keys: list[str], ts_col: str, tie: str, max_rows: int = skew.MAX_ROWS_PER_KEY
) -> DataFrame:
    """Seconds since the previous row of the same key; the first row has none."""
    lagged = skew.previous_value(df, keys, [F.asc(ts_col), F.asc(tie)], ts_col, "prev_ts", max_rows)
    return lagged.withColumn("time_since_last", values.seconds_between(F.col(ts_col), F.col("prev_ts")))


def index_ids(df: DataFrame) -> DataFrame:
    """(user_idx, item_idx, score) through dense maps of users and items."""
    users = skew.dense_index(df, "user_id", "user_idx")
    items = skew.dense_index(df, "item_id", "item_idx")
    return df.join(users, "user_id").join(items, "item_id").select("user_idx", "item_idx", "user_id", "item_id", "score")


def implicit(df: DataFrame, threshold: int = 7) -> DataFrame:
    """1 at or above the threshold, else an explicit 0 that still counts as stored."""
    return df.withColumn("value", F.when(F.col("score") >= threshold, 1.0).otherwise(0.0))


def matrix_stats(df: DataFrame) -> DataFrame:
    """(n_users, n_items, nnz, density): nnz counts distinct cells."""
    sides = df.agg(
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        F.countDistinct("user_id", "item_id").alias("nnz"),
    )
    cells = F.col("n_users") * F.col("n_items")
    return sides.withColumn("density", F.when(cells > 0, F.round(F.col("nnz") / cells, 8)).otherwise(0.0))


def ratings_from_list(df: DataFrame) -> DataFrame:
    """List entries to positive ratings: explicit score / 10, else the weight of the status."""
    return df.select("user_id", "item_id", values.status_rating(F.col("status"), F.col("score")).alias("rating")).filter(
        "rating > 0"
    )


def crosstab(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


def duplicate_pairs(df: DataFrame) -> DataFrame:
    return crosstab(df).filter("n > 1")


def pivot_matrix(df: DataFrame, items: list, value: str = "score") -> DataFrame:
    """Wide user x item rows for a short, given item list; a duplicate pair raises."""
    if not duplicate_pairs(df).isEmpty():
        raise ValueError("a (user, item) pair occurs more than once")
    return df.groupBy("user_id").pivot("item_id", items).agg(F.first(value))


def list_violations(df: DataFrame) -> DataFrame:
    """Adds ``reason``: null for a valid entry, else the first broken rule."""
    counts = crosstab(df).withColumnRenamed("n", "_n")
    reason = (
        F.when(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "invalid status")
        .when(~F.coalesce(F.col("score").between(1, 10), F.lit(True)), "score out of range")
        .when(F.col("_n") > 1, "duplicate entry")
    )
    return df.join(counts, ["user_id", "item_id"]).withColumn("reason", reason).drop("_n")


def valid_entries(df: DataFrame) -> DataFrame:
    return list_violations(df).filter("reason is null").drop("reason")


def quarantined(df: DataFrame) -> DataFrame:
    return list_violations(df).filter("reason is not null")


def parse_entries(payloads: DataFrame) -> DataFrame:
    """(user_id, fmt, payload, fallback) rows to (user_id, item_id, score, scored_at) entries."""
    lists = F.from_json("payload", schemas.LIST_PAYLOAD)["data"]["MediaListCollection"]["lists"]
    entries = (
        payloads.select("user_id", "fmt", "fallback", F.explode(lists).alias("l"))
        .select("user_id", "fmt", "fallback", F.explode("l.entries").alias("e"))
        .select(
            "user_id",
            F.col("e.media.idMal").alias("item_id"),
            values.normalize_score(F.col("e.score"), F.col("fmt")).alias("score"),
            values.partial_date(F.col("e.completedAt"), F.col("fallback")).alias("scored_at"),
        )
    )
    return entries.filter(F.col("item_id").isNotNull() & (F.col("item_id") != 0) & F.col("score").isNotNull())


def drop_unscored(df: DataFrame, score: str = "score") -> DataFrame:
    return df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score)))

