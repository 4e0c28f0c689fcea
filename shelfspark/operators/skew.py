"""Full-order windows that survive a hot key.

A plain ``W.partitionBy(key)`` sorts each key's rows in one task. That is right
until one key holds a large share of the table. The functions below first count
rows per key (map-side combined); keys above ``max_rows`` take a second route:
their rows are range-partitioned on (key, order), written once to the shared
checkpoint folder so that the cut points stay fixed, and handled chunk by
chunk with a small per-chunk carry. Both routes give the same rows.

Top-k windows (``row_number() <= k``) do not need this: Spark keeps only k rows
per key on the map side before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfspark.runtime import block_count, cut_lineage

MAX_ROWS_PER_KEY = 5_000_000
_CHUNK = "_chunk"


def hot_keys(df: DataFrame, keys: list[str], max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Keys with more than ``max_rows`` rows: at most (table rows / max_rows) of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)


def split_hot(df: DataFrame, keys: list[str], max_rows: int = MAX_ROWS_PER_KEY):
    """``(cold, hot, hot_rows)``; ``hot`` is None when no key is above the limit."""
    hot = hot_keys(df, keys, max_rows)
    found = hot.agg(F.count(F.lit(1)).alias("k"), F.sum("_n").alias("n")).first()
    if not found["k"]:
        return df, None, 0
    marks = hot.select(*keys)
    # proven bound: each hot key owns more than max_rows rows
    marks = F.broadcast(marks) if found["k"] <= 100_000 else marks
    return df.join(marks, keys, "left_anti"), df.join(marks, keys, "left_semi"), found["n"]


def _chunked(hot: DataFrame, rows: int, keys: list[str], order: list[Column], max_rows: int) -> DataFrame:
    parts = 2 * block_count(rows, max_rows)
    ranged = hot.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(_CHUNK, F.spark_partition_id()))


def row_numbers(
    df: DataFrame, keys: list[str], order: list[Column], out: str = "rn", max_rows: int = MAX_ROWS_PER_KEY
) -> DataFrame:
    """``row_number`` per key; ``order`` must be total within a key."""
    cold, hot, n = split_hot(df, keys, max_rows)
    plain = cold.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    if hot is None:
        return plain
    chunks = _chunked(hot, n, keys, order, max_rows)
    before = (
        chunks.groupBy(*keys, _CHUNK)
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.sum("_c").over(W.partitionBy(*keys).orderBy(_CHUNK)) - F.col("_c"))
        .drop("_c")
    )
    local = chunks.withColumn("_local", F.row_number().over(W.partitionBy(*keys, _CHUNK).orderBy(*order)))
    ranked = local.join(before, [*keys, _CHUNK]).withColumn(out, (F.col("_local") + F.col("_before")).cast("long"))
    return plain.unionByName(ranked.drop(_CHUNK, "_local", "_before"))


def previous_value(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: str,
    out: str,
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """``lag(value)`` per key in a total order."""
    cold, hot, n = split_hot(df, keys, max_rows)
    plain = cold.withColumn(out, F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))
    if hot is None:
        return plain
    chunks = _chunked(hot, n, keys, order, max_rows)
    inside = W.partitionBy(*keys, _CHUNK).orderBy(*order)
    local = chunks.withColumn("_rn", F.row_number().over(inside)).withColumn("_lag", F.lag(value).over(inside))
    tails = (
        local.withColumn("_tail", F.row_number().over(W.partitionBy(*keys, _CHUNK).orderBy(F.desc("_rn"))))
        .filter("_tail = 1")
        .select(*keys, _CHUNK, F.col(value).alias("_last"))
    )
    carry = tails.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy(_CHUNK))).drop("_last")
    joined = local.join(carry, [*keys, _CHUNK], "left").withColumn(
        out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    )
    return plain.unionByName(joined.drop(_CHUNK, "_rn", "_lag", "_carry"))


def last_known(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: str,
    out: str,
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Last non-null ``value`` up to and including each row, per key."""
    cold, hot, n = split_hot(df, keys, max_rows)
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    plain = cold.withColumn(out, F.last(value, ignorenulls=True).over(frame))
    if hot is None:
        return plain
    chunks = _chunked(hot, n, keys, order, max_rows)
    inside = W.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = chunks.withColumn("_inside", F.last(value, ignorenulls=True).over(inside)).withColumn(
        "_rn", F.row_number().over(W.partitionBy(*keys, _CHUNK).orderBy(*order))
    )
    tails = local.groupBy(*keys, _CHUNK).agg(F.max_by("_inside", "_rn").alias("_tail"))
    earlier = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(earlier)).drop("_tail")
    joined = local.join(carry, [*keys, _CHUNK], "left").withColumn(out, F.coalesce("_inside", "_carry"))
    return plain.unionByName(joined.drop(_CHUNK, "_inside", "_rn", "_carry"))


def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Distinct values of ``col`` in sorted order numbered from 0.

    The values are range-partitioned, numbered inside each partition and shifted
    by the sizes of the partitions before it.
    """
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    ranged = cut_lineage(values.repartitionByRange(F.col(col)).withColumn(_CHUNK, F.spark_partition_id()))
    sizes = ranged.groupBy(_CHUNK).agg(F.count(F.lit(1)).alias("_c"))
    shift = sizes.withColumn("_before", F.sum("_c").over(W.orderBy(_CHUNK)) - F.col("_c")).drop("_c")
    local = ranged.withColumn("_rn", F.row_number().over(W.partitionBy(_CHUNK).orderBy(col)))
    # one row per partition of the table, so small by construction
    return local.join(F.broadcast(shift), _CHUNK).select(col, (F.col("_rn") + F.col("_before") - 1).cast("long").alias(out))
