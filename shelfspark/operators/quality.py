"""Quality gates and small reports."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F

from shelfspark.runtime import cut_lineage

# Highest allowed null rate per column.
THRESHOLDS = {"title": 0.0, "image_url": 0.05, "score": 0.10, "year": 0.05}


def null_rates(df: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(column, total, nulls, rate, max_rate, failed) from one pass."""
    limits = thresholds or THRESHOLDS
    one = df.agg(
        F.count(F.lit(1)).alias("total"), *[(F.count(F.lit(1)) - F.count(c)).alias(f"n_{c}") for c in limits]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.lit(float(m)).alias("max_rate"))
            for c, m in limits.items()
        ]
    )
    rate = F.when(F.col("total") > 0, F.col("nulls") / F.col("total"))
    return (
        one.select("total", F.explode(rows).alias("r"))
        .select("total", "r.*")
        .withColumn("rate", rate)
        .withColumn("failed", (F.col("total") == 0) | F.coalesce(F.col("rate") > F.col("max_rate"), F.lit(False)))
        .select("column", "total", "nulls", "rate", "max_rate", "failed")
    )


def gate(df: DataFrame, min_rows: int = 0, thresholds: dict[str, float] | None = None) -> list[str]:
    """Failure messages; empty means pass. One job over the table, four rows to the driver."""
    rows = null_rates(df, thresholds).collect()
    total = rows[0]["total"]
    if total < min_rows:
        return [f"rows {total} < min_rows {min_rows}"]
    if total == 0:
        return ["row_count is 0"]
    return [f"{r['column']} null-rate {r['rate']:.3f} > {r['max_rate']}" for r in rows if r["failed"]]


def null_skipping_means(df: DataFrame, cols: list[str]) -> DataFrame:
    """(metric, mean, n_valid, n): null and NaN are left out of the mean."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None))
        aggs += [F.round(F.avg(v), 4).alias(f"m_{c}"), F.count(v).alias(f"k_{c}")]
    rows = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(f"m_{c}").alias("mean"), F.col(f"k_{c}").alias("n_valid")) for c in cols]
    )
    return df.agg(*aggs).select("n", F.explode(rows).alias("r")).select("r.*", "n")


def percentile_nearest(df: DataFrame, group: list[str], value: str, percents: list[int]) -> DataFrame:
    """sorted[min(int(p/100 * n), n-1)] per group, exactly, without sorting a group in one task.

    Distinct values are counted first (map-side combined); the running count
    goes over the distinct values of a group, range by range, see
    ``_ranked_values``. Null and NaN are left out; a group without values has no rows.
    """
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = cut_lineage(known.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c")), "value-counts")
    ranked = _ranked_values(counts, group, value)
    totals = counts.groupBy(*group).agg(F.sum("c").alias("n"))
    wanted = totals.withColumn("p", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn(
        "pos", F.least(F.floor(F.col("p") / 100 * F.col("n")), F.col("n") - 1)
    )
    hit = (F.col("pos") >= F.col("before")) & (F.col("pos") < F.col("before") + F.col("c"))
    if group:
        joined = ranked.join(wanted, group)
    else:  # without groups ``wanted`` is one row per percent, carried as a scalar
        asked = wanted.agg(F.collect_list(F.struct("p", "pos", "n"))).scalar()
        joined = ranked.withColumn("w", F.explode(asked)).select("*", "w.*")
    return joined.filter(hit).select(*group, "p", F.col(value).alias("value"), "n")


def _ranked_values(counts: DataFrame, group: list[str], value: str, bins: int = 256) -> DataFrame:
    """Adds ``before``: how many rows of the group have a smaller value.

    Distinct values are cut at approximate quantiles into ranges of about equal
    size, whatever their distribution. The offset of a range comes from the
    range counts; only the values of one range are ordered together.
    """
    cuts = counts.approxQuantile(value, [i / bins for i in range(1, bins)], 1 / (4 * bins))
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    binned = Bucketizer(splits=splits, inputCol=value, outputCol="bin").transform(counts)
    totals = binned.groupBy(*group, "bin").agg(F.sum("c").alias("bc"))  # at most ``bins`` rows per group
    shifted = totals.withColumn("shift", F.sum("bc").over(W.partitionBy(*group).orderBy("bin")) - F.col("bc")).drop("bc")
    inside = F.sum("c").over(W.partitionBy(*group, "bin").orderBy(value)) - F.col("c")
    local = binned.withColumn("inside", inside)
    return local.join(shifted, [*group, "bin"]).withColumn("before", F.col("inside") + F.col("shift")).drop("inside", "shift", "bin")


def steps_to_target(curves: DataFrame, target: float = 0.3) -> DataFrame:
    """(arm, step): first step with ndcg at or above the target; null = never."""
    return curves.groupBy("arm").agg(F.min(F.when(F.col("ndcg") >= target, F.col("step"))).alias("step"))


def macro_means(df: DataFrame, arm: str, group: str, metric: str) -> DataFrame:
    """Mean per (arm, group) and per arm in one pass; the group of a per-arm row is null."""
    rolled = df.rollup(arm, group).agg(
        F.round(F.avg(metric), 4).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")
    )
    return rolled.filter("level < 3").select(arm, group, f"mean_{metric}", "n", F.col("level").cast("int").alias("level"))


def rmse(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    err = F.col(predicted) - F.col(actual)
    return df.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.count(err).alias("n"))


def track_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("track").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("needs_review").cast("long")).alias("flagged")
    )


def track_partition(rows: DataFrame, category_col: str, factual: list[str]) -> tuple[DataFrame, DataFrame]:
    """Disjoint, complete split of golden rows: factual categories and the rest."""
    hit = F.coalesce(F.col(category_col).isin(factual), F.lit(False))
    return rows.filter(hit), rows.filter(~hit)
