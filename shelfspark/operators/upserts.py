"""Keyed writes. Parquet has no MERGE, so each returns the next version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfspark.operators.catalog import union_sources
from shelfspark.runtime import scratch_path


def first_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in ``order`` (map-side combined)."""
    rest = [c for c in batch.columns if c not in keys]
    picked = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in ``order``."""
    rest = [c for c in batch.columns if c not in keys]
    picked = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def insert_ignore(
    target: DataFrame, batch: DataFrame, keys: list[str], order: list[str], refresh: bool = False
) -> DataFrame:
    """Rows of the batch whose key is new are added, the first of a batch wins; with ``refresh`` they also replace."""
    firsts = first_per_key(batch, keys, order)
    if refresh:
        return target.join(firsts.select(*keys), keys, "left_anti").unionByName(firsts)
    return target.unionByName(firsts.join(target.select(*keys), keys, "left_anti"))


def upsert(
    target: DataFrame, batch: DataFrame, keys: list[str], overwrite: list[str], merged: dict | None = None
) -> DataFrame:
    """One row per key; on conflict ``overwrite`` columns take the batch, ``merged`` columns a rule, others stay."""
    merged = merged or {}
    others = [c for c in target.columns if c not in keys]
    b = batch.select(*keys, *[F.col(c).alias(f"_{c}") for c in others if c in batch.columns], F.lit(True).alias("_new"))
    t = target.withColumn("_old", F.lit(True))
    joined = t.join(b, keys, "full_outer")
    out = [F.col(k) for k in keys]
    types = dict(target.dtypes)
    for c in others:
        new = F.col(f"_{c}") if c in batch.columns else F.lit(None).cast(types[c])
        if c in merged:
            value = F.when(F.col("_new") & F.col("_old"), merged[c](F.col(c), new)).when(F.col("_new"), new)
        elif c in overwrite:
            value = F.when(F.col("_new"), new)
        else:
            value = F.when(F.col("_new") & F.col("_old").isNull(), new)
        out.append(value.otherwise(F.col(c)).alias(c))
    return joined.select(*out)


MAPPED = (
    "title title_japanese synopsis episodes status season year studios source genres tags score image_url "
    "score_mal scored_by_mal rank_mal popularity_mal"
).split()


def upsert_catalog(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Mapped columns overwritten, ``sources`` united, second-source columns untouched."""
    return upsert(target, batch, ["mal_id"], MAPPED, {"sources": union_sources})


def upsert_scores(target: DataFrame, batch: DataFrame) -> DataFrame:
    """On conflict only the score changes; the first time stamp stays."""
    return upsert(target, last_per_key(batch, ["user_id", "item_id"], ["ts", "score"]), ["user_id", "item_id"], ["score"])


def apply_list_changes(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Change log (user_id, item_id, seq, op, status, progress, score) on a list.

    ops: 'upsert' sets three columns, 'patch' sets the non-null ones on an
    existing row, 'delete' removes the key. A key's log folds in ``seq`` order:
    rows before its last upsert or delete have no effect, and after that each
    column takes its last non-null patch, so the fold is two aggregations and no
    row-by-row replay.
    """
    keys = ["user_id", "item_id"]
    cols = ["status", "progress", "score"]
    resets = (
        changes.filter(F.col("op").isin("upsert", "delete"))
        .groupBy(*keys)
        .agg(F.max_by(F.struct("seq", "op", *cols), "seq").alias("reset"))
    )
    # the side with one row per key is joined back, never a pair of logs
    patches = (
        changes.filter(F.col("op") == "patch")
        .join(resets.select(*keys, F.col("reset.seq").alias("rseq")), keys, "left")
        .filter(F.col("rseq").isNull() | (F.col("seq") > F.col("rseq")))
        .groupBy(*keys)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"p_{c}") for c in cols])
    )
    base = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in cols], F.lit(True).alias("had"))
    joined = base.join(resets, keys, "full_outer").join(patches, keys, "left")
    alive = F.when(F.col("reset").isNotNull(), F.col("reset.op") == "upsert").otherwise(F.col("had"))
    out = [
        F.coalesce(
            F.col(f"p_{c}"), F.when(F.col("reset").isNotNull(), F.col(f"reset.{c}")).otherwise(F.col(f"t_{c}"))
        ).alias(c)
        for c in cols
    ]
    return joined.filter(alive).select(*keys, *out)


def set_doc_vi(target: DataFrame, translations: DataFrame) -> DataFrame:
    """Only non-empty translations update; other rows stay null and are retried."""
    t = translations.select("mal_id", F.col("doc_vi").alias("_vi"))
    return target.join(t, "mal_id", "left").withColumn("doc_vi", F.coalesce(F.nullif("_vi", F.lit("")), "doc_vi")).drop("_vi")


def advance_watermark(state: DataFrame, pipeline: str, batch: DataFrame, ts_col: str = "fetched_at") -> DataFrame:
    """The next state table. The mark is the newest row seen, so rows landing mid-run are kept for the next run."""
    seen = batch.agg(F.max(ts_col)).scalar()
    moved = F.when(F.col("pipeline") == pipeline, F.greatest(F.col("last_run"), seen)).otherwise(F.col("last_run"))
    return state.select("pipeline", moved.alias("last_run"))


def publish(df: DataFrame, name: str) -> str:
    """Write a new version into a folder of its own; readers of the old one are not disturbed."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return path


