"""Incremental jobs as Structured Streaming queries.

Each ``*_stream`` function maps a streaming frame to a streaming frame or
starts a query on it; ``drain`` runs a query over everything available and
returns what it wrote. Progress lives in a checkpoint below the shared folder,
which takes the place of done-id files and high-water marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfspark import schemas
from shelfspark.operators import catalog, skew, upserts
from shelfspark.operators.features import latest_per_key
from shelfspark.runtime import scratch_path


def read_events(spark: SparkSession, folder: str, schema: str | T.StructType, pattern: str, per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    )


def drain(stream: DataFrame, name: str, mode: str = "append", out: str | None = None, state: str | None = None) -> DataFrame:
    """Run an append-mode query to the end of its input; returns the written table.

    With the paths of an earlier run it goes on behind what that run has read;
    without, it starts anew in the shared folder.
    """
    spark = stream.sparkSession
    out, state = out or scratch_path(spark, name), state or scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", state)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def finished_batch(spark: SparkSession, state: str) -> int | None:
    """The newest micro-batch that the checkpoint at ``state`` counts as done; None before the first."""
    try:
        done = spark.read.text(f"{state}/commits").select(F.input_file_name().alias("f"))
        return done.agg(F.max(F.regexp_extract("f", r"(\d+)$", 1).cast("long"))).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def drain_into(stream: DataFrame, path: str, schema: T.StructType, merge: Callable[[DataFrame, DataFrame], DataFrame], state: str) -> DataFrame:
    """Fold every micro-batch into a table, whose version after batch n is the folder n below ``path``.

    A batch reads the version before it and overwrites its own, so one that is
    repeated after a failure gives the same. Older folders are removed from outside.
    """
    spark = stream.sparkSession

    def version(n: int | None) -> DataFrame:
        table = spark.read.schema(schema)
        return table.parquet(f"{path}/{n}") if n is not None and n >= 0 else spark.createDataFrame([], schema)

    def step(batch: DataFrame, n: int) -> None:
        merge(version(n - 1), batch).select(*schema.names).write.mode("overwrite").parquet(f"{path}/{n}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return version(finished_batch(spark, state))


# --- jobs -------------------------------------------------------------------------


def ndjson_to_catalog(spark: SparkSession, folder: str, per_trigger: int = 1, path: str | None = None, state: str | None = None) -> DataFrame:
    """Line-JSON raw rows -> flattened -> upserted catalog, micro-batch by micro-batch; goes on where ``path`` and ``state`` stand."""
    raw = spark.readStream.schema(schemas.RAW).option("maxFilesPerTrigger", per_trigger).json(folder)
    schema = T.StructType(schemas.fields(schemas.CATALOG))

    def merge(current: DataFrame, batch: DataFrame) -> DataFrame:
        newest = upserts.last_per_key(batch, ["mal_id"], ["fetched_at", "source", "payload"])
        rows = catalog.flatten_payload(newest)
        missing = [f for f in schemas.fields(schemas.CATALOG) if f.name not in rows.columns]
        rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
        return upserts.upsert_catalog(current, rows)

    return drain_into(raw, path or scratch_path(spark, "catalog"), schema, merge, state or scratch_path(spark, "catalog-state"))


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """First row per key within the watermark; the state of older keys is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def enrich_stream(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Stream-static left join: unmatched rows keep nulls."""
    return stream.join(static, key, "left")


def latest_features(stream: DataFrame, keys: list[str], order: list[str], path: str | None = None, state: str | None = None) -> DataFrame:
    """Latest row per entity; goes on where ``path`` and ``state`` stand.

    The newest row of each key is the state of a streaming aggregate. Each
    micro-batch writes only the keys that it changed, into a folder of its own,
    which a repeated batch overwrites. Reading takes the latest row of each key.
    """
    spark = stream.sparkSession
    path, state = path or scratch_path(spark, "latest"), state or scratch_path(spark, "latest-state")
    rest = [c for c in stream.columns if c not in keys]
    newest = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    changed = newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*stream.columns)

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    query = changed.writeStream.outputMode("update").foreachBatch(step)
    query.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if finished_batch(spark, state) is None:
        return spark.createDataFrame([], stream.schema)
    return latest_per_key(spark.read.schema(stream.schema).parquet(f"{path}/batch=*"), keys, order)


def freshness(stream: DataFrame, ts: str = "ts", width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(window_start, n, newest) per tumbling window."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest"))
        .select(F.col("w.start").alias("window_start"), "n", "newest")
    )


def interaction_gaps(
    stream: DataFrame, idle_seconds: float | None = None, path: str | None = None, state: str | None = None,
    max_rows: int = skew.MAX_ROWS_PER_KEY,
) -> DataFrame:
    """(user_id, event_id, ts, time_since_last): seconds since the previous event per user; goes on where ``path`` and ``state`` stand.

    Rows of one batch are ordered by (ts, event_id), users with more than
    ``max_rows`` rows in chunks. The last time of each user is kept in a table with a
    version for each batch; a row before it has no known predecessor: its gap is null
    and the last time stays. ``idle_seconds`` forgets users who have had no event for
    so long when a batch begins, by the newest time seen; their next gap is null.
    """
    spark = stream.sparkSession
    path, state = path or scratch_path(spark, "gaps"), state or scratch_path(spark, "gaps-state")
    kind = dict(stream.dtypes)
    shape = f"user_id {kind['user_id']}, event_id {kind['event_id']}, ts {kind['ts']}, time_since_last double"
    last_shape = f"user_id {kind['user_id']}, last {kind['ts']}"

    def step(batch: DataFrame, n: int) -> None:
        lasts = spark.read.schema(last_shape).parquet(f"{path}/last/{n - 1}") if n else spark.createDataFrame([], last_shape)
        if idle_seconds is not None:
            newest = lasts.agg(F.max("last")).scalar()
            lasts = lasts.filter(F.col("last").cast("double") >= newest.cast("double") - idle_seconds)
        met = batch.select("user_id", "event_id", "ts").join(lasts, "user_id", "left")
        late = F.coalesce(F.col("ts") < F.col("last"), F.lit(False))
        placed = skew.previous_value(met.filter(~late), ["user_id"], [F.col("ts"), F.col("event_id")], "ts", "_previous", max_rows)
        micros = F.unix_micros("ts") - F.unix_micros(F.coalesce("_previous", "last"))
        gaps = placed.select("user_id", "event_id", "ts", (micros / 1e6).alias("time_since_last"))
        unknown = met.filter(late).select("user_id", "event_id", "ts", F.lit(None).cast("double").alias("time_since_last"))
        gaps.unionByName(unknown).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        seen = batch.select("user_id", F.col("ts").alias("last")).unionByName(lasts)
        seen.groupBy("user_id").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{path}/last/{n}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if finished_batch(spark, state) is None:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{path}/rows/batch=*")
