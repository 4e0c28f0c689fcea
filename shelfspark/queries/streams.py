"""Streaming queries: each runs to the end of its input and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.plans import tables
from shelfspark.queries import query
from shelfspark.queries.catalog import FLAT_SQL
from shelfspark.queries.common import CAT, RAW, cat_lean, flat, with_ctes
from shelfspark.runtime import scratch_path
from shelfspark.streaming import jobs


def events(spark, d):
    return jobs.read_events(spark, d, tables.table(spark, d, "events").schema, "events.parquet")


@query("stream_ndjson_to_catalog", with_ctes(CAT, RAW, body="SELECT mal_id, title, episodes, genres, sources, score_mal FROM (" + FLAT_SQL + ")"))
def stream_ndjson_to_catalog(spark, d):
    folder = scratch_path(spark, "raw-ndjson")
    tables.raw_payloads(spark, d).repartition(3, "mal_id").write.json(folder)
    out = jobs.ndjson_to_catalog(spark, folder)
    return flat(out.select("mal_id", "title", "episodes", "genres", "sources", "score_mal"))


@query("stream_dedupe_ids", "SELECT event_id, user_id, ts FROM events")
def stream_dedupe_ids(spark, d):
    """The event feed delivered twice."""
    feed = events(spark, d).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    again = events(spark, d).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.drain(jobs.dedupe_stream(feed.unionByName(again), ["event_id"], "ts"), "dedupe")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_enrich_static", with_ctes(CAT, body="""
SELECT event_id, CAST(floor(value) AS BIGINT) AS mal_id, title, score FROM events LEFT JOIN cat ON mal_id = CAST(floor(value) AS BIGINT)"""))
def stream_enrich_static(spark, d):
    feed = events(spark, d).select("event_id", F.col("value").cast("long").alias("mal_id"))
    return jobs.drain(jobs.enrich_stream(feed, cat_lean(spark, d).select("mal_id", "title", "score"), "mal_id"), "enrich")


@query("stream_latest_features", "SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest_features(spark, d):
    folder = scratch_path(spark, "feature-files")
    rows = tables.table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    rows.repartition(4, "event_id").write.parquet(folder)
    return jobs.latest_features(jobs.read_events(spark, folder, rows.schema, "*.parquet"), ["user_id"], ["ts", "event_id"])


@query("stream_interaction_gap", """
SELECT event_id, user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS time_since_last FROM events""")
def stream_interaction_gap(spark, d):
    feed = events(spark, d).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.interaction_gaps(feed).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_freshness", """
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1)
SELECT * FROM w WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_freshness(spark, d):
    """Windows closed by the watermark."""
    feed = events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.drain(jobs.freshness(feed), "freshness")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "newest")})
