"""Counts, gates, percentiles and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import catalog as cop, interactions as iop, quality as op
from shelfspark.plans import tables
from shelfspark.queries import query
from shelfspark.queries.common import CAT, INTER, cat_lean, flat, inter, inter_once, with_ctes
from shelfspark.sources import sinks


@query("genre_counts", with_ctes(CAT, body="SELECT g AS name, count(*) AS count FROM (SELECT unnest(genres) AS g FROM cat) GROUP BY g"))
def genre_counts(spark, d):
    return cop.genre_counts(cat_lean(spark, d))


@query("catalog_stats", with_ctes(CAT, body="""
SELECT count(*) AS total, count(score) AS with_score_mal, count(*) - count(image_url) AS missing_images FROM cat"""))
def catalog_stats(spark, d):
    return cop.catalog_stats(cop.flatten_payload(tables.raw_payloads(spark, d)))


@query("genre_item_counts", with_ctes(CAT, body="""
SELECT g AS genre, count(DISTINCT mal_id) AS n_items FROM (SELECT mal_id, unnest(genres) AS g FROM cat) GROUP BY g"""))
def genre_item_counts(spark, d):
    return cop.genre_item_counts(cat_lean(spark, d))


@query("genre_combos", with_ctes(CAT, body="""
SELECT mal_id, array_to_string(genres, '|') AS combo FROM cat WHERE len(genres) BETWEEN 2 AND 3"""))
def genre_combos(spark, d):
    return flat(cop.genre_combos(cat_lean(spark, d)))


GATE_SQL = "UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS total, count(*) - count({c}) AS nulls, (count(*) - count({c})) / count(*) AS rate,
  CAST({m} AS DOUBLE) AS max_rate, (count(*) - count({c})) / count(*) > {m} AS failed FROM cat2
"""
    for c, m in (("title", 0.0), ("image_url", 0.05), ("score", 0.1), ("year", 0.05))
)


@query("null_rate_gate", with_ctes(CAT, body=f"""
, cat2 AS (SELECT title, image_url, score, CASE WHEN mal_id % 10 = 0 THEN NULL ELSE year END AS year FROM cat)
{GATE_SQL}"""))
def null_rate_gate(spark, d):
    rows = cat_lean(spark, d).withColumn("year", F.when(F.col("mal_id") % 10 != 0, F.col("year")))
    return op.null_rates(rows)


@query("matrix_stats", with_ctes(INTER, body="""
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS nnz,
  round(count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 8) AS density FROM inter"""))
def matrix_stats(spark, d):
    return iop.matrix_stats(inter(spark, d))


@query("interaction_crosstab", """
SELECT o_custkey AS user_id, l_partkey AS item_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def interaction_crosstab(spark, d):
    lines = tables.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"))
    orders = tables.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return iop.crosstab(lines.join(orders, lines.l_orderkey == orders.o_orderkey))


@query("pivot_user_item", with_ctes(INTER, body="""
SELECT user_id, max(CASE WHEN item_id % 8 = 0 THEN score END) AS "0", max(CASE WHEN item_id % 8 = 1 THEN score END) AS "1",
  max(CASE WHEN item_id % 8 = 2 THEN score END) AS "2", max(CASE WHEN item_id % 8 = 3 THEN score END) AS "3",
  max(CASE WHEN item_id % 8 = 4 THEN score END) AS "4", max(CASE WHEN item_id % 8 = 5 THEN score END) AS "5",
  max(CASE WHEN item_id % 8 = 6 THEN score END) AS "6", max(CASE WHEN item_id % 8 = 7 THEN score END) AS "7"
FROM inter GROUP BY user_id"""))
def pivot_user_item(spark, d):
    """Users x eight item shelves: a short column list, so wide form is safe."""
    shelves = inter(spark, d).groupBy("user_id", (F.col("item_id") % 8).alias("item_id")).agg(F.max("score").alias("score"))
    return iop.pivot_matrix(shelves, list(range(8)))


@query("macro_means", """
SELECT lang, source, round(avg(n_chars), 4) AS mean_n_chars, count(*) AS n, CAST(grouping(lang, source) AS INTEGER) AS level
FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))""")
def macro_means(spark, d):
    return op.macro_means(tables.table(spark, d, "documents"), "lang", "source", "n_chars")


@query("null_skipping_mean", """
WITH j AS (SELECT quality, toxic, CASE WHEN n_chars > 500 THEN n_chars / 1000 END AS size FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'quality' AS metric, round(avg(quality), 4) AS mean, count(quality) AS n_valid, count(*) AS n FROM j
UNION ALL SELECT 'toxic', round(avg(toxic), 4), count(toxic), count(*) FROM j
UNION ALL SELECT 'size', round(avg(size), 4), count(size), count(*) FROM j""")
def null_skipping_mean(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", "n_chars")
    size = F.when(F.col("n_chars") > 500, F.col("n_chars") / 1000).otherwise(float("nan"))
    rows = docs.join(tables.table(spark, d, "labels"), "doc_id", "left").withColumn("size", size)
    return op.null_skipping_means(rows, ["quality", "toxic", "size"])


@query("percentile_nearest", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT unnest([50, 95, 99])::INTEGER AS p)
SELECT event_type, p, value, n FROM r, p WHERE i = least(CAST(floor(p / 100 * n) AS BIGINT), n - 1)""")
def percentile_nearest(spark, d):
    return op.percentile_nearest(tables.table(spark, d, "events"), ["event_type"], "value", [50, 95, 99])


@query("percentile_nearest_global", """
WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT unnest([50, 95, 99])::INTEGER AS p)
SELECT p, value, n FROM r, p WHERE i = least(CAST(floor(p / 100 * n) AS BIGINT), n - 1)""")
def percentile_nearest_global(spark, d):
    return op.percentile_nearest(tables.table(spark, d, "events"), [], "value", [50, 95, 99])


@query("steps_to_target", """
WITH c AS (SELECT event_type AS arm, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS step, avg(value) AS ndcg
  FROM events GROUP BY 1, 2)
SELECT arm, min(CASE WHEN ndcg >= 52 THEN step END) AS step FROM c GROUP BY arm""")
def steps_to_target(spark, d):
    step = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    curves = tables.table(spark, d, "events").groupBy(F.col("event_type").alias("arm"), step.alias("step")).agg(
        F.avg("value").alias("ndcg")
    )
    return op.steps_to_target(curves, 52)


@query("content_digest", with_ctes(INTER, body="SELECT count(*) AS n_rows, true AS stable FROM inter"))
def content_digest(spark, d):
    """The digest stays the same under another partitioning, order and column order."""
    log = inter_once(spark, d)
    moved = log.select("ts", "score", "item_id", "user_id").repartition(7, "ts").sortWithinPartitions("score")
    other = sinks.content_digest(moved).select("digest").scalar()
    return sinks.content_digest(log).select("n_rows", (F.col("digest") == other).alias("stable"))


@query("track_counts", """
SELECT CASE WHEN lang IN ('en', 'fr') THEN 'factual' ELSE 'behavior' END AS track, count(*) AS n,
  CAST(sum(CASE WHEN n_chars < 200 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM documents GROUP BY 1""")
def track_counts(spark, d):
    docs = tables.table(spark, d, "documents").withColumn("needs_review", F.col("n_chars") < 200)
    a, b = op.track_partition(docs, "lang", ["en", "fr"])
    return op.track_counts(a.withColumn("track", F.lit("factual")).unionByName(b.withColumn("track", F.lit("behavior"))))


@query("track_partition", "SELECT doc_id, lang IN ('en', 'fr') AS factual FROM documents")
def track_partition(spark, d):
    a, b = op.track_partition(tables.table(spark, d, "documents").select("doc_id", "lang"), "lang", ["en", "fr"])
    return a.withColumn("factual", F.lit(True)).unionByName(b.withColumn("factual", F.lit(False))).drop("lang")


@query("rmse", with_ctes(INTER, body="""
, m AS (SELECT item_id, avg(score) AS p FROM inter GROUP BY item_id)
SELECT round(sqrt(avg((p - score) * (p - score))), 6) AS rmse, count(*) AS n FROM inter JOIN m USING (item_id)"""))
def rmse(spark, d):
    log = inter(spark, d)
    means = log.groupBy("item_id").agg(F.avg("score").alias("p"))
    return op.rmse(log.join(means, "item_id"), "score", "p").withColumn("rmse", F.round("rmse", 6))


@query("popularity_minmax", with_ctes(CAT, body="""
, x AS (SELECT mal_id AS item_id, ln(1 + members) AS x FROM cat)
SELECT item_id, round((x - (SELECT min(x) FROM x)) / ((SELECT max(x) FROM x) - (SELECT min(x) FROM x) + 1e-9), 6) AS pop FROM x"""))
def popularity_minmax(spark, d):
    from shelfspark.operators.recommend import popularity
    from shelfspark.queries.common import cat

    return popularity(cat(spark, d)).withColumn("pop", F.round("pop", 6))
