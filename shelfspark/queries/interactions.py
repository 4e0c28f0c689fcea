"""Interaction log queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from shelfspark.functions import values
from shelfspark.operators import catalog as cop, features, interactions as op, recommend, skew
from shelfspark.plans import tables
from shelfspark.queries import query
from shelfspark.queries.common import INTER, LIST, RATED, inter, inter_once, with_ctes
from shelfspark.runtime import cut_lineage


@query("interactions", with_ctes(INTER, body="SELECT * FROM inter"))
def interactions(spark, d):
    return inter(spark, d)


def _keep(name: str, source: str, key: str, n: int) -> str:
    return f"{name} AS (SELECT * FROM {source} WHERE {key} IN (SELECT {key} FROM {source} GROUP BY {key} HAVING count(*) >= {n}))"


def min_count_ctes(u: int, i: int) -> str:
    return ", ".join(
        [_keep("f1", "inter", "user_id", u), _keep("f2", "f1", "item_id", i), _keep("f3", "f2", "user_id", u), _keep("f4", "f3", "item_id", i)]
    )


SPLIT = """
split AS (SELECT user_id, item_id, score, ts, CASE WHEN rn <= least(greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)), n - 1)
    THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn,
    count(*) OVER (PARTITION BY user_id) AS n FROM inter))
"""


@query("min_count_filter", with_ctes(INTER, min_count_ctes(5, 5), body="SELECT * FROM f4"))
def min_count_filter(spark, d):
    return op.min_count_filter(inter(spark, d), 5, 5)


@query("min_count_filter_strict", with_ctes(INTER, min_count_ctes(28, 22), body="SELECT * FROM f4"))
def min_count_filter_strict(spark, d):
    return op.min_count_filter(inter(spark, d), 28, 22)


@query("time_split", with_ctes(INTER, SPLIT, body="SELECT * FROM split"))
def time_split(spark, d):
    return op.time_split(inter_once(spark, d), 0.2)


@query("union_splits", with_ctes(INTER, SPLIT, body="SELECT split, count(*) AS n, count(DISTINCT user_id) AS users FROM split GROUP BY split"))
def union_splits(spark, d):
    parts = cut_lineage(op.time_split(inter_once(spark, d), 0.2), "split")
    both = op.union_splits(parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("interaction_gap", """
SELECT event_id, user_id, lag(ts) OVER w AS prev_ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS time_since_last
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def interaction_gap(spark, d):
    ev = tables.table(spark, d, "events").select("event_id", "user_id", "ts")
    return op.interaction_gap(ev, ["user_id"], "ts", "event_id").drop("ts")


@query("dense_ids", "SELECT l_partkey AS item_id, row_number() OVER (ORDER BY l_partkey) - 1 AS idx FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def dense_ids(spark, d):
    return skew.dense_index(tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id")), "item_id")


@query("index_ids", with_ctes(INTER, body="""
SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx, dense_rank() OVER (ORDER BY item_id) - 1 AS item_idx,
  user_id, item_id, score FROM inter"""))
def index_ids(spark, d):
    return op.index_ids(inter_once(spark, d))


@query("implicit_binarize", with_ctes(INTER, body="""
SELECT user_id, item_id, CASE WHEN score >= 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM inter"""))
def implicit_binarize(spark, d):
    return op.implicit(inter(spark, d)).select("user_id", "item_id", "value")


@query("latest_per_key", "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, d):
    ev = tables.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return features.latest_per_key(ev, ["user_id"], ["ts", "event_id"])


@query("first_seen_dedupe", """
SELECT user_id AS id, arm, event_id FROM (SELECT user_id, event_id,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS arm FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY arm, event_id) = 1""")
def first_seen_dedupe(spark, d):
    arm = (
        F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "view", 2).otherwise(3)
    )
    pages = tables.table(spark, d, "events").select(F.col("user_id").alias("id"), arm.alias("arm"), "event_id")
    return cop.first_seen(pages, "id", ["arm", "event_id"])


@query("rank_per_query", with_ctes(INTER, body="""
SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM inter)"""))
def rank_per_query(spark, d):
    return skew.row_numbers(inter(spark, d).drop("ts"), ["user_id"], [F.desc("score"), F.asc("item_id")], "rank")


@query("top_items_per_user", with_ctes(INTER, body="""
SELECT user_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM inter)
WHERE rank <= 5"""))
def top_items_per_user(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id"))
    return inter(spark, d).drop("ts").withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


@query("list_constraints", with_ctes(LIST, body="""
SELECT entry_id, CASE WHEN status NOT IN ('watching', 'completed', 'on_hold', 'dropped', 'plan_to_watch') THEN 'invalid status'
  WHEN score NOT BETWEEN 1 AND 10 THEN 'score out of range'
  WHEN count(*) OVER (PARTITION BY user_id, item_id) > 1 THEN 'duplicate entry' END AS reason FROM list"""))
def list_constraints(spark, d):
    return op.list_violations(tables.user_list(spark, d)).select("entry_id", "reason")


@query("list_by_status", with_ctes(LIST, body="SELECT entry_id, user_id, item_id, score, progress FROM list WHERE status = 'watching'"))
def list_by_status(spark, d):
    return tables.user_list(spark, d).filter("status = 'watching'").drop("status", "changed_at")


@query("status_weight", with_ctes(RATED, body="SELECT user_id, item_id, rating FROM rated WHERE rating > 0"))
def status_weight(spark, d):
    return op.ratings_from_list(tables.user_list(spark, d))


@query("drop_unscored", """
SELECT event_id, score FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 'NaN'::DOUBLE ELSE value END AS score
  FROM events) WHERE score IS NOT NULL AND NOT isnan(score)""")
def drop_unscored(spark, d):
    score = F.when(F.col("event_type") == "signup", float("nan")).when(F.col("event_type") != "error", F.col("value"))
    return op.drop_unscored(tables.table(spark, d, "events").select("event_id", score.alias("score")))


@query("exclude_seen", with_ctes(INTER, body="""
SELECT o_custkey AS user_id, p_partkey AS item_id FROM orders JOIN part ON o_orderkey % 997 = p_partkey
WHERE NOT EXISTS (SELECT 1 FROM inter WHERE user_id = o_custkey AND item_id = p_partkey)"""))
def exclude_seen(spark, d):
    wanted = tables.user_list(spark, d).select("user_id", "item_id")
    items = tables.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    return recommend.exclude_seen(wanted.join(items, "item_id").select("user_id", "item_id"), inter(spark, d))


FORMATS = ["POINT_100", "POINT_10_DECIMAL", "POINT_5", "POINT_3", "POINT_10"]


@query("normalize_score", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_partkey % 5 AS f FROM lineitem),
v AS (SELECT *, CASE f WHEN 0 THEN round_even((q * 2 + 1) / 10, 0) WHEN 1 THEN round_even(q / 4, 0) WHEN 2 THEN floor(q / 10 * 2)
  WHEN 3 THEN CASE CAST(q AS INTEGER) WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 10 END ELSE floor(q / 4) END AS x FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x BETWEEN 1 AND 10 THEN CAST(x AS INTEGER) END AS score FROM v""")
def normalize_score(spark, d):
    q, f = F.col("l_quantity"), F.col("l_partkey") % 5
    raw = F.when(f == 0, q * 2 + 1).when(f == 1, q / 4).when(f == 2, q / 10).when(f == 3, q).otherwise(q / 4)
    fmt = tables.pick(FORMATS, f)
    return tables.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", values.normalize_score(raw, fmt).alias("score")
    )


@query("partial_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN DATE '2020-02-02' ELSE make_date(year(o_orderdate),
  CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE month(o_orderdate) END, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE day(o_orderdate) END) END AS scored_at
FROM orders""")
def partial_date(spark, d):
    ok, t = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.struct(
        F.when(ok % 4 != 0, F.year(t)).alias("year"),
        F.when(ok % 3 != 0, F.month(t)).alias("month"),
        F.when(ok % 2 != 0, F.dayofmonth(t)).alias("day"),
    )
    rows = tables.table(spark, d, "orders").select("o_orderkey", date.alias("d"))
    return rows.select("o_orderkey", values.partial_date(F.col("d"), F.lit("2020-02-02").cast("date")).alias("scored_at"))


@query("parse_entries", """
SELECT 'user' || o_custkey AS user_id, l_partkey AS item_id, CAST(round_even((l_quantity * 2) / 10, 0) AS INTEGER) AS score,
  CASE WHEN l_linenumber % 2 = 0 THEN DATE '2024-01-01' ELSE make_date(year(l_shipdate), 1, 1) END AS scored_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_partkey % 7 <> 0 AND round_even((l_quantity * 2) / 10, 0) BETWEEN 1 AND 10""")
def parse_entries(spark, d):
    """One payload per order: its lines are the entries of one list."""
    line = tables.table(spark, d, "lineitem")
    year = F.struct(F.when(F.col("l_linenumber") % 2 != 0, F.year("l_shipdate")).alias("year"))
    entry = F.struct(
        F.struct(F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")).alias("idMal")).alias("media"),
        (F.col("l_quantity") * 2).alias("score"),
        year.alias("completedAt"),
    )
    packed = line.groupBy("l_orderkey").agg(F.collect_list(entry).alias("entries"))
    body = F.struct(F.struct(F.struct(F.array(F.struct("entries")).alias("lists")).alias("MediaListCollection")).alias("data"))
    orders = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    payloads = packed.join(orders, packed.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.lit("POINT_100").alias("fmt"),
        F.to_json(body).alias("payload"),
        F.lit("2024-01-01").cast("date").alias("fallback"),
    )
    return op.parse_entries(payloads)
