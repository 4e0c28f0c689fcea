"""Keyed-write queries: each returns the next version of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark import schemas
from shelfspark.operators import catalog as cop, upserts as op
from shelfspark.plans import tables
from shelfspark.queries import query
from shelfspark.queries.common import CAT, LIST, RAW, cat_lean, flat, with_ctes


@query("insert_ignore", """
WITH t AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 = 0),
b AS (SELECT o_custkey AS id, min(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT id, name FROM t UNION ALL SELECT id, 'order' || k FROM b WHERE id NOT IN (SELECT id FROM t)""")
def insert_ignore(spark, d):
    target = tables.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).cast("long").alias("seq")
    )
    batch = tables.table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"),
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("seq"),
    )
    return op.insert_ignore(target, batch, ["id"], ["seq"]).drop("seq")


@query("upsert_catalog", with_ctes(CAT, RAW, body="""
SELECT c.mal_id, CASE WHEN r.fetched_at > TIMESTAMP '2024-01-02 12:00:00' THEN CASE WHEN c.mal_id % 50 <> 0 THEN title ELSE 'Anime ' || c.mal_id END ELSE 'old' END AS title,
  CASE WHEN r.fetched_at > TIMESTAMP '2024-01-02 12:00:00' THEN score ELSE 1.5 END AS score,
  CASE WHEN r.fetched_at > TIMESTAMP '2024-01-02 12:00:00' THEN
    CASE WHEN c.mal_id % 2 = 0 THEN array_to_string(list_sort(list_distinct(['seed', r.source])), '|') ELSE r.source END ELSE 'seed' END AS sources,
  CASE WHEN c.mal_id % 2 = 0 THEN 7.5 END AS score_anilist
FROM cat c JOIN raw r USING (mal_id) WHERE c.mal_id % 2 = 0 OR r.fetched_at > TIMESTAMP '2024-01-02 12:00:00'"""))
def upsert_catalog(spark, d):
    """Half of the catalog exists; a batch past the watermark updates it and adds new rows."""
    seed = {"title": "'old'", "score": "1.5D", "sources": "array('seed')", "score_anilist": "7.5D"}
    cols = [
        F.expr(seed[f.name]).cast(f.dataType).alias(f.name) if f.name in seed else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.fields(schemas.CATALOG)
        if f.name != "mal_id"
    ]
    target = cat_lean(spark, d).filter("mal_id % 2 = 0").select("mal_id", *cols)
    batch = cop.flatten_payload(cop.since(tables.raw_payloads(spark, d), "fetched_at", "2024-01-02 12:00:00"))
    return flat(op.upsert_catalog(target, batch).select("mal_id", "title", "score", "sources", "score_anilist"))


@query("upsert_scores", """
WITH l AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS score, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT user_id, item_id, max(score) AS score, min(ts) AS ts FROM l WHERE n <= 3 GROUP BY ALL),
b AS (SELECT user_id, item_id, score, ts FROM l WHERE n > 3 QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, score DESC) = 1)
SELECT coalesce(t.user_id, b.user_id) AS user_id, coalesce(t.item_id, b.item_id) AS item_id, coalesce(b.score, t.score) AS score, coalesce(t.ts, b.ts) AS ts
FROM t FULL OUTER JOIN b ON t.user_id = b.user_id AND t.item_id = b.item_id""")
def upsert_scores(spark, d):
    lines = tables.table(spark, d, "lineitem")
    orders = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    log = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("int").alias("score"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").alias("n"),
    )
    target = log.filter("n <= 3").groupBy("user_id", "item_id").agg(F.max("score").alias("score"), F.min("ts").alias("ts"))
    return op.upsert_scores(target, log.filter("n > 3").drop("n"))


@query("apply_list_changes", with_ctes(LIST, body="""
, t AS (SELECT user_id, item_id, status, progress, score FROM list WHERE entry_id % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY entry_id) = 1),
ch AS (SELECT user_id, item_id % 50 AS item_id, entry_id AS seq, ['upsert', 'patch', 'delete', 'patch'][entry_id % 4 + 1] AS op,
    CASE WHEN entry_id % 4 = 0 OR entry_id % 5 = 0 THEN status END AS status, CASE WHEN entry_id % 4 = 0 OR entry_id % 3 = 0 THEN progress END AS progress, score FROM list),
base AS (SELECT user_id, item_id % 50 AS item_id, status, progress, score FROM t QUALIFY row_number() OVER (PARTITION BY user_id, item_id % 50 ORDER BY t.item_id) = 1),
rs AS (SELECT user_id, item_id, seq AS rseq, op AS rop, status AS rstatus, progress AS rprogress, score AS rscore FROM ch WHERE op IN ('upsert', 'delete')
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY seq DESC) = 1),
st AS (SELECT coalesce(b.user_id, r.user_id) AS user_id, coalesce(b.item_id, r.item_id) AS item_id, coalesce(rseq, -1) AS rseq,
    CASE WHEN rop IS NULL THEN b.status ELSE rstatus END AS status, CASE WHEN rop IS NULL THEN b.progress ELSE rprogress END AS progress,
    CASE WHEN rop IS NULL THEN b.score ELSE rscore END AS score
  FROM base b FULL OUTER JOIN rs r ON b.user_id = r.user_id AND b.item_id = r.item_id WHERE rop IS NULL OR rop = 'upsert'),
pt AS (SELECT c.user_id, c.item_id, arg_max(c.status, seq) FILTER (c.status IS NOT NULL) AS pstatus,
    arg_max(c.progress, seq) FILTER (c.progress IS NOT NULL) AS pprogress, arg_max(c.score, seq) FILTER (c.score IS NOT NULL) AS pscore
  FROM ch c LEFT JOIN rs r ON c.user_id = r.user_id AND c.item_id = r.item_id WHERE op = 'patch' AND seq > coalesce(rseq, -1) GROUP BY ALL)
SELECT st.user_id, st.item_id, coalesce(pstatus, status) AS status, coalesce(pprogress, progress) AS progress, coalesce(pscore, score) AS score
FROM st LEFT JOIN pt ON st.user_id = pt.user_id AND st.item_id = pt.item_id"""))
def apply_list_changes(spark, d):
    rows = tables.user_list(spark, d)
    keys = ["user_id", "item_id"]
    even = op.first_per_key(rows.filter("entry_id % 2 = 0"), keys, ["entry_id"])
    target = op.first_per_key(
        even.withColumn("raw_item", F.col("item_id")).withColumn("item_id", F.col("item_id") % 50), keys, ["raw_item"]
    ).select(*keys, "status", "progress", "score")
    e = F.col("entry_id")
    changes = rows.select(
        "user_id",
        (F.col("item_id") % 50).alias("item_id"),
        e.alias("seq"),
        tables.pick(["upsert", "patch", "delete", "patch"], e % 4).alias("op"),
        F.when((e % 4 == 0) | (e % 5 == 0), F.col("status")).alias("status"),
        F.when((e % 4 == 0) | (e % 3 == 0), F.col("progress")).alias("progress"),
        "score",
    )
    return op.apply_list_changes(target, changes)


@query("upsert_list", with_ctes(LIST, body="""
SELECT user_id, item_id, status, progress, score FROM list QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY entry_id DESC) = 1"""))
def upsert_list(spark, d):
    rows = tables.user_list(spark, d)
    keys = ["user_id", "item_id"]
    cols = ["status", "progress", "score"]
    target = op.last_per_key(rows.filter("entry_id % 2 = 0"), keys, ["entry_id"])
    batch = op.last_per_key(rows, keys, ["entry_id"])
    return op.upsert(target.select(*keys, *cols), batch, keys, cols)


@query("set_doc_vi", with_ctes(CAT, body="""
SELECT mal_id, CASE WHEN mal_id % 3 = 1 THEN 'vi ' || title WHEN mal_id % 2 = 0 THEN 'kept' END AS doc_vi FROM cat"""))
def set_doc_vi(spark, d):
    c = cat_lean(spark, d).select("mal_id", "title", F.when(F.col("mal_id") % 2 == 0, "kept").alias("doc_vi"))
    new = c.filter("mal_id % 3 <> 2").select(
        "mal_id", F.when(F.col("mal_id") % 3 == 1, F.concat(F.lit("vi "), F.col("title"))).otherwise("").alias("doc_vi")
    )
    return op.set_doc_vi(c.drop("title"), new)


@query("advance_watermark", with_ctes(RAW, body="""
SELECT 'transform' AS pipeline, max(fetched_at) AS last_run FROM raw UNION ALL SELECT 'other', TIMESTAMP '2023-01-01'"""))
def advance_watermark(spark, d):
    raw = tables.raw_payloads(spark, d)
    state = spark.sql(
        "SELECT p AS pipeline, TIMESTAMP_NTZ '2023-01-01 00:00:00' AS last_run FROM VALUES ('transform'), ('other') AS t(p)"
    )
    return op.advance_watermark(state, "transform", cop.since(raw, "fetched_at", "2023-01-01"))



