"""Similarity and recommender queries, all users and all items at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import blocks, features, interactions as iop, recommend as op
from shelfspark.plans import tables
from shelfspark.queries import query
from shelfspark.queries.common import CAT, GENRE_VEC, INTER, LIST, RATED, cat, cat_lean, inter, inter_once, with_ctes
from shelfspark.queries.features import ITEM_FEATURES
from shelfspark.runtime import cut_lineage


def pair_sql(row: str, dim: str, source: str, value: str) -> str:
    return f"""
, nrm AS (SELECT {row} AS r, sqrt(sum(CAST({value} AS DOUBLE) * {value})) AS n FROM {source} GROUP BY {row}),
p AS (SELECT x.{row} AS a, y.{row} AS b, sum(CAST(x.{value} AS DOUBLE) * y.{value}) AS dot FROM {source} x JOIN {source} y
  ON x.{dim} = y.{dim} AND x.{row} < y.{row} GROUP BY ALL)
SELECT a, b, round(dot / (na.n * nb.n), 6) AS sim FROM p JOIN nrm na ON na.r = a JOIN nrm nb ON nb.r = b
"""


@query("user_similarity", with_ctes(INTER, body=pair_sql("user_id", "item_id", "inter", "score")))
def user_similarity(spark, d):
    pairs = blocks.cosine_pairs(inter(spark, d), "user_id", "item_id", "score")
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


@query("item_similarity", with_ctes(INTER, body=pair_sql("item_id", "user_id", "inter", "score")))
def item_similarity(spark, d):
    pairs = blocks.cosine_pairs(inter(spark, d), "item_id", "user_id", "score")
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


@query("content_similarity", with_ctes(CAT, ITEM_FEATURES, body="""
, f AS (SELECT mal_id, dim, weight FROM feat)""" + pair_sql("mal_id", "dim", "f", "weight").replace("SELECT a, b, round", "SELECT a, b, round") + "WHERE dot <> 0"))
def content_similarity(spark, d):
    pairs = blocks.cosine_pairs(features.item_features(cat_lean(spark, d)), "mal_id", "dim", "weight")
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


def knn_sql(row: str, col: str) -> str:
    """Predictions of every unrated (row, col) cell from the ten most similar raters."""
    return f"""
, nrm AS (SELECT {row} AS r, sqrt(sum(CAST(score AS DOUBLE) * score)) AS n FROM inter GROUP BY {row}),
pr AS (SELECT x.{row} AS a, y.{row} AS b, sum(CAST(x.score AS DOUBLE) * y.score) AS dot FROM inter x JOIN inter y
  ON x.{col} = y.{col} AND x.{row} <> y.{row} GROUP BY ALL),
sims AS (SELECT a, b, dot / (na.n * nb.n) AS sim FROM pr JOIN nrm na ON na.r = a JOIN nrm nb ON nb.r = b)
"""


def knn_requested_sql(row: str, col: str) -> str:
    return knn_sql(row, col) + f"""
, req AS (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 997 AS item_id FROM orders),
c AS (SELECT req.user_id, req.item_id, i.{row} AS v, i.score, CASE WHEN i.{row} = req.{row} THEN 1.0 ELSE coalesce(sim, 0) END AS sim
  FROM req JOIN inter i ON i.{col} = req.{col} LEFT JOIN sims ON a = req.{row} AND b = i.{row}),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(sim, 9) DESC, v) AS r FROM c),
preds AS (SELECT user_id, item_id, sum(sim * score) / sum(sim) AS pred FROM t WHERE r <= 10 GROUP BY ALL HAVING sum(sim) > 0)
"""


def requests(spark, d):
    return tables.user_list(spark, d).select("user_id", "item_id").distinct()


@query("user_cf_predict", with_ctes(INTER, body=knn_requested_sql("user_id", "item_id") + """
SELECT req.user_id, req.item_id, round(pred, 6) AS pred FROM req LEFT JOIN preds USING (user_id, item_id)
WHERE req.user_id IN (SELECT user_id FROM inter)
UNION ALL SELECT req.user_id, req.item_id, NULL FROM req WHERE req.user_id NOT IN (SELECT user_id FROM inter)"""))
def user_cf_predict(spark, d):
    return op.user_cf_predict(inter(spark, d), requests(spark, d)).withColumn("pred", F.round("pred", 6))


@query("item_cf_predict", with_ctes(INTER, body=knn_requested_sql("item_id", "user_id") + """
SELECT req.user_id, req.item_id, round(coalesce(i.score, pred), 6) AS pred FROM req LEFT JOIN preds USING (user_id, item_id)
LEFT JOIN inter i ON i.user_id = req.user_id AND i.item_id = req.item_id"""))
def item_cf_predict(spark, d):
    return op.item_cf_predict(inter(spark, d), requests(spark, d)).withColumn("pred", F.round("pred", 6))


def knn_top_sql(row: str, col: str, source: str = "inter", value: str = "score") -> str:
    """Ten best predictions per user, each from the ten most similar raters."""
    return (knn_sql(row, col) + f"""
, c AS (SELECT a, b, i.{col} AS c, i.score, sim FROM sims JOIN inter i ON i.{row} = b
  WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.{row} = a AND x.{col} = i.{col})),
t AS (SELECT a, c, max_by({{'s': sim, 'v': score}}, {{'o': round(sim, 9), 'n': -b}}, 10) AS top FROM c GROUP BY a, c),
p AS (SELECT a AS {row}, c AS {col}, list_sum(list_transform(top, lambda z: z.s * z.v)) / list_sum(list_transform(top, lambda z: z.s)) AS pred FROM t)
SELECT user_id, item_id, round(pred, 6) AS pred, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(pred, 9) DESC, item_id) AS rank FROM p) WHERE rank <= 10""").replace(
        "inter ", f"{source} ").replace("score", value)


#: Every (user, item, rater) is a row in these, too much for whole tables: tests compare them on the smallest ones.
TOP_SQL = {
    "user_cf_recommend": with_ctes(INTER, body=knn_top_sql("user_id", "item_id")),
    "item_cf_recommend": with_ctes(INTER, body=knn_top_sql("item_id", "user_id")),
}


@query("user_cf_recommend")
def user_cf_recommend(spark, d):
    return op.user_cf_recommend(inter(spark, d)).withColumn("pred", F.round("pred", 6))


@query("item_cf_recommend")
def item_cf_recommend(spark, d):
    return op.item_cf_recommend(inter(spark, d)).withColumn("pred", F.round("pred", 6))


@query("list_cf_recommend", with_ctes(RATED, body=", rr AS (SELECT user_id, item_id, max(rating) AS rating FROM rated WHERE rating > 0 GROUP BY ALL)"
    + knn_top_sql("user_id", "item_id", "rr", "rating")))
def list_cf_recommend(spark, d):
    """User-based over ratings implied by list status."""
    ratings = iop.ratings_from_list(tables.user_list(spark, d)).groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"))
    return op.user_cf_recommend(ratings, value="rating").withColumn("pred", F.round("pred", 6))


SIM_TOP = """
, nrm AS (SELECT mal_id AS r, sqrt(sum(weight * weight)) AS n FROM feat GROUP BY 1),
p AS (SELECT x.mal_id AS a, y.mal_id AS b, sum(x.weight * y.weight) AS dot FROM feat x JOIN feat y ON x.dim = y.dim AND x.mal_id <> y.mal_id GROUP BY ALL),
s AS (SELECT a AS query, b AS item, dot / (na.n * nb.n) AS score FROM p JOIN nrm na ON na.r = a JOIN nrm nb ON nb.r = b),
sim AS (SELECT * FROM (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM s) WHERE rank <= 10)
"""


@query("content_similar", with_ctes(CAT, ITEM_FEATURES, body=SIM_TOP + "SELECT query, item, round(score, 6) AS score, rank FROM sim"))
def content_similar(spark, d):
    found = op.content_similar(features.item_features(cat_lean(spark, d)), 10)
    return found.withColumn("score", F.round("score", 6))


@query("content_similar_reviews", with_ctes(INTER, CAT, ITEM_FEATURES, body="""
, rev AS (SELECT item_id AS mal_id, user_id, score::DOUBLE AS w FROM inter),
n1 AS (SELECT mal_id, sqrt(sum(w * w)) AS n FROM rev GROUP BY 1), n2 AS (SELECT mal_id, sqrt(sum(weight * weight)) AS n FROM feat GROUP BY 1),
p1 AS (SELECT x.mal_id AS a, y.mal_id AS b, sum(x.w * y.w) AS dot FROM rev x JOIN rev y ON x.user_id = y.user_id AND x.mal_id <> y.mal_id GROUP BY ALL),
p2 AS (SELECT x.mal_id AS a, y.mal_id AS b, sum(x.weight * y.weight) AS dot FROM feat x JOIN feat y ON x.dim = y.dim AND x.mal_id <> y.mal_id
  WHERE x.mal_id NOT IN (SELECT mal_id FROM rev) GROUP BY ALL),
s AS (SELECT a, b, dot / (x.n * y.n) AS score FROM p1 JOIN n1 x ON x.mal_id = a JOIN n1 y ON y.mal_id = b
  UNION ALL SELECT a, b, dot / (x.n * y.n) FROM p2 JOIN n2 x ON x.mal_id = a JOIN n2 y ON y.mal_id = b)
SELECT a AS query, b AS item, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS rank FROM s) WHERE rank <= 10"""))
def content_similar_reviews(spark, d):
    """Items with reviews (here: rated by someone) are compared by their raters, the rest by features."""
    c = cat_lean(spark, d)
    reviews = inter(spark, d).select(
        F.col("item_id").alias("mal_id"), F.col("user_id").alias("dim"), F.col("score").cast("double").alias("weight")
    )
    found = op.content_similar(features.item_features(c), 10, reviews)
    return found.withColumn("score", F.round("score", 6))


PROFILE = """
, prof AS (SELECT user_id, dim, sum(weight) / max(n) AS w FROM inter JOIN gvec ON mal_id = item_id
    JOIN (SELECT user_id, count(*) AS n FROM inter GROUP BY user_id) USING (user_id) GROUP BY user_id, dim)
"""


@query("user_profile", with_ctes(INTER, CAT, GENRE_VEC, body=PROFILE + "SELECT user_id, dim, round(w, 6) AS weight FROM prof"))
def user_profile(spark, d):
    found = op.user_profile(inter_once(spark, d), features.genre_vectors(cat_lean(spark, d)))
    return found.withColumn("weight", F.round("weight", 6))


POPULAR = """
, place AS (SELECT mal_id AS item_id, row_number() OVER (ORDER BY members DESC, mal_id) AS place FROM cat)
"""


def order(spark, d):
    return op.popularity_order(op.popularity(cat(spark, d)))


def all_users(spark, d):
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))


@query("popularity_recommend", with_ctes(INTER, CAT, body=POPULAR + """
SELECT * FROM (SELECT c_custkey AS user_id, item_id, place, row_number() OVER (PARTITION BY c_custkey ORDER BY place) AS rank
  FROM customer, place WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = c_custkey AND i.item_id = place.item_id)) WHERE rank <= 10"""))
def popularity_recommend(spark, d):
    return op.popular_unseen(all_users(spark, d), inter_once(spark, d), order(spark, d), 10)


@query("candidates", with_ctes(INTER, CAT, GENRE_VEC, body=PROFILE + POPULAR + """
, un AS (SELECT user_id, sqrt(sum(w * w)) AS n FROM prof GROUP BY 1),
dots AS (SELECT user_id, mal_id AS item_id, sum(w * weight) AS dot FROM prof JOIN gvec USING (dim) GROUP BY ALL),
s AS (SELECT u.user_id, p.item_id, coalesce(dot / u.n, 0) AS score FROM un u CROSS JOIN place p LEFT JOIN dots USING (user_id, item_id)
  WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = u.user_id AND i.item_id = p.item_id)),
warm AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s),
cold AS (SELECT c_custkey AS user_id, item_id, place AS rank FROM customer, place WHERE c_custkey NOT IN (SELECT user_id FROM inter))
SELECT * FROM warm WHERE rank <= 200 UNION ALL SELECT * FROM cold WHERE rank <= 200"""))
def candidates(spark, d):
    vecs = features.genre_vectors(cat_lean(spark, d))
    return op.candidates(all_users(spark, d), inter_once(spark, d), vecs, 200, order(spark, d))


@query("content_arm", with_ctes(INTER, CAT, GENRE_VEC, body=PROFILE + """
, dots AS (SELECT user_id, mal_id AS item_id, sum(w * weight) AS dot FROM prof JOIN gvec USING (dim) GROUP BY ALL),
s AS (SELECT u.user_id, c.mal_id AS item_id, coalesce(dot, 0) AS dot FROM (SELECT DISTINCT user_id FROM inter) u CROSS JOIN cat c
  LEFT JOIN dots ON dots.user_id = u.user_id AND dots.item_id = c.mal_id),
b AS (SELECT *, (dot - min(dot) OVER (PARTITION BY user_id)) / (max(dot) OVER (PARTITION BY user_id) - min(dot) OVER (PARTITION BY user_id) + 1e-9) AS score FROM s)
SELECT * FROM (SELECT user_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(dot, 9) DESC, item_id) AS rank
  FROM b WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = b.user_id AND i.item_id = b.item_id)) WHERE rank <= 20"""))
def content_arm(spark, d):
    vecs = features.genre_vectors(cat_lean(spark, d))
    return op.content_arm(inter_once(spark, d), vecs, 20).withColumn("score", F.round("score", 6))


CLICKS = """
clicks AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS item_id, count(*) AS score FROM events GROUP BY ALL)
"""


def clicks(spark, d):
    """Event log as clicks: the whole part of the value is the item."""
    return tables.table(spark, d, "events").select("user_id", F.col("value").cast("long").alias("item_id"))


CF_RANKED = knn_sql("user_id", "item_id").replace("inter", "clicks") + """
, cs AS (SELECT a AS user_id, item_id, sum(sim * score) AS score FROM sims JOIN clicks ON clicks.user_id = b GROUP BY ALL),
cf AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank
  FROM cs WHERE NOT EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = cs.user_id AND c.item_id = cs.item_id))
"""


@query("cf_arm", with_ctes(CLICKS, CAT, body=CF_RANKED + POPULAR + """
, cold AS (SELECT user_id FROM (SELECT c_custkey AS user_id FROM customer UNION SELECT user_id FROM clicks) u
  WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cf WHERE cf.user_id = u.user_id))
SELECT user_id, item_id, round(score, 6) AS score, rank FROM cf WHERE rank <= 20
UNION ALL SELECT * FROM (SELECT user_id, item_id, NULL, row_number() OVER (PARTITION BY user_id ORDER BY place) AS rank FROM cold, place
  WHERE NOT EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = cold.user_id AND c.item_id = place.item_id)) WHERE rank <= 20"""))
def cf_arm(spark, d):
    """Users without clicks or without neighbours get the popular items, whether they are customers or not."""
    log = cut_lineage(clicks(spark, d), "clicks")
    users = all_users(spark, d).unionByName(log.select("user_id")).filter("user_id is not null").distinct()
    return op.cf_arm(log, 20, users, order(spark, d)).withColumn("score", F.round("score", 6))


@query("cf_arm_with_fallback", with_ctes(CLICKS, CAT, body=CF_RANKED + POPULAR + """
SELECT user_id, item_id, round(score, 6) AS score, rank FROM cf WHERE rank <= 20
UNION ALL SELECT * FROM (SELECT c_custkey, item_id, NULL, row_number() OVER (PARTITION BY c_custkey ORDER BY place) AS rank FROM customer, place
  WHERE c_custkey NOT IN (SELECT user_id FROM cf) AND NOT EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = c_custkey AND c.item_id = place.item_id)) WHERE rank <= 20"""))
def cf_arm_with_fallback(spark, d):
    log = cut_lineage(clicks(spark, d), "clicks")
    return op.cf_arm(log, 20, all_users(spark, d), order(spark, d)).withColumn("score", F.round("score", 6))


@query("hybrid_switch", with_ctes(
    CAT, GENRE_VEC, "clicks AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS item_id, count(*) AS score FROM events JOIN part ON p_partkey = CAST(floor(value) AS BIGINT) GROUP BY ALL)",
    body=CF_RANKED + """
, n AS (SELECT user_id, count(*) AS h FROM clicks GROUP BY 1),
prof AS (SELECT user_id, dim, sum(weight) / max(h) AS w FROM clicks JOIN gvec ON mal_id = item_id JOIN n USING (user_id) GROUP BY user_id, dim),
d AS (SELECT user_id, mal_id AS item_id, sum(w * weight) AS dot FROM prof JOIN gvec USING (dim) GROUP BY ALL),
f AS (SELECT n.user_id, cat.mal_id AS item_id, coalesce(dot, 0) AS dot, h FROM n CROSS JOIN cat LEFT JOIN d ON d.user_id = n.user_id AND d.item_id = cat.mal_id
  WHERE NOT EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = n.user_id AND c.item_id = cat.mal_id)),
co AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(dot, 9) DESC, item_id) AS rank FROM f),
j AS (SELECT co.user_id, co.item_id, CASE WHEN h < 5 THEN 1 / co.rank / (1 + 1e-9) ELSE 0.7 * (1 / co.rank / (1 + 1e-9)) + 0.3 * (coalesce(1 / cf.rank, 0) / (1 + 1e-9)) END AS score
  FROM co LEFT JOIN cf ON cf.user_id = co.user_id AND cf.item_id = co.item_id)
SELECT user_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM j) WHERE rank <= 10"""))
def hybrid_switch(spark, d):
    """The heads of both rankings hold the blend's best; an item of one head is looked up in the other ranking."""
    known = cat_lean(spark, d).select(F.col("mal_id").alias("item_id"))
    log = cut_lineage(clicks(spark, d).join(known, "item_id", "left_semi"), "clicks")
    c = cat_lean(spark, d)
    seen = cut_lineage(log.distinct(), "seen")
    vecs = features.genre_vectors(c)
    head, cf_head = op.hybrid_heads(10)
    content = cut_lineage(op.content_arm(seen, vecs, head).select("user_id", "item_id", "rank"), "content")
    cf = cut_lineage(op.cf_arm(log, c.count()), "cf")
    late = cf.filter(F.col("rank") <= cf_head).join(content, ["user_id", "item_id"], "left_anti")
    content = cut_lineage(content.unionByName(op.content_places(seen, vecs, late).withColumn("rank", F.col("rank").cast("int"))), "content")
    met = cf.filter(F.col("rank") > cf_head).join(content.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    met = cf.filter(F.col("rank") <= cf_head).unionByName(met)
    return op.hybrid_switch(content, met, seen, 10).withColumn("score", F.round("score", 6))


@query("explore_slots", with_ctes(INTER, CAT, body=POPULAR + """
, slate AS (SELECT * FROM (SELECT c_custkey AS user_id, item_id, row_number() OVER (PARTITION BY c_custkey ORDER BY place) AS rank
  FROM customer, place WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = c_custkey AND i.item_id = place.item_id)) WHERE rank <= 5),
used AS (SELECT user_id, item_id FROM slate UNION SELECT user_id, item_id FROM inter),
num AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS no FROM part),
prime AS (SELECT min(p) AS p FROM (SELECT unnest(range((SELECT count(*) FROM part), (SELECT count(*) FROM part) + 500)) AS p) q
  WHERE NOT EXISTS (SELECT 1 FROM range(2, 2000) t(x) WHERE x * x <= q.p AND q.p % x = 0)),
walk AS (SELECT c_custkey AS user_id, j, ((1 + (c_custkey * 48271 + 7) % (p - 1)) * j + (c_custkey * 69621 + 49) % p) % p AS no
  FROM customer, prime, range(0, 400) t(j)),
ex AS (SELECT w.user_id, num.item_id, row_number() OVER (PARTITION BY w.user_id ORDER BY j) AS x FROM walk w JOIN num USING (no)
  WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.user_id = w.user_id AND u.item_id = num.item_id))
SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank, false AS explored FROM slate WHERE rank <= 3
UNION ALL SELECT user_id, item_id, CAST(3 + x AS INTEGER), true FROM ex WHERE x <= 2"""))
def explore_slots(spark, d):
    log = inter_once(spark, d).select("user_id", "item_id")
    slates = op.popular_unseen(all_users(spark, d), log, order(spark, d), 5)
    items = tables.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    return op.explore_slots(slates, log, items, 5, 2)


@query("for_you")
def for_you(spark, d):
    log = inter_once(spark, d)
    u, i = op.user_cf_recommend(log), op.item_cf_recommend(log)
    similar = op.content_similar(features.item_features(cat_lean(spark, d)), 10)
    return op.for_you(all_users(spark, d), u, i, similar, order(spark, d), 10)


@query("for_you_concat", with_ctes(INTER, CAT, ITEM_FEATURES, body=POPULAR + SIM_TOP + """
, top AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r1,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS r2 FROM inter),
arms AS (SELECT user_id, item_id, 0 AS arm, r1 AS pos FROM top WHERE r1 <= 3 UNION ALL SELECT user_id, item_id, 1, r2 FROM top WHERE r2 <= 3
  UNION ALL SELECT user_id, item, 2, rank FROM top JOIN sim ON query = item_id WHERE r1 = 1
  UNION ALL SELECT c_custkey, item_id, 3, place FROM customer, place WHERE place <= 10),
firsts AS (SELECT * FROM arms QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY arm, pos) = 1)
SELECT user_id, item_id, arm, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arm, pos, item_id) AS rank FROM firsts) WHERE rank <= 10"""))
def for_you_concat(spark, d):
    """The concatenation rule with two cheap arms: best-rated and latest items."""
    from pyspark.sql import Window as W

    log = inter_once(spark, d)
    best = W.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id"))
    late = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id"))
    a = log.withColumn("rank", F.row_number().over(best)).filter("rank <= 3")
    b = log.withColumn("rank", F.row_number().over(late)).filter("rank <= 3")
    similar = op.content_similar(features.item_features(cat_lean(spark, d)), 10)
    return op.for_you(all_users(spark, d), a, b, similar, order(spark, d), 10)


@query("recommend_with_fallback", with_ctes(INTER, CAT, body=POPULAR + """
, own AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM inter
  WHERE user_id IN (SELECT user_id FROM inter GROUP BY user_id HAVING sum(2 * score) >= 11 * count(*)))
SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank, false AS fallback FROM own WHERE rank <= 10
UNION ALL SELECT c_custkey, item_id, CAST(place AS INTEGER), true FROM customer, place WHERE place <= 10 AND c_custkey NOT IN (SELECT user_id FROM own)"""))
def recommend_with_fallback(spark, d):
    """Users whose mean score is below the middle get the popular list."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id"))
    log = inter_once(spark, d)
    pleased = log.groupBy("user_id").agg((F.sum(2 * F.col("score")) >= 11 * F.count(F.lit(1))).alias("ok")).filter("ok").select("user_id")
    own = log.join(pleased, "user_id").withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    return op.with_fallback(all_users(spark, d), own, order(spark, d), 10)


@query("matrix_factorization")
def matrix_factorization(spark, d):
    return op.als_recommend(inter(spark, d), 10)


@query("blend_reasons", with_ctes(INTER, body="""
, a AS (SELECT user_id, item_id, score / 10 AS a FROM inter WHERE score >= 4), b AS (SELECT user_id, item_id, year(ts) % 10 / 10 AS b FROM inter WHERE score <= 7),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.item_id, b.item_id) AS item_id, 0.6::DOUBLE * coalesce(a, 0) AS x, 0.4::DOUBLE * coalesce(b, 0) AS y
  FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.item_id = b.item_id)
SELECT * FROM (SELECT user_id, item_id, round(x + y, 6) AS score, CASE WHEN x >= y THEN 'similar users' ELSE 'similar content' END AS reason,
  row_number() OVER (PARTITION BY user_id ORDER BY round(x + y, 9) DESC, item_id) AS rank FROM j) WHERE rank <= 5"""))
def blend_reasons(spark, d):
    """Two lists that together hold every rating: the better ones, and the worse ones scored by their year."""
    log = inter(spark, d)
    a = log.filter("score >= 4").select("user_id", "item_id", (F.col("score") / 10).alias("score"))
    b = log.filter("score <= 7").select("user_id", "item_id", (F.year("ts") % 10 / 10).alias("score"))
    return op.blend_reasons(a, b, 5).withColumn("score", F.round("score", 6))


def asked_sql(row: str, col: str, model: str, p: str) -> str:
    """Predictions of the requests for one model, as CTEs with prefix ``p``; each request has its own k."""
    return f"""
, {p}n AS (SELECT {row} AS r, sqrt(sum(CAST(score AS DOUBLE) * score)) AS n FROM inter GROUP BY 1),
{p}p AS (SELECT x.{row} AS a, y.{row} AS b, sum(CAST(x.score AS DOUBLE) * y.score) AS dot FROM inter x JOIN inter y ON x.{col} = y.{col} AND x.{row} <> y.{row} GROUP BY ALL),
{p}s AS (SELECT a, b, dot / (x.n * y.n) AS sim FROM {p}p JOIN {p}n x ON x.r = a JOIN {p}n y ON y.r = b),
{p}c AS (SELECT q.entry_id, q.k, i.{row} AS v, i.score, CASE WHEN i.{row} = q.{row} THEN 1.0 ELSE coalesce(sim, 0) END AS sim
  FROM ask q JOIN inter i ON i.{col} = q.{col} LEFT JOIN {p}s ON a = q.{row} AND b = i.{row} WHERE model = '{model}'),
{p}t AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY round(sim, 9) DESC, v) AS r FROM {p}c),
{p}r AS (SELECT entry_id, sum(sim * score) / sum(sim) AS pred FROM {p}t WHERE r <= k GROUP BY 1 HAVING sum(sim) > 0)
"""


@query("batch_predict", with_ctes(INTER, LIST, body="""
, ask AS (SELECT entry_id, user_id, item_id, CASE WHEN entry_id % 2 = 0 THEN 10 ELSE 5 END AS k, CASE WHEN entry_id % 3 = 0 THEN 'user' ELSE 'item' END AS model FROM list)
""" + asked_sql("user_id", "item_id", "user", "u") + asked_sql("item_id", "user_id", "item", "m") + """
SELECT ask.*, round(CASE WHEN model = 'user' THEN ur.pred ELSE coalesce(i.score, mr.pred) END, 6) AS pred FROM ask LEFT JOIN ur USING (entry_id) LEFT JOIN mr USING (entry_id)
LEFT JOIN inter i ON i.user_id = ask.user_id AND i.item_id = ask.item_id"""))
def batch_predict(spark, d):
    ask = tables.user_list(spark, d).select(
        "entry_id",
        "user_id",
        "item_id",
        F.when(F.col("entry_id") % 2 == 0, 10).otherwise(5).alias("k"),
        F.when(F.col("entry_id") % 3 == 0, "user").otherwise("item").alias("model"),
    )
    return op.batch_predict(inter_once(spark, d), ask).withColumn("pred", F.round("pred", 6))


