"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import values
from shelfspark.operators import features as op
from shelfspark.plans import features as plan, tables
from shelfspark.queries import query
from shelfspark.queries.common import CAT, GENRE_VEC, INTER, cat_lean, inter, with_ctes


@query("clean_frame", """
SELECT DISTINCT p_type, p_size, CAST(p_size AS VARCHAR) AS size_text, TIMESTAMP '2024-01-01' + to_days(p_size) AS made
FROM part""")
def clean_frame(spark, d):
    p = F.col("p_partkey")
    made = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string")
    rows = tables.table(spark, d, "part").select(
        "p_type",
        "p_size",
        F.when(p % 10 == 0, "x").alias("mostly_null"),
        F.col("p_size").cast("string").alias("size_text"),
        made.alias("made"),
    )
    cleaned = op.clean_frame(rows, ["made", "size_text", "mostly_null"])
    # size_text holds plain numbers: some parse as years, the rest do not, so the column stays text
    return cleaned.withColumn("made", F.col("made").cast("timestamp_ntz"))


@query("time_features", """
SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, hour(ts) AS ts_hour,
  isodow(ts) - 1 AS ts_dayofweek, CAST(isodow(ts) >= 6 AS INTEGER) AS ts_is_weekend FROM events""")
def time_features(spark, d):
    return op.time_features(tables.table(spark, d, "events").select("event_id", "ts"), ["ts"])


@query("season_window", """
SELECT o_orderkey, i AS step, year(q + to_months(3 * i)) AS year,
  ['winter', 'spring', 'summer', 'fall'][quarter(q + to_months(3 * i))] AS season
FROM (SELECT o_orderkey, date_trunc('quarter', o_orderdate) AS q FROM orders), (SELECT unnest([0, 1, 2])::INTEGER AS i)""")
def season_window(spark, d):
    rows = tables.table(spark, d, "orders").select(
        "o_orderkey", F.posexplode(values.season_window(F.col("o_orderdate").cast("date"), 3)).alias("step", "s")
    )
    return rows.select("o_orderkey", "step", "s.year", "s.season")


@query("split_random")
def split_random(spark, d):
    return op.split_hash(inter(spark, d), ["user_id", "item_id"])


@query("split_random_exact", with_ctes(INTER, body="""
SELECT 'test' AS split, CAST(ceil(count(*) * 0.2) AS BIGINT) AS n FROM inter
UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM inter"""))
def split_random_exact(spark, d):
    parts = op.split_exact(inter(spark, d), ["user_id", "item_id"])
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("label_encode", """
SELECT p_partkey, r.idx AS p_brand FROM part JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS idx
  FROM (SELECT DISTINCT p_brand FROM part)) r USING (p_brand)""")
def label_encode(spark, d):
    part = tables.table(spark, d, "part").select("p_partkey", "p_brand")
    return op.label_encode(part, "p_brand", op.fit_labels(part, "p_brand"))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("onehot_encode", "SELECT p_partkey, " + ", ".join(f"CASE WHEN p_type = '{t}' AND p_partkey % 11 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"p_type_{t}\"" for t in TYPES) + " FROM part")
def onehot_encode(spark, d):
    part = tables.table(spark, d, "part").select("p_partkey", "p_type")
    unseen = part.withColumn("p_type", F.when(F.col("p_partkey") % 11 == 0, "UNSEEN").otherwise(F.col("p_type")))
    return op.onehot_encode(unseen, ["p_type"], {"p_type": TYPES})


@query("onehot_sparse", """
WITH idx AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part))
SELECT p_partkey, CAST((SELECT count(*) FROM idx) AS INTEGER) AS size, CAST(i AS INTEGER) AS place, 1.0::DOUBLE AS value FROM part JOIN idx USING (p_brand)""")
def onehot_sparse(spark, d):
    part = tables.table(spark, d, "part").select("p_partkey", "p_brand")
    coded = op.onehot_sparse(part, "p_brand", op.fit_index(part, "p_brand"))
    return coded.select("p_partkey", "p_brand.size", F.col("p_brand.indices")[0].alias("place"), F.col("p_brand.values")[0].alias("value"))


@query("onehot_long", """
SELECT p_partkey, 'p_type_' || p_type AS feature, 1.0::DOUBLE AS value FROM part
UNION ALL SELECT p_partkey, 'p_brand_' || p_brand, 1.0::DOUBLE FROM part""")
def onehot_long(spark, d):
    return op.onehot_long(tables.table(spark, d, "part"), "p_partkey", ["p_type", "p_brand"])


@query("multilabel_encode", with_ctes(CAT, body="""
SELECT mal_id, g AS class, 1 AS flag FROM (SELECT mal_id, unnest(genres) AS g FROM cat)"""))
def multilabel_encode(spark, d):
    rows = cat_lean(spark, d).select("mal_id", "genres")
    index = op.fit_index(rows, "genres")
    coded = op.multilabel_sparse(rows, "mal_id", "genres", index)
    # the places of each vector back to their classes
    each = coded.select("mal_id", F.explode(F.arrays_zip("genres.indices", "genres.values")).alias("p"))
    each = each.select("mal_id", F.col("p.indices").cast("long").alias("idx"), F.col("p.values").cast("int").alias("flag"))
    return each.join(index, "idx").select("mal_id", F.col("genres").alias("class"), "flag")


@query("scale_standard", """
SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice,
  round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size, 0.0::DOUBLE AS same FROM part""")
def scale_standard(spark, d):
    part = tables.table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size").withColumn("same", F.lit(3.0))
    cols = ["p_retailprice", "p_size", "same"]
    out = op.apply_scaler(part, cols, op.fit_scaler(part, cols, "standard"))
    return out.withColumns({c: F.round(c, 6) for c in cols})


@query("scale_minmax", """
SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS p_retailprice,
  0.0::DOUBLE AS same FROM part""")
def scale_minmax(spark, d):
    part = tables.table(spark, d, "part").select("p_partkey", "p_retailprice").withColumn("same", F.lit(3.0))
    cols = ["p_retailprice", "same"]
    out = op.apply_scaler(part, cols, op.fit_scaler(part, cols, "minmax"))
    return out.withColumns({c: F.round(c, 6) for c in cols})


@query("log1p_columns", "SELECT round(ln(1 + l_quantity), 6) AS q, round(ln(1 + l_extendedprice), 6) AS p FROM lineitem")
def log1p_columns(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    return op.log1p_columns(rows).select(F.round("q", 6).alias("q"), F.round("p", 6).alias("p"))


TFIDF = """
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
voc AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM (
  SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 1000)),
raw AS (SELECT doc_id, idx, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term))
"""


@query("tfidf", with_ctes(TFIDF, body="""
SELECT doc_id, idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""))
def tfidf(spark, d):
    docs = tables.texts(spark, d, "documents").select("doc_id", "text")
    fitted = op.fit_tfidf(docs, "doc_id", "text", 1000)
    return op.tfidf(docs, "doc_id", "text", fitted).withColumn("weight", F.round("weight", 6))


@query("text_embed")
def text_embed(spark, d):
    docs = tables.texts(spark, d, "documents").select("doc_id", "text")
    return op.text_embed(docs, "text").select("doc_id", "vector")


ITEM_FEATURES = """
feat AS (SELECT mal_id, dim, max(w) AS weight FROM (
  SELECT mal_id, unnest(genres) AS dim, 1.0::DOUBLE AS w FROM cat
  UNION ALL SELECT mal_id, tag_names[1], tag_weights[1] / 100 FROM cat
  UNION ALL SELECT mal_id, tag_names[2], tag_weights[2] / 100 FROM cat) GROUP BY ALL)
"""


@query("item_features", with_ctes(CAT, ITEM_FEATURES, body="SELECT * FROM feat"))
def item_features(spark, d):
    return op.item_features(cat_lean(spark, d))


@query("feature_vocab", with_ctes(CAT, ITEM_FEATURES, body="SELECT dim, row_number() OVER (ORDER BY dim) - 1 AS idx FROM (SELECT DISTINCT dim FROM feat)"))
def feature_vocab(spark, d):
    return op.feature_vocab(cat_lean(spark, d))


@query("genre_vectors_l2", with_ctes(CAT, GENRE_VEC, body="SELECT mal_id, dim, round(weight, 6) AS weight FROM gvec"))
def genre_vectors_l2(spark, d):
    return op.genre_vectors(cat_lean(spark, d)).withColumn("weight", F.round("weight", 6))


@query("rating_feature_view", with_ctes(INTER, body="""
SELECT user_id, item_id, ts AS event_timestamp, year(ts) AS timestamp_year, month(ts) AS timestamp_month, day(ts) AS timestamp_day,
  hour(ts) AS timestamp_hour, isodow(ts) - 1 AS timestamp_dayofweek, CAST(isodow(ts) >= 6 AS INTEGER) AS timestamp_is_weekend,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, item_id))) / 1e6 AS time_since_last, score AS rating FROM inter"""))
def rating_feature_view(spark, d):
    return plan.rating_features(inter(spark, d).withColumnsRenamed({"ts": "timestamp", "score": "rating"}))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("user_feature_view", "SELECT c_custkey AS user_id, c_acctbal, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"c_mktsegment_{s}\"" for s in SEGMENTS) + " FROM customer")
def user_feature_view(spark, d):
    users = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal", "c_mktsegment")
    return plan.user_features(users, {"c_mktsegment": SEGMENTS})


@query("movie_feature_view")
def movie_feature_view(spark, d):
    items = cat_lean(spark, d).select(
        "mal_id", "genres", "title", F.make_date("year", F.lit(6), F.lit(1)).alias("release_date")
    )
    return plan.item_features(items, "genres", "release_date", "title", "mal_id")


@query("split_and_scale")
def split_and_scale(spark, d):
    rows = tables.table(spark, d, "customer").select("c_custkey", "c_acctbal", F.abs("c_acctbal").alias("spend"))
    return plan.split_and_scale(rows, ["c_custkey"], ["c_acctbal", "spend"], ["spend"])


ASOF = """
f AS (SELECT user_id, ts AS fts, event_id AS feature_id, value FROM events WHERE event_type = 'purchase'),
e AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'purchase')
"""


@query("asof_features", with_ctes(ASOF, body="""
SELECT e.user_id, e.ts AS event_timestamp, e.event_id, f.feature_id, f.value FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.fts"""))
def asof_features(spark, d):
    return _asof(spark, d, None)


@query("asof_features_ttl", with_ctes(ASOF, body="""
SELECT e.user_id, e.ts AS event_timestamp, e.event_id, CASE WHEN ok THEN f.feature_id END AS feature_id, CASE WHEN ok THEN f.value END AS value
FROM (SELECT e.*, f.*, epoch_us(e.ts) - epoch_us(f.fts) <= 86400000000 AS ok FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.fts)"""
    .replace("e.user_id, e.ts AS", "user_id, ts AS", 1).replace("e.event_id, CASE", "event_id, CASE").replace("f.feature_id END", "feature_id END").replace("f.value END", "value END")))
def asof_features_ttl(spark, d):
    return _asof(spark, d, 86400.0)


def _asof(spark, d, ttl):
    ev = tables.table(spark, d, "events").withColumnRenamed("ts", "event_timestamp")
    feats = ev.filter("event_type = 'purchase'").select(
        "user_id", "event_timestamp", F.col("event_id").alias("feature_id"), "value"
    )
    ents = ev.filter("event_type <> 'purchase'").select("user_id", "event_timestamp", "event_id")
    return op.asof_join(ents, feats, ["user_id"], ttl_seconds=ttl)


@query("materialize_online", """
SELECT user_id, event_id, ts, value FROM events WHERE ts <= TIMESTAMP '2024-01-20'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def materialize_online(spark, d):
    """Two increments: the second is laid over the first."""
    ev = tables.table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    first = op.materialize(None, ev, ["user_id"], "ts", "2023-12-01", "2024-01-10", "event_id")
    return op.materialize(first, ev, ["user_id"], "ts", "2024-01-10", "2024-01-20", "event_id")


@query("online_features", """
WITH latest AS (SELECT user_id, event_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-02'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_custkey AS user_id, event_id, value FROM customer LEFT JOIN latest ON user_id = c_custkey""")
def online_features(spark, d):
    ev = tables.table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    online = op.materialize(None, ev, ["user_id"], "ts", "2023-12-01", "2024-01-02", "event_id").drop("ts")
    return op.online_lookup(online, tables.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), ["user_id"])


@query("online_rating_features", with_ctes(INTER, body="""
SELECT o_custkey AS user_id, o_orderkey % 997 AS item_id, i.score FROM orders LEFT JOIN inter i ON i.user_id = o_custkey AND i.item_id = o_orderkey % 997"""))
def online_rating_features(spark, d):
    asked = tables.user_list(spark, d).select("user_id", "item_id")
    return op.online_lookup(inter(spark, d).drop("ts"), asked, ["user_id", "item_id"])
