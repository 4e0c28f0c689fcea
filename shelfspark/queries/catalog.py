"""Catalog queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shelfspark.operators import catalog as op, resolve
from shelfspark.plans import tables
from shelfspark.queries import query
from shelfspark.queries.common import CAT, RAW, cat, cat_lean, flat, with_ctes

TAG_TEXT = "tag_names[1] || ':' || tag_weights[1] || '|' || tag_names[2] || ':' || tag_weights[2]"
NOW = datetime(2024, 1, 3, 6)
MARK = datetime(2024, 1, 2, 12)

FLAT_SQL = f"""
SELECT c.mal_id, CASE WHEN c.mal_id % 50 <> 0 THEN title ELSE 'Anime ' || c.mal_id END AS title, title_japanese, synopsis,
  CASE WHEN c.mal_id % 7 <> 0 THEN episodes END AS episodes, status, season,
  CASE WHEN c.mal_id % 33 <> 0 THEN year END AS year, array_to_string(studios, '|') AS studios, c.source,
  array_to_string(genres, '|') AS genres, {TAG_TEXT} AS tags, score, image_url, r.source AS sources, score AS score_mal,
  CAST(c.mal_id * 3 AS INTEGER) AS scored_by_mal, CAST(c.mal_id + 1 AS INTEGER) AS rank_mal,
  CASE WHEN c.mal_id % 9 <> 0 THEN CAST(c.mal_id % 1000 AS INTEGER) END AS popularity_mal
FROM cat c JOIN raw r USING (mal_id)
"""


@query("flatten_payload", with_ctes(CAT, RAW, body=FLAT_SQL))
def flatten_payload(spark, d):
    return flat(op.flatten_payload(tables.raw_payloads(spark, d)))


@query(
    "flatten_payload_basic",
    with_ctes(CAT, body="""
SELECT mal_id, CASE WHEN mal_id % 50 <> 0 THEN title ELSE 'Anime ' || mal_id END AS title, title_japanese, synopsis,
  CASE WHEN mal_id % 7 <> 0 THEN episodes END AS episodes, status, season,
  CASE WHEN mal_id % 33 <> 0 THEN year END AS year, array_to_string(studios, '|') AS studios, source,
  genres[1] AS genres, '' AS tags, score, CASE WHEN mal_id % 3 <> 2 THEN image_url END AS image_url
FROM cat"""),
)
def flatten_payload_basic(spark, d):
    return flat(op.flatten_payload_basic(tables.raw_payloads(spark, d)))


@query(
    "mal_metrics_projection",
    with_ctes(CAT, body="""
SELECT mal_id, score AS score_mal, CAST(mal_id * 3 AS INTEGER) AS scored_by_mal, CAST(mal_id + 1 AS INTEGER) AS rank_mal,
  CASE WHEN mal_id % 9 <> 0 THEN CAST(mal_id % 1000 AS INTEGER) END AS popularity_mal FROM cat"""),
)
def mal_metrics_projection(spark, d):
    return op.parse_payload(tables.raw_payloads(spark, d)).select("mal_id", *op.mal_metrics())


@query("catalog_mini", with_ctes(CAT, body="SELECT mal_id, title, title_japanese, image_url, score, year FROM cat"))
def catalog_mini(spark, d):
    return op.mini(cat_lean(spark, d))


@query(
    "catalog_detail",
    with_ctes(CAT, body=f"""
SELECT mal_id, title, title_japanese, synopsis, episodes, status, season, year, array_to_string(studios, '|') AS studios,
  source, array_to_string(genres, '|') AS genres, {TAG_TEXT} AS tags, score, image_url FROM cat WHERE mal_id = 77"""),
)
def catalog_detail(spark, d):
    return flat(op.detail(cat_lean(spark, d), 77))


@query(
    "catalog_search",
    with_ctes(CAT, body="""
SELECT mal_id, title, title_japanese, image_url, score, year FROM cat
WHERE title ILIKE '%RI%' AND list_contains(genres, 'ring') AND season = 'spring' AND status = 'Finished Airing'
ORDER BY score DESC NULLS LAST, mal_id LIMIT 50"""),
)
def catalog_search(spark, d):
    return op.search(cat_lean(spark, d), "RI", genre="ring", season="spring", status="Finished Airing", limit=80)


@query(
    "watermark_filter",
    with_ctes(RAW, body="SELECT mal_id, fetched_at FROM raw WHERE fetched_at > TIMESTAMP '2024-01-02 12:00:00'"),
)
def watermark_filter(spark, d):
    return op.since(tables.raw_payloads(spark, d), "fetched_at", MARK).select("mal_id", "fetched_at")


@query("freshness_filter", with_ctes(RAW, body="SELECT mal_id FROM raw WHERE expires_at > TIMESTAMP '2024-01-03 06:00:00'"))
def freshness_filter(spark, d):
    return op.fresh(tables.raw_payloads(spark, d), NOW)


@query("not_enriched_filter", with_ctes(RAW, body="SELECT mal_id FROM raw WHERE source <> 'anilist'"))
def not_enriched_filter(spark, d):
    rows = op.flatten_payload(tables.raw_payloads(spark, d)).withColumn("doc_vi", F.lit(None).cast("string"))
    return op.untranslated(op.not_enriched(rows)).select("mal_id")


@query(
    "genre_prefilter",
    with_ctes(CAT, body="SELECT mal_id, array_to_string(genres, ', ') AS genres FROM cat WHERE list_contains(genres, 'widget')"),
)
def genre_prefilter(spark, d):
    points = cat_lean(spark, d).select("mal_id", F.array_join("genres", ", ").alias("genres"))
    return op.genre_filter(points, "Widget")


@query(
    "trending",
    with_ctes(CAT, body="""
SELECT mal_id, title, title_japanese, image_url, score, year FROM cat ORDER BY score DESC NULLS LAST, mal_id LIMIT 50"""),
)
def trending(spark, d):
    return op.trending(cat_lean(spark, d), 50)


@query("popular_list", with_ctes(CAT, body="SELECT mal_id, coalesce(score, 0.0) AS score FROM cat ORDER BY 2 DESC, 1 DESC"))
def popular_list(spark, d):
    return op.popular(cat_lean(spark, d))


@query(
    "genre_top_n",
    with_ctes(CAT, body="""
, tok AS (SELECT DISTINCT lower(p_type) AS token FROM part UNION SELECT 'ri' UNION SELECT 'isekai'),
hits AS (SELECT DISTINCT token, mal_id, coalesce(score, 0.0) AS score, members FROM (
  SELECT mal_id, score, members, unnest(genres) AS g FROM cat) JOIN tok ON contains(lower(g), token))
SELECT token, mal_id, score, members, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, members DESC, mal_id) AS rank FROM hits) WHERE rank <= 3"""),
)
def genre_top_n(spark, d):
    extra = spark.createDataFrame([("ri",), ("isekai",)], "token string")
    tokens = tables.table(spark, d, "part").select(F.lower("p_type").alias("token")).distinct().union(extra)
    return op.genre_top(cat(spark, d), tokens, 3).select("token", "mal_id", "score", "members", "rank")


@query(
    "finished_top_n",
    with_ctes(CAT, body="""
SELECT mal_id, title, coalesce(score, 0.0) AS score FROM cat WHERE status = 'Finished Airing' ORDER BY 3 DESC, mal_id LIMIT 3"""),
)
def finished_top_n(spark, d):
    return op.finished_top(cat_lean(spark, d)).select("mal_id", "title", "score")


@query("limit_cap", with_ctes(CAT, body="SELECT mal_id, score FROM cat ORDER BY score DESC NULLS LAST, mal_id LIMIT 25"))
def limit_cap(spark, d):
    return cat_lean(spark, d).select("mal_id", "score").orderBy(*op.by_score()).limit(op.clamp(1000, 1, 25))


@query("backfill_from_raw", with_ctes(CAT, RAW, body="""
SELECT c.mal_id,
  CASE WHEN r.source IN ('jikan', 'tenrai') THEN score ELSE 5.5 END AS score_mal,
  CASE WHEN r.source IN ('jikan', 'tenrai') THEN CAST(c.mal_id * 3 AS INTEGER) ELSE -1 END AS scored_by_mal,
  CASE WHEN r.source IN ('jikan', 'tenrai') THEN CAST(c.mal_id + 1 AS INTEGER) ELSE -1 END AS rank_mal,
  CASE WHEN r.source IN ('jikan', 'tenrai') THEN CASE WHEN c.mal_id % 9 <> 0 THEN CAST(c.mal_id % 1000 AS INTEGER) END
       ELSE -1 END AS popularity_mal
FROM cat c JOIN raw r USING (mal_id)"""))  # fmt: skip
def backfill_from_raw(spark, d):
    base = cat_lean(spark, d).select(
        "mal_id",
        F.lit(5.5).alias("score_mal"),
        *[F.lit(-1).alias(c) for c in ("scored_by_mal", "rank_mal", "popularity_mal")],
    )
    return op.backfill_from_raw(base, tables.raw_payloads(spark, d))


@query("similar_by_genre", with_ctes(CAT, body="""
, ex AS (SELECT mal_id, score, unnest(genres) AS g FROM cat),
pairs AS (SELECT DISTINCT a.mal_id, b.mal_id AS item, b.score FROM ex a JOIN ex b ON a.g = b.g AND a.mal_id <> b.mal_id)
SELECT * FROM (SELECT mal_id, item, score, row_number() OVER (PARTITION BY mal_id ORDER BY score DESC NULLS LAST, item) AS rank
  FROM pairs) WHERE rank <= 10"""))  # fmt: skip
def similar_by_genre(spark, d):
    return op.similar_by_genre(cat_lean(spark, d), 10).select("mal_id", "item", "score", "rank")


@query("same_genre_pool", with_ctes(CAT, body="""
, ex AS (SELECT mal_id, coalesce(score, 0.0) AS score, members, unnest(genres) AS g FROM cat),
pairs AS (SELECT DISTINCT a.mal_id, b.mal_id AS item, b.score, b.members FROM ex a JOIN ex b ON a.g = b.g AND a.mal_id <> b.mal_id)
SELECT * FROM (SELECT mal_id, item, score, members,
  row_number() OVER (PARTITION BY mal_id ORDER BY score DESC, members DESC, item) AS rank FROM pairs) WHERE rank <= 3"""))  # fmt: skip
def same_genre_pool(spark, d):
    rows = cat(spark, d).withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = [F.col("score").desc(), F.col("members").desc(), F.col("item").asc()]
    return op.similar_by_genre(rows, 3, order).select("mal_id", "item", "score", "members", "rank")


@query("crawl_todo", with_ctes(RAW, body="""
SELECT DISTINCT l_partkey AS mal_id FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)
  AND l_partkey NOT IN (SELECT mal_id FROM raw WHERE expires_at > TIMESTAMP '2024-01-03 06:00:00')"""))  # fmt: skip
def crawl_todo(spark, d):
    ids = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("mal_id")).distinct()
    done = tables.table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("mal_id"))
    return op.crawl_todo(ids, done, op.fresh(tables.raw_payloads(spark, d), NOW))


MEDIA_SQL = """
media AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 10000000000 ELSE p_partkey END AS mal_id, p_brand || ':' || p_size || '|' || p_type || ':0' AS tags_anilist,
    nullif(CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 101 ELSE 0 END / 10, 0) AS score_anilist,
    CAST(p_partkey % 500 AS INTEGER) AS favourites_anilist, CAST(p_partkey % 700 AS INTEGER) AS popularity_anilist,
    p_name || ' of ' || p_brand AS description_anilist
  FROM part WHERE p_partkey % 11 <> 0)
"""


@query("media_to_row", with_ctes(MEDIA_SQL, body="SELECT * FROM media"))
def media_to_row(spark, d):
    return flat(op.media_to_row(tables.media_rows(spark, d)))


@query("enrich_catalog", with_ctes(CAT, RAW, MEDIA_SQL, body="""
SELECT c.mal_id, m.tags_anilist, m.score_anilist, m.favourites_anilist, m.popularity_anilist, m.description_anilist,
  CASE WHEN m.mal_id IS NULL OR r.source = 'anilist' THEN r.source
       ELSE array_to_string(list_sort([r.source, 'anilist']), '|') END AS sources
FROM cat c JOIN raw r USING (mal_id) LEFT JOIN media m ON m.mal_id = c.mal_id"""))  # fmt: skip
def enrich_catalog(spark, d):
    from shelfspark import schemas

    base = op.flatten_payload(tables.raw_payloads(spark, d)).select("mal_id", "sources")
    for f in schemas.fields(schemas.CATALOG):
        if f.name in op._ANILIST:
            base = base.withColumn(f.name, F.lit(None).cast(f.dataType))
    return flat(op.enrich(base, op.media_to_row(tables.media_rows(spark, d))))


@query("array_union_sources", with_ctes(RAW, body="""
SELECT mal_id, array_to_string(list_sort(list_distinct([source, 'tenrai'])), '|') AS sources FROM raw"""))
def array_union_sources(spark, d):
    rows = op.flatten_payload(tables.raw_payloads(spark, d))
    return flat(rows.select("mal_id", op.union_sources(F.col("sources"), F.array(F.lit("tenrai"))).alias("sources")))


@query("merge_sources", with_ctes(CAT, MEDIA_SQL, body="""
SELECT coalesce(c.mal_id, m.mal_id) AS mal_id, coalesce(c.score, m.score_anilist) AS score, c.title, m.popularity_anilist,
  c.mal_id IS NOT NULL AS in_first, m.mal_id IS NOT NULL AS in_second
FROM (SELECT CASE WHEN mal_id % 4 = 1 THEN mal_id + 20000000000 ELSE mal_id END AS mal_id, title, score FROM cat) c FULL OUTER JOIN media m ON m.mal_id = c.mal_id"""))  # fmt: skip
def merge_sources(spark, d):
    """A quarter of the first side's items and a third of the second side's are only there."""
    key = F.when(F.col("mal_id") % 4 == 1, F.col("mal_id") + 20_000_000_000).otherwise(F.col("mal_id"))
    first = cat_lean(spark, d).select(key.alias("mal_id"), "title", "score")
    second = op.media_to_row(tables.media_rows(spark, d)).select(
        "mal_id", F.col("score_anilist").alias("score"), "popularity_anilist"
    )
    return op.merge_sources(first, second)


@query("resolve_titles", """
WITH cat AS (SELECT p_partkey AS mal_id, p_name, CASE WHEN p_partkey % 4 = 0 THEN 'JP ' || p_name END AS jp,
    CASE WHEN p_partkey % 5 % 2 = 0 THEN 0 ELSE 1 END AS film FROM part),
idx AS (SELECT key, min(mal_id) AS mal_id FROM (SELECT lower(p_name) AS key, mal_id FROM cat
  UNION ALL SELECT lower(jp), mal_id FROM cat WHERE jp IS NOT NULL) GROUP BY key),
keyed AS (SELECT key, i.mal_id, film FROM idx i JOIN cat USING (mal_id)),
names AS (SELECT DISTINCT name FROM (
  SELECT upper(p_name) || ' (' || p_type || ')' AS name FROM part
  UNION ALL SELECT substr(p_name, 2, 5) FROM part UNION ALL SELECT right(p_name, 2) FROM part UNION ALL SELECT p_brand FROM part)),
asked AS (SELECT name, trim(regexp_replace(lower(regexp_replace(name, '\\(.*?\\)', '', 'g')), '\\s+', ' ', 'g')) AS k FROM names),
best AS (SELECT name, mal_id, row_number() OVER (PARTITION BY name ORDER BY (key <> k)::INT,
    CASE WHEN key = k THEN 0 ELSE length(key) END, CASE WHEN key = k THEN 0 ELSE film END, mal_id, key) AS r
  FROM asked JOIN keyed ON contains(key, k) WHERE k <> '')
SELECT name, mal_id FROM best WHERE r = 1""")
def resolve_titles(spark, d):
    part = tables.table(spark, d, "part")
    forms = [
        F.concat(F.upper("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")")),
        F.substring("p_name", 2, 5),
        F.right(F.col("p_name"), F.lit(2)),
        F.col("p_brand"),
    ]
    names = part.select(F.explode(F.array(*forms)).alias("name"))
    return resolve.resolve_titles(names, cat_lean(spark, d))


@query("discover_ids", """
WITH pages AS (SELECT 0 AS arm, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS pos,
    CASE WHEN p_size > 5 THEN p_partkey ELSE p_partkey + 30000000000 END AS id FROM part
  UNION ALL SELECT p_partkey % 3 + 1, p_partkey, p_partkey FROM part),
firsts AS (SELECT arm, id, min(pos) AS pos FROM pages GROUP BY arm, id)
SELECT id, arm, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arm, pos) AS r FROM firsts) WHERE r = 1""")
def discover_ids(spark, d):
    from shelfspark.operators.skew import dense_index

    part = tables.table(spark, d, "part")
    # small items are on the top pages under ids that the seasons do not have
    known = F.when(F.col("p_size") > 5, F.col("p_partkey")).otherwise(F.col("p_partkey") + 30_000_000_000)
    keyed = part.select(F.struct((-F.col("p_retailprice")).alias("p"), "p_partkey").alias("o"), known.alias("id"))
    top = keyed.join(dense_index(keyed, "o", "pos"), "o").select(F.lit(0).alias("arm"), "pos", "id")
    season = part.select(
        (F.col("p_partkey") % 3 + 1).cast("int").alias("arm"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("id")
    )
    return op.discover_ids(top.unionByName(season))
