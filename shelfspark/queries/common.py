"""Shared inputs and SQL fragments of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.plans import tables
from shelfspark.runtime import cut_lineage

# --- SQL twins of shelfspark.plans.tables ------------------------------------------

INTER = """
inter AS (
  SELECT user_id, item_id, score, ts FROM (
    SELECT o_custkey AS user_id, l_partkey AS item_id,
           CAST(1 + (CAST(l_quantity AS BIGINT) - 1) % 10 AS INTEGER) AS score, l_shipdate AS ts,
           row_number() OVER (PARTITION BY o_custkey, l_partkey
             ORDER BY l_shipdate DESC, 1 + (CAST(l_quantity AS BIGINT) - 1) % 10 DESC) AS rn
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)
"""

CAT = """
cat AS (
  SELECT p_partkey AS mal_id, p_name AS title, p_type, p_brand, p_size,
    CASE WHEN p_partkey % 4 = 0 THEN 'JP ' || p_name END AS title_japanese,
    CASE WHEN p_partkey % 10 <> 0 THEN 'A tale of ' || p_name || ' in ' || lower(p_type) END AS synopsis,
    p_size AS episodes,
    ['Finished Airing', 'Currently Airing', 'Not yet aired'][p_partkey % 3 + 1] AS status,
    ['winter', 'spring', 'summer', 'fall'][p_partkey % 4 + 1] AS season,
    CAST(1990 + p_partkey % 30 AS INTEGER) AS year,
    [p_brand] AS studios,
    ['Manga', 'Original'][p_partkey % 2 + 1] AS source,
    list_sort(list_distinct(string_split(p_name, ' ') || [p_type])) AS genres,
    [p_brand, string_split(p_name, ' ')[2]] AS tag_names,
    [p_size * 2, CAST(p_partkey % 101 AS INTEGER)] AS tag_weights,
    CASE WHEN p_partkey % 20 <> 0 THEN 1 + (p_partkey * 7 % 91) / 10 END AS score,
    CASE WHEN p_partkey % 25 <> 0 THEN 'http://img/' || p_partkey || '.jpg' END AS image_url,
    ['TV', 'Movie'][p_partkey % 5 % 2 + 1] AS type,
    coalesce(n, 0) AS members
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)
"""

RAW = """
raw AS (
  SELECT p_partkey AS mal_id, ['jikan', 'tenrai', 'anilist'][p_partkey % 3 + 1] AS source,
    TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 72 AS INTEGER)) AS fetched_at,
    TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 72 + 24 AS INTEGER)) AS expires_at
  FROM part)
"""

LIST = """
list AS (
  SELECT o_orderkey AS entry_id, o_custkey AS user_id, o_orderkey % 997 AS item_id,
    CASE WHEN o_orderkey % 101 = 0 THEN 'paused' ELSE
      CASE o_orderpriority WHEN '1-URGENT' THEN 'watching' WHEN '2-HIGH' THEN 'completed' WHEN '3-MEDIUM' THEN 'on_hold'
        WHEN '4-NOT SPECIFIED' THEN 'dropped' WHEN '5-LOW' THEN 'plan_to_watch' END END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 12 AS INTEGER) END AS score,
    CAST(o_orderkey % 26 AS INTEGER) AS progress, o_orderdate AS changed_at
  FROM orders)
"""

# one row per rated list entry: latest order per (user, item)
RATED = (
    LIST
    + """,
rated AS (
  SELECT user_id, item_id, CASE WHEN score IS NOT NULL AND score <> 0 THEN score / 10 ELSE
      coalesce(CASE status WHEN 'completed' THEN 1.0::DOUBLE WHEN 'watching' THEN 0.7::DOUBLE WHEN 'plan_to_watch' THEN 0.2::DOUBLE
        WHEN 'on_hold' THEN 0.3::DOUBLE WHEN 'dropped' THEN 0.0::DOUBLE END, 0.0::DOUBLE) END AS rating
  FROM list)
"""
)

# L2-normalised genre rows
GENRE_VEC = """
gvec AS (
  SELECT mal_id, unnest(genres) AS dim, 1 / sqrt(len(genres)) AS weight FROM cat)
"""

HISTORY = """
hist AS (SELECT user_id, item_id FROM inter)
"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + body


# --- inputs ----------------------------------------------------------------------------


def cat(spark: SparkSession, d: str) -> DataFrame:
    return tables.catalog(spark, d).withColumnRenamed("item_id", "mal_id")


def cat_lean(spark: SparkSession, d: str) -> DataFrame:
    """The catalog without the member counts: one scan of the item table."""
    return tables.catalog(spark, d, with_members=False).withColumnRenamed("item_id", "mal_id")


def cat_once(spark: SparkSession, d: str) -> DataFrame:
    """The catalog as a written table, for plans that read it many times."""
    return cut_lineage(cat(spark, d), "catalog")


def inter(spark: SparkSession, d: str) -> DataFrame:
    return tables.interactions(spark, d)


def inter_once(spark: SparkSession, d: str) -> DataFrame:
    """The interaction log as a written table, for plans that read it many times."""
    return cut_lineage(inter(spark, d), "interactions")


def joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


def flat(df: DataFrame) -> DataFrame:
    """Array columns as text, arrays of (name, weight) as name:weight."""
    out = []
    for c, t in df.dtypes:
        if t.startswith("array<struct<name"):
            pairs = F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["weight"].cast("string")))
            out.append(F.array_join(pairs, "|").alias(c))
        elif t.startswith("array"):
            out.append(joined(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
