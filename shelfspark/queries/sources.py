"""Source and sink queries: given tables are written in the format and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shelfspark import schemas
from shelfspark.operators import catalog as cop, interactions as iop
from shelfspark.plans import tables
from shelfspark.queries import query
from shelfspark.queries.common import CAT, INTER, RAW, cat_lean, flat, inter, inter_once, with_ctes
from shelfspark.queries.catalog import FLAT_SQL
from shelfspark.runtime import cut_lineage, scratch_path
from shelfspark.sources import files, sinks


def ratings_frame(spark, d):
    line = tables.table(spark, d, "lineitem")
    orders = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("l_partkey").cast("int").alias("item_id"),
        F.col("l_linenumber").alias("rating"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
    )


RATINGS_SQL = """
SELECT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_partkey AS INTEGER) AS item_id, l_linenumber AS rating, CAST(epoch(l_shipdate) AS BIGINT) AS timestamp
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query("scan_delimited", RATINGS_SQL)
def scan_delimited(spark, d):
    path = scratch_path(spark, "u") + ".data"
    ratings_frame(spark, d).write.option("sep", "\t").csv(path)
    return files.read_delimited(spark, path, schemas.RATINGS, "\t")


@query("ingest_ratings_bundle", """
SELECT 'ratings' AS part, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem
UNION ALL SELECT 'movies', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part UNION ALL SELECT 'users', count(*), CAST(sum(c_nationkey) AS BIGINT) FROM customer""")
def ingest_ratings_bundle(spark, d):
    """Three files in their own formats -> read with schemas -> CSV with header -> read back."""
    base, out = scratch_path(spark, "bundle"), scratch_path(spark, "processed")
    ratings_frame(spark, d).write.option("sep", "\t").csv(f"{base}/u.data")
    part = tables.table(spark, d, "part")
    flags = [(F.col("p_partkey") % (i + 2) == 0).cast("int").alias(g) for i, g in enumerate(schemas.MOVIE_GENRES)]
    movies = part.select(
        F.col("p_partkey").cast("int"), F.concat(F.col("p_name"), F.lit(" é")), F.lit("01-Jan-1995"), F.lit(""), F.lit("http://x"), *flags
    )
    movies.write.option("sep", "|").option("encoding", "ISO-8859-1").csv(f"{base}/u.item")
    cust = tables.table(spark, d, "customer")
    cust.select(
        F.col("c_custkey").cast("int"), F.col("c_nationkey"), F.lit("F"), F.lower("c_mktsegment"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    ).write.option("sep", "|").csv(f"{base}/u.user")
    parts = []
    value = {"ratings": "rating", "movies": "movie_id", "users": "age"}
    for name, df in files.read_ratings_bundle(spark, base).items():
        sinks.write_csv(df, f"{out}/{name}")
        back = spark.read.option("header", True).csv(f"{out}/{name}")
        parts.append(back.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum(F.col(value[name]).cast("long")).alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("html_table_rows", """
SELECT p_partkey AS page_id, 0 AS row_no, 'name|size' AS cells FROM part UNION ALL SELECT p_partkey, 1, p_name || '|' || p_size FROM part""")
def html_table_rows(spark, d):
    page = F.concat(
        F.lit("<html><body><p>x</p><TABLE><tr><th>name</th><th>size</th></tr><tr><td> <b>"), F.col("p_name"), F.lit("</b>\n</td><td>"),
        F.col("p_size").cast("string"), F.lit("</td></tr></TABLE><table><tr><td>second</td></tr></table></body></html>"),
    )
    pages = tables.table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html"))
    return flat(files.html_table_rows(pages))


@query("html_tables_in_pages", "SELECT page_id, 0 AS row_no, '' AS cells FROM pages WHERE contains(lower(html), '<table')")
def html_tables_in_pages(spark, d):
    return flat(files.html_table_rows(tables.table(spark, d, "pages")))


@query("scan_ndjson", "SELECT event_id, user_id, event_type, value FROM events")
def scan_ndjson(spark, d):
    path = scratch_path(spark, "events-ndjson")
    tables.table(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    return files.read_ndjson(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("scan_ndjson_corrupt", "SELECT count(*) AS n, CAST(sum(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM events")
def scan_ndjson_corrupt(spark, d):
    path = scratch_path(spark, "broken-ndjson")
    line = F.to_json(F.struct("event_id", "value"))
    rows = tables.table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    rows.write.text(path)
    back = files.read_ndjson(spark, path, "event_id bigint, value double", strict=False)
    kept = cut_lineage(back, "parsed")  # the record column alone cannot be read from raw files
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count(files.CORRUPT).alias("broken"))


@query("scan_catalog_ndjson", with_ctes(CAT, RAW, body=FLAT_SQL).replace(
    "SELECT c.mal_id, CASE WHEN c.mal_id % 50 <> 0 THEN title ELSE 'Anime ' || c.mal_id END AS title", "SELECT c.mal_id, CASE WHEN c.mal_id % 50 <> 0 THEN title END AS title"
).replace(FLAT_SQL[FLAT_SQL.index(", title_japanese"):FLAT_SQL.index("FROM cat c JOIN")], ", status, season\n"))
def scan_catalog_ndjson(spark, d):
    path = scratch_path(spark, "crawl")
    raw = tables.raw_payloads(spark, d)
    lines = raw.select(F.concat(F.lit('{"mal_id":'), F.col("mal_id").cast("string"), F.lit(',"data":'), F.col("payload"), F.lit("}")))
    lines.write.text(path)
    return files.read_crawl(spark, path).select("mal_id", "title", "status", "season")


@query("scan_json_documents", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def scan_json_documents(spark, d):
    """One array of at most a thousand documents per file."""
    path = scratch_path(spark, "docs")
    doc = F.struct("c_custkey", "c_name", "c_nationkey")
    packed = (
        tables.table(spark, d, "customer")
        .groupBy(F.floor(F.col("c_custkey") / 1000).alias("g"))
        .agg(F.to_json(F.collect_list(doc)).alias("value"))
    )
    packed.repartition("g").write.partitionBy("g").text(path)
    return files.read_json_documents(spark, path, "c_custkey bigint, c_name string, c_nationkey int").drop("g")


@query("scan_document_store", "SELECT c_custkey, c_name AS email FROM customer WHERE c_custkey % 4 <> 0")
def scan_document_store(spark, d):
    path = scratch_path(spark, "store")
    doc = F.struct(
        F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("email")
    )
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), doc)))
    packed = (
        tables.table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 1000).alias("g"))
        .agg(F.to_json(F.struct(pairs.alias("_default"))).alias("value"))
    )
    packed.repartition("g").write.partitionBy("g").text(path)
    return files.read_document_store(spark, path, "k:bigint,email:string").withColumnRenamed("k", "c_custkey")


@query("scan_features_parquet", "SELECT event_id, user_id, ts AS event_timestamp FROM events")
def scan_features_parquet(spark, d):
    rows = tables.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("string").alias("ts"))
    return files.read_features(rows, "ts")


@query("scan_partitioned", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS items, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def scan_partitioned(spark, d):
    """The chunked table scan: partitions replace cursor batches, only needed columns are read."""
    line = tables.table(spark, d, "lineitem").select("l_partkey", "l_linenumber")
    return line.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("items"), F.sum("l_linenumber").alias("total"))


@query("sink_snapshot", with_ctes(INTER, body="SELECT count(*) AS n_rows, true AS same FROM inter"))
def sink_snapshot(spark, d):
    """What was written has the digest of what was to be written."""
    log = inter_once(spark, d)
    before = sinks.content_digest(log).select("digest").scalar()
    return sinks.write_snapshot(log, scratch_path(spark, "snapshot")).select("n_rows", (F.col("digest") == before).alias("same"))


@query("sink_run_manifest", with_ctes(INTER, body="""
SELECT 'cf_matrix' AS run, 'real' AS data_source, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS nnz,
  round(round(count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 8), 6) AS density FROM inter"""))
def sink_run_manifest(spark, d):
    path = scratch_path(spark, "manifest")
    stats = iop.matrix_stats(inter(spark, d))
    sinks.run_manifest(stats, "cf_matrix", {"min_user": 5}, "real", datetime(2024, 1, 1)).write.json(path)
    stats = F.from_json("metrics", "n_users bigint, n_items bigint, nnz bigint, density double").alias("m")
    return spark.read.json(path).select("run", "data_source", stats).select("run", "data_source", "m.*")


@query("sink_csv", with_ctes(CAT, body="SELECT mal_id, title, array_to_string(genres, '|') AS genres, score FROM cat"))
def sink_csv(spark, d):
    path = scratch_path(spark, "csv")
    sinks.write_csv(cat_lean(spark, d).select("mal_id", "title", "genres", "score"), path)
    back = spark.read.schema("mal_id bigint, title string, genres string, score double").option("header", True).option("escape", '"').csv(path)
    return flat(back.withColumn("genres", F.from_json("genres", "array<string>")))


@query("sink_ndjson_append", with_ctes(RAW, body="SELECT mal_id FROM raw"))
def sink_ndjson_append(spark, d):
    """Two runs; the second appends only what the first did not write."""
    path = scratch_path(spark, "append")
    raw = tables.raw_payloads(spark, d)
    sinks.append_ndjson(raw.filter("mal_id % 2 = 0").select("mal_id", F.col("payload").alias("data")), path)
    done = spark.read.schema("mal_id bigint").json(path)
    empty = done.limit(0)
    todo = cop.crawl_todo(raw.select("mal_id"), done, empty)
    sinks.append_ndjson(raw.join(todo, "mal_id", "left_semi").select("mal_id", F.col("payload").alias("data")), path)
    return spark.read.schema("mal_id bigint").json(path)


@query("sink_keyed_json", """
SELECT 'user' AS namespace, CAST(user_id AS VARCHAR) AS id, CAST(event_id AS BIGINT) AS event_id, value FROM events WHERE user_id % 7 <> 0
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def sink_keyed_json(spark, d):
    rows = tables.table(spark, d, "events").select(
        F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"), "event_id", "value"
    )
    store = sinks.keyed_json(rows, "user", "user_id", "event_id")
    body = F.from_json("value", "event_id bigint, value double")
    return store.select("namespace", "id", body.alias("b")).select("namespace", "id", "b.event_id", "b.value")
