"""Stand-in tables: the given parquet tables in the shapes the operators expect.

Pure projections, joins and aggregations; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.runtime import spread

SEASONS = ["winter", "spring", "summer", "fall"]
STATUSES = ["Finished Airing", "Currently Airing", "Not yet aired"]
# order priority -> list status
LIST_STATUS = {
    "1-URGENT": "watching",
    "2-HIGH": "completed",
    "3-MEDIUM": "on_hold",
    "4-NOT SPECIFIED": "dropped",
    "5-LOW": "plan_to_watch",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table for CPU-heavy expressions: spread over the cores if its file is small."""
    return spread(table(spark, sf_dir, name))


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, score 1..10, ts), one row per pair: latest, then highest score."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    score = (F.lit(1) + F.pmod(F.col("l_quantity").cast("int") - 1, F.lit(10))).cast("int")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            F.struct(F.col("l_shipdate").alias("ts"), score.alias("score")).alias("s"),
        )
        .groupBy("user_id", "item_id")
        .agg(F.max("s").alias("s"))
        .select("user_id", "item_id", "s.score", "s.ts")
    )


def catalog(spark: SparkSession, sf_dir: str, with_members: bool = True) -> DataFrame:
    """Flat catalog rows derived from ``part``."""
    pk = F.col("p_partkey")
    words = F.split("p_name", " ")
    word = F.element_at(words, 2)
    base = table(spark, sf_dir, "part").select(
        pk.alias("item_id"),
        F.col("p_name").alias("title"),
        F.when(pk % 4 == 0, F.concat(F.lit("JP "), F.col("p_name"))).alias("title_japanese"),
        F.when(pk % 10 != 0, F.concat(F.lit("A tale of "), F.col("p_name"), F.lit(" in "), F.lower("p_type"))).alias(
            "synopsis"
        ),
        F.col("p_size").alias("episodes"),
        pick(STATUSES, pk % 3).alias("status"),
        pick(SEASONS, pk % 4).alias("season"),
        (F.lit(1990) + pk % 30).cast("int").alias("year"),
        F.array("p_brand").alias("studios"),
        pick(["Manga", "Original"], pk % 2).alias("source"),
        F.array_sort(F.array_distinct(F.concat(words, F.array("p_type")))).alias("genres"),
        F.array(
            F.struct(F.col("p_brand").alias("name"), (F.col("p_size") * 2).alias("weight")),
            F.struct(word.alias("name"), (pk % 101).cast("int").alias("weight")),
        ).alias("tags"),
        F.when(pk % 20 != 0, F.lit(1) + (pk * 7 % 91) / 10).alias("score"),
        F.when(pk % 25 != 0, F.concat(F.lit("http://img/"), pk.cast("string"), F.lit(".jpg"))).alias("image_url"),
        pick(["TV", "Movie"], pk % 5 % 2).alias("type"),
    )
    if not with_members:
        return base
    members = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("item_id"))
        .agg(F.count(F.lit(1)).alias("members"))
    )
    return base.join(members, "item_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mal_id, source, payload JSON, fetched_at, expires_at)."""
    pk = F.col("item_id")

    def named(c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(x.alias("name")))

    c = catalog(spark, sf_dir, with_members=False)
    none = F.array().cast("array<struct<name:string>>")
    payload = F.struct(
        F.when(pk % 50 != 0, F.col("title")).alias("title"),
        "title_japanese",
        "synopsis",
        F.when(pk % 7 == 0, F.lit("")).otherwise(F.col("episodes").cast("string")).alias("episodes"),
        "status",
        "season",
        F.when(pk % 33 == 0, F.lit("")).otherwise(F.col("year").cast("string")).alias("year"),
        named(F.col("studios")).alias("studios"),
        "source",
        named(F.slice("genres", 1, 1)).alias("genres"),
        named(F.slice("genres", 2, 5)).alias("themes"),
        F.when(pk % 2 == 0, named(F.slice("genres", 1, 1))).otherwise(none).alias("demographics"),
        F.col("tags"),
        F.col("score").cast("string").alias("score"),
        F.struct(
            F.struct(
                F.when(pk % 3 == 0, F.col("image_url")).alias("large_image_url"),
                F.when(pk % 3 == 1, F.col("image_url")).alias("image_url"),
            ).alias("jpg"),
            F.struct(F.col("image_url").alias("large_image_url")).alias("webp"),
        ).alias("images"),
        (pk * 3).cast("string").alias("scored_by"),
        (pk + 1).cast("string").alias("rank"),
        F.when(pk % 9 == 0, F.lit("")).otherwise((pk % 1000).cast("string")).alias("popularity"),
    )
    fetched = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(pk % 72).cast("int"))
    return c.select(
        pk.alias("mal_id"),
        pick(["jikan", "tenrai", "anilist"], pk % 3).alias("source"),
        F.to_json(payload).alias("payload"),
        fetched.alias("fetched_at"),
        (fetched + F.make_dt_interval(hours=F.lit(24))).alias("expires_at"),
    )


def media_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-source rows: idMal, tags, averageScore, …; a third are of items that the catalog does not have, some have no id."""
    pk = F.col("p_partkey")
    return (
        table(spark, sf_dir, "part")
        .select(
            F.when(pk % 11 != 0, F.when(pk % 3 == 0, pk + 10_000_000_000).otherwise(pk)).alias("idMal"),
            F.array(
                F.struct(F.col("p_brand").alias("name"), F.col("p_size").alias("rank")),
                F.struct(F.lit(None).cast("string").alias("name"), F.lit(5).alias("rank")),
                F.struct(F.col("p_type").alias("name"), F.lit(None).cast("int").alias("rank")),
            ).alias("tags"),
            F.when(pk % 10 != 0, (pk % 101).cast("int")).alias("averageScore"),
            (pk % 500).cast("int").alias("favourites"),
            (pk % 700).cast("int").alias("popularity"),
            F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b><br>  of "), F.col("p_brand")).alias("description"),
        )
    )


def user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries from ``orders``: (entry_id, user_id, item_id, status, score, progress, changed_at)."""
    ok = F.col("o_orderkey")
    status = F.create_map(*[F.lit(x) for kv in LIST_STATUS.items() for x in kv])[F.col("o_orderpriority")]
    return table(spark, sf_dir, "orders").select(
        ok.alias("entry_id"),
        F.col("o_custkey").alias("user_id"),
        (ok % 997).alias("item_id"),
        F.when(ok % 101 == 0, F.lit("paused")).otherwise(status).alias("status"),
        F.when(ok % 3 == 0, (ok % 12).cast("int")).alias("score"),
        (ok % 26).cast("int").alias("progress"),
        F.col("o_orderdate").alias("changed_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: (id, vector array<double>, label)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )


# Query wording per vector label; some name a genre, some are Vietnamese, some neither.
LABEL_TEXT = [
    "a mecha show", "love story please", "phim kinh dị", "something nice", "funny robot", "tìm phim hài",
    "slice of life", "action and magic", "drama", "none at all",
]
POINT_GENRES = ["Mecha", "Romance", "Horror", "Comedy", "Fantasy", "Drama", "Slice of Life"]


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, vector): every vector asks, in the words of its label."""
    return vectors(spark, sf_dir).select("id", pick(LABEL_TEXT, F.col("label")).alias("text"), "vector")


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, vector_vi, genres, item_score); a quarter has no second vector."""
    i = F.col("id")
    return vectors(spark, sf_dir).select(
        "id",
        "vector",
        F.when(i % 4 != 0, F.reverse("vector")).alias("vector_vi"),
        F.array(pick(POINT_GENRES, i % 7), pick(POINT_GENRES, F.floor(i / 7) % 7)).alias("genres"),
        ((i * 37 % 101) / 10).alias("item_score"),
    )


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, intent, entities, question): one question per supplier, ten kinds in turn, about parts 7i and 11i."""
    s = F.col("s_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    a = part.select(F.col("p_partkey").alias("ka"), F.col("p_name").alias("a"), F.col("p_type").alias("t"))
    b = part.select(F.col("p_partkey").alias("kb"), F.col("p_name").alias("b"))
    rows = table(spark, sf_dir, "supplier").join(a, s * 7 == F.col("ka")).join(b, s * 11 == F.col("kb"))
    field = pick(["score", "studio", "year", "episodes", "season_status"], F.floor(s / 10) % 5)
    word = F.element_at(F.split("a", " "), 1)
    kinds = [
        ("qa_detail", F.concat(F.lit("title="), F.col("a"), F.lit(";field="), field), "how is it"),
        ("search", F.concat(F.lit("title~"), F.substring("a", 2, 6)), "find it"),
        ("compare", F.concat(F.lit("compare=["), F.col("a"), F.lit(", "), F.col("b"), F.lit("]")), "which one"),
        ("recommend", F.concat(F.lit("similar_to="), F.col("a")), "more of this"),
        ("search", F.concat(F.lit("genre="), word), "some of these"),
        ("recommend_multi", F.concat(F.lit("genre="), word, F.lit(";genre="), F.col("t")), "a bit of each"),
        ("search", F.lit("mood"), "stress quá"),
        ("recommend", F.lit("constraint"), "xem 1 lèo"),
        ("recommend", F.lit("similar_to=Zzyzx Quux"), "more"),
        ("qa_detail", F.lit("title=Zzyzx Quux;field=year"), "when"),
    ]
    n = (s % 10 + 1).cast("int")

    def nth(i: int) -> Column:
        return F.element_at(F.array(*[k[i] if isinstance(k[i], Column) else F.lit(k[i]) for k in kinds]), n)

    return rows.select(s.alias("id"), nth(0).alias("intent"), nth(1).alias("entities"), nth(2).alias("question"))
