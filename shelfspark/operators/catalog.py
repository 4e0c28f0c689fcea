"""Catalog operators: payload flattening, search, lists, crawl bookkeeping, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfspark import schemas
from shelfspark.functions import text, values
from shelfspark.runtime import block_count, cut_lineage

#: Rows that a task of ``similar_by_genre`` sorts.
TASK_ROWS = 100_000
MINI = ["mal_id", "title", "title_japanese", "image_url", "score", "year"]
DETAIL = (
    "mal_id title title_japanese synopsis episodes status season year studios source genres tags score image_url"
).split()


def _names(arr: Column) -> Column:
    return F.filter(F.transform(F.coalesce(arr, F.array().cast(schemas.NAMED)), lambda x: x["name"]), lambda n: n.isNotNull())


def parse_payload(raw: DataFrame) -> DataFrame:
    return raw.withColumn("p", F.from_json("payload", schemas.PAYLOAD))


def mal_metrics(p: str = "p") -> list[Column]:
    """Source-namespaced score and rank columns of a parsed payload."""
    return [
        values.try_double(F.col(f"{p}.score")).alias("score_mal"),
        values.try_int(F.col(f"{p}.scored_by")).alias("scored_by_mal"),
        values.try_int(F.col(f"{p}.rank")).alias("rank_mal"),
        values.try_int(F.col(f"{p}.popularity")).alias("popularity_mal"),
    ]


def _title() -> Column:
    return F.coalesce("p.title", F.concat(F.lit(text.DEFAULT_TITLE), F.col("mal_id").cast("string")))


def flatten_payload(raw: DataFrame) -> DataFrame:
    """Raw JSON rows to typed 20-column catalog rows. One projection, no shuffle."""
    kinds = [F.col(f"p.{k}") for k in ("genres", "themes", "demographics", "explicit_genres")]
    genres = F.array_sort(F.array_distinct(F.concat(*[_names(k) for k in kinds])))
    return parse_payload(raw).select(
        "mal_id",
        _title().alias("title"),
        "p.title_japanese",
        "p.synopsis",
        values.try_int(F.col("p.episodes")).alias("episodes"),
        "p.status",
        "p.season",
        values.try_int(F.col("p.year")).alias("year"),
        _names(F.col("p.studios")).alias("studios"),
        F.col("p.source").alias("source"),
        genres.alias("genres"),
        F.coalesce("p.tags", F.array().cast(schemas.TAGS)).alias("tags"),
        values.try_double(F.col("p.score")).alias("score"),
        F.coalesce(
            "p.images.jpg.large_image_url", "p.images.jpg.image_url", "p.images.webp.large_image_url"
        ).alias("image_url"),
        F.array(F.coalesce(F.col("source"), F.lit("tenrai"))).alias("sources"),
        *mal_metrics(),
    )


def flatten_payload_basic(raw: DataFrame) -> DataFrame:
    """The smaller mapping: plain genres, no webp image, tags from a second source (empty here)."""

    def kept(c: str) -> Column:
        return F.filter(_names(F.col(c)), lambda n: n != "")

    return parse_payload(raw).select(
        "mal_id",
        F.coalesce(
            F.nullif(F.col("p.title"), F.lit("")), F.concat(F.lit(text.DEFAULT_TITLE), F.col("mal_id").cast("string"))
        ).alias("title"),
        "p.title_japanese",
        "p.synopsis",
        values.try_int(F.col("p.episodes")).alias("episodes"),
        "p.status",
        "p.season",
        values.try_int(F.col("p.year")).alias("year"),
        kept("p.studios").alias("studios"),
        F.col("p.source").alias("source"),
        kept("p.genres").alias("genres"),
        F.array().cast(schemas.TAGS).alias("tags"),
        values.try_double(F.col("p.score")).alias("score"),
        F.coalesce(
            F.nullif(F.col("p.images.jpg.large_image_url"), F.lit("")), F.col("p.images.jpg.image_url")
        ).alias("image_url"),
    )


def media_to_row(media: DataFrame, max_description: int | None = None) -> DataFrame:
    """Second-source media rows to the columns they update; rows without an id are dropped."""
    tags = F.transform(
        F.filter(F.coalesce("tags", F.array().cast("array<struct<name:string,rank:int>>")), lambda t: t["name"].isNotNull() & (t["name"] != "")),
        lambda t: F.struct(t["name"].alias("name"), F.coalesce(t["rank"], F.lit(0)).alias("weight")),
    )
    score = F.coalesce(F.col("averageScore"), F.lit(0)) / 10
    return media.filter(F.col("idMal").isNotNull()).select(
        F.col("idMal").alias("mal_id"),
        tags.alias("tags_anilist"),
        F.nullif(score, F.lit(0.0)).alias("score_anilist"),
        F.col("favourites").alias("favourites_anilist"),
        F.col("popularity").alias("popularity_anilist"),
        text.strip_html(F.col("description"), max_description).alias("description_anilist"),
    )


def since(df: DataFrame, ts_col: str, last_run) -> DataFrame:
    """Rows newer than the watermark. A literal bound, so the scan can prune on it."""
    return df.filter(F.col(ts_col) > F.lit(last_run).cast("timestamp_ntz"))


def fresh(raw: DataFrame, now) -> DataFrame:
    """Ids whose payload has not expired at ``now``."""
    return raw.filter(F.col("expires_at") > F.lit(now).cast("timestamp_ntz")).select("mal_id")


def not_enriched(cat: DataFrame, source: str = "anilist") -> DataFrame:
    return cat.filter(~F.array_contains("sources", source))


def untranslated(cat: DataFrame) -> DataFrame:
    return cat.filter(F.col("doc_vi").isNull())


def mini(cat: DataFrame) -> DataFrame:
    return cat.select(*MINI)


def detail(cat: DataFrame, mal_id: int) -> DataFrame:
    return cat.filter(F.col("mal_id") == mal_id).select(*DETAIL)


def by_score(id_col: str = "mal_id") -> list[Column]:
    return [F.col("score").desc_nulls_last(), F.col(id_col).asc()]


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def search(
    cat: DataFrame, q: str = "", genre: str | None = None, year: int | None = None, season: str | None = None,
    status: str | None = None, limit: int = 20,
) -> DataFrame:
    """Title substring and optional exact filters; best score first, 50 rows at most."""
    hit = F.lit(True) if not q else F.col("title").ilike(f"%{q}%")
    for name, value in (("year", year), ("season", season), ("status", status)):
        if value is not None:
            hit = hit & (F.col(name) == value)
    if genre is not None:
        hit = hit & F.array_contains("genres", genre)
    return mini(cat.filter(hit)).orderBy(*by_score()).limit(clamp(limit, 0, 50))


def trending(cat: DataFrame, limit: int = 20) -> DataFrame:
    return mini(cat).orderBy(*by_score()).limit(clamp(limit, 0, 50))


def popular(cat: DataFrame) -> DataFrame:
    """All items with their place in (score or 0) descending, id descending order."""
    key = F.coalesce("score", F.lit(0.0))
    return cat.select("mal_id", key.alias("score")).orderBy(F.desc("score"), F.desc("mal_id"))


def genre_filter(points: DataFrame, genre: str | None, col: str = "genres") -> DataFrame:
    """Full-text match on the joined genre text: every token of ``genre`` must be present."""
    if not genre:
        return points
    tokens = F.split(F.lower(F.col(col)), "[^\\p{L}\\p{N}]+")
    hit = F.lit(True)
    for t in genre.lower().replace("-", " ").split():
        hit = hit & F.array_contains(tokens, t)
    return points.filter(hit)


def finished_top(cat: DataFrame, n: int = 3) -> DataFrame:
    done = cat.filter(F.col("status") == "Finished Airing").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return done.orderBy(F.desc("score"), F.asc("mal_id")).limit(n)


_WORDED = "\u0001isekai wording"


# Synopsis wording that marks the genre 'isekai'.
ISEKAI_WORDING = ["isekai", "another world", "reincarnat"]


def _worded(syn: Column) -> Column:
    hit = F.lit(False)
    for wording in ISEKAI_WORDING:
        hit = hit | syn.contains(wording)
    return hit


def genre_top(cat: DataFrame, tokens: DataFrame, n: int | None = 3, token_col: str = "token") -> DataFrame:
    """Per token the best ``n`` matching items by (score, members); null counts as 0; None = all.

    A token matches an item when it is part of one of its genre names. Tokens match distinct genre names first (a small vocabulary), then the
    exploded items by equality: no item is compared with every token.
    """
    pools = cat.select("mal_id", F.explode("genres").alias("g")).withColumn("g", text.normalize(F.col("g"))).distinct()
    names = pools.select("g").distinct()
    wanted = tokens.select(text.normalize(F.col(token_col)).alias("t"), token_col).distinct()
    # substring match through shared character grams, see resolve.substring_pairs
    from shelfspark.operators.resolve import substring_pairs

    pairs = substring_pairs(wanted.select("t").distinct(), "t", names, "g")
    # the one genre with a wording fallback: items with the wording carry a marker genre
    syn = text.normalize(F.col("synopsis"))
    worded = cat.filter(_worded(syn)).select("mal_id", F.lit(_WORDED).alias("g"))
    marked = wanted.filter(F.col("t") == "isekai").select("t", F.lit(_WORDED).alias("g")).distinct()
    hits = wanted.join(pairs.unionByName(marked), "t").join(pools.unionByName(worded), "g").select(token_col, "mal_id").distinct()
    scored = hits.join(
        cat.select("mal_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("members", F.lit(0)).alias("members")),
        "mal_id",
    )
    if n is None:
        return scored
    w = W.partitionBy(token_col).orderBy(F.desc("score"), F.desc("members"), F.asc("mal_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def genre_counts(cat: DataFrame) -> DataFrame:
    return cat.select(F.explode("genres").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("count"))


def genre_item_counts(cat: DataFrame) -> DataFrame:
    """Items per genre; a genre listed twice on an item counts once."""
    return (
        cat.select(F.explode(F.array_distinct("genres")).alias("genre"))
        .groupBy("genre")
        .agg(F.count(F.lit(1)).alias("n_items"))
    )


def genre_combos(cat: DataFrame) -> DataFrame:
    """Sorted distinct genre sets of two or three genres."""
    combo = F.array_sort(F.array_distinct("genres"))
    return cat.select("mal_id", combo.alias("combo")).filter(F.size("combo").between(2, 3))


def catalog_stats(cat: DataFrame) -> DataFrame:
    return cat.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("score_mal").alias("with_score_mal"),
        F.sum(F.col("image_url").isNull().cast("long")).alias("missing_images"),
    )


def backfill_from_raw(cat: DataFrame, raw: DataFrame) -> DataFrame:
    """Overwrite the four MAL columns on matched ids, also with null; others keep theirs."""
    r = (
        parse_payload(raw.filter(F.col("source").isin("jikan", "tenrai")))
        .select("mal_id", *[c.alias(f"_{n}") for c, n in zip(mal_metrics(), _MAL)])
        .withColumn("_hit", F.lit(True))
    )
    joined = cat.join(r, "mal_id", "left")
    cols = [
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in _MAL else F.col(c) for c in cat.columns
    ]
    return joined.select(*cols)


_MAL = ["score_mal", "scored_by_mal", "rank_mal", "popularity_mal"]
_ANILIST = ["tags_anilist", "score_anilist", "favourites_anilist", "popularity_anilist", "description_anilist"]


def union_sources(old: Column, new: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<string>")), new))


def enrich(cat: DataFrame, rows: DataFrame, source: str = "anilist") -> DataFrame:
    """Second-source columns overwritten on matched ids; ``sources`` gains the source name."""
    r = rows.select("mal_id", *[F.col(c).alias(f"_{c}") for c in _ANILIST], F.lit(True).alias("_hit"))
    joined = cat.join(r, "mal_id", "left")
    out = []
    for c in cat.columns:
        if c in _ANILIST:
            out.append(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "sources":
            gained = union_sources(F.col(c), F.array(F.lit(source)))
            out.append(F.when(F.col("_hit"), gained).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def merge_sources(first: DataFrame, second: DataFrame, key: str = "mal_id") -> DataFrame:
    """Full outer join of two sources; the first one wins column by column."""
    a = first.select(key, *[F.col(c).alias(f"a_{c}") for c in first.columns if c != key], F.lit(True).alias("in_first"))
    b = second.select(key, *[F.col(c).alias(f"b_{c}") for c in second.columns if c != key], F.lit(True).alias("in_second"))
    out = [F.col(key)]
    for c in dict.fromkeys([*first.columns, *second.columns]):
        if c == key:
            continue
        sides = [F.col(f"{p}_{c}") for p, d in (("a", first), ("b", second)) if c in d.columns]
        out.append(F.coalesce(*sides).alias(c))
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in ("in_first", "in_second")]
    return a.join(b, key, "full_outer").select(*out, *flags)


def crawl_todo(ids: DataFrame, done: DataFrame, fresh_ids: DataFrame, key: str = "mal_id") -> DataFrame:
    """Ids neither done nor fresh."""
    return ids.join(done.select(key), key, "left_anti").join(fresh_ids.select(key), key, "left_anti")


def similar_by_genre(
    cat: DataFrame, k: int = 10, order: list[Column] | None = None, base: DataFrame | None = None
) -> DataFrame:
    """For every item the best ``k`` others sharing a genre.

    No pair of items is formed: an item's answer lies inside the union of the
    best k+1 items of each of its genres, so each genre is cut to k+1 rows
    first (a map-side top-k) and joined back by genre. Items are dealt by id, so
    that a task sorts about ``TASK_ROWS`` of them for this cut, however few files they come from.
    """
    order = order or [F.col("score").desc_nulls_last(), F.col("item").asc()]
    distinct = F.array_distinct("genres").alias("genres")
    item = cat.select(F.col("mal_id").alias("item"), "score", *[c for c in ("members",) if c in cat.columns], distinct)
    item = cut_lineage(item, "items")
    rows = item.agg(F.sum(F.size("genres"))).first()[0] or 0
    item = item.repartition(max(cat.sparkSession.sparkContext.defaultParallelism, block_count(rows, TASK_ROWS)), "item")
    exploded = item.withColumn("genre", F.explode("genres")).drop("genres")
    heads = exploded.withColumn("_r", F.row_number().over(W.partitionBy("genre").orderBy(*order))).filter(
        F.col("_r") <= k + 1
    )
    asked = item.select(F.col("item").alias("mal_id"), "genres") if base is None else base.select("mal_id", distinct)
    asked = asked.select("mal_id", F.explode("genres").alias("genre"))
    cands = asked.join(heads.drop("_r"), "genre").filter(F.col("mal_id") != F.col("item")).drop("genre").distinct()
    w = W.partitionBy("mal_id").orderBy(*order)
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def discover_ids(pages: DataFrame, limit: int | None = None, season_limit: int | None = None) -> DataFrame:
    """(arm, pos, id) pages to first-seen order; arm 0 takes its first ``limit`` ids, the others ``season_limit`` each (None: all)."""
    kept = pages.filter(F.col("id").isNotNull())
    firsts = kept.groupBy("arm", "id").agg(F.min("pos").alias("pos"))

    def first(rows: DataFrame, most: int | None) -> DataFrame:
        if most is None:
            return rows
        # a literal bound lets Spark cut each partition before the shuffle
        ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("arm").orderBy("pos", "id")))
        return ranked.filter(F.col("n") <= most).drop("n")

    capped = first(firsts.filter("arm = 0"), limit).unionByName(first(firsts.filter("arm <> 0"), season_limit))
    return first_seen(capped, "id", ["arm", "pos"])


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: its smallest place in (order)."""
    return df.groupBy(key).agg(F.min(F.struct(*order)).alias("_s")).select(key, "_s.*")
