"""Golden questions: reference answers, relevance sets and genre pools by intent.

``golden`` rows are (id, intent, question, entities, category). Each intent is
one set-based plan; the plans are stacked, so a table of questions costs the
same few joins as a single one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfspark.functions import text
from shelfspark.operators import catalog, resolve, retrieval
from shelfspark.runtime import cut_lineage

# Mood word -> genres; the first mood found decides, with its first genre.
MOOD_GENRES = {
    "buồn": ["Drama"],
    "cảm động": ["Drama"],
    "khóc": ["Drama", "Tragedy"],
    "stress": ["Comedy"],
    "hài": ["Comedy"],
    "giải trí": ["Comedy"],
    "động lực": ["Sports", "Slice of Life"],
}
# Wording that asks for something finished.
FINISHED_WORDS = ["hoàn thành", "1 lèo", "cày"]
# Question groups that have a factual answer.
FACTUAL = [
    "Hỏi thông tin chi tiết 1 bộ phim",
    "Tìm theo tên (title search, có lỗi chính tả/viết tắt)",
    "Tìm theo thể loại/tag",
    "So sánh giữa các anime",
    "Gợi ý dựa trên phim đã xem (similar recommendation)",
    "Tìm theo tâm trạng/cảm xúc (mood-based)",
]
FIELDS = ["score", "studio", "year", "episodes", "season_status"]


def _has(c: str, *parts: str) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.col(c).contains(p)
    return hit


def mood_token() -> Column:
    low = F.lower(F.concat(F.col("entities"), F.lit(" "), F.col("question")))
    return F.coalesce(*[F.when(low.contains(m), F.lit(g[0])) for m, g in MOOD_GENRES.items()])


def resolved_titles(golden: DataFrame, cat: DataFrame) -> DataFrame:
    """(id, pos, mal_id): the titles of each question that resolve, in order, pos from 1."""
    asked = golden.select("id", F.posexplode(text.parse_titles(F.col("entities"))).alias("p", "name"))
    found = resolve.resolve_titles(asked, cat)
    joined = asked.join(found, "name")
    # the titles named in one question: a handful
    w = W.partitionBy("id").orderBy("p")
    return joined.select("id", "mal_id", F.row_number().over(w).alias("pos"))


def routed(golden: DataFrame, titles: DataFrame) -> DataFrame:
    """Golden rows with the plan that answers them (``route``) and its genre ``token``."""
    n = titles.groupBy("id").agg(F.count(F.lit(1)).alias("n_titles"))
    g = golden.withColumns(
        {"entities": F.coalesce("entities", F.lit("")), "intent": F.coalesce("intent", F.lit(""))}
    ).join(n, "id", "left").na.fill(0, ["n_titles"])
    named = _has("entities", "title=", "title~")
    clause = F.regexp_extract("entities", text.GENRE_CLAUSE, 1)
    low = F.lower(F.concat(F.col("entities"), F.lit(" "), F.col("question")))
    finished = F.lit(False)
    for wd in FINISHED_WORDS:
        finished = finished | low.contains(wd)
    token = F.coalesce(F.nullif(clause, F.lit("")), mood_token())
    route = (
        F.when(F.col("intent") == "recommend_multi", "multi")
        .when((F.col("intent") == "qa_detail") | _has("entities", "field="), "one")
        .when(F.col("intent").isin("search", "search_fuzzy") & named, "one")
        .when(F.col("intent") == "compare", "two")
        .when(
            (F.col("intent") == "recommend") & (F.col("n_titles") > 0) & _has("entities", "similar_to=", "title=", "title~"),
            "similar",
        )
        .when(F.nullif(clause, F.lit("")).isNotNull(), "genre")
        .when(mood_token().isNotNull(), "genre")
        .when(finished, "finished")
        .otherwise("none")
    )
    return g.withColumns({"route": route, "token": token})


def _routed_once(golden: DataFrame, cat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Titles and routed questions, each written once: every intent's plan reads them."""
    titles = cut_lineage(resolved_titles(golden, cat), "titles")
    return titles, cut_lineage(routed(golden, titles), "routed")


def similar_order() -> list[Column]:
    return [F.col("score").desc(), F.col("members").desc(), F.col("item").asc()]


def _finished(scored: DataFrame, k: int) -> Column:
    """The k best finished items as one array value: a scalar subquery over k rows."""
    done = scored.filter("status = 'Finished Airing'").orderBy(F.desc("score"), F.asc("mal_id")).limit(k)
    ranked = done.withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), F.asc("mal_id"))))
    return ranked.agg(F.collect_list(F.struct("pos", "mal_id"))).scalar()


def relevance_parts(golden: DataFrame, cat: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The relevant items per question without the product of multi-intent questions and their genres' items.

    (id, intent_no, item) of all other questions, (id, intent_no, token) of the multi-intent ones, and (token, item).
    """
    titles, g = _routed_once(golden, cat)
    zero = F.lit(0).alias("intent_no")
    named = g.join(titles, "id").filter(
        ((F.col("route") == "one") & (F.col("pos") == 1)) | ((F.col("route") == "two") & (F.col("pos") <= 2))
    ).select("id", zero, F.col("mal_id").alias("item"))
    scored = cat.withColumns({"score": F.coalesce("score", F.lit(0.0)), "members": F.coalesce("members", F.lit(0))})
    bases = g.filter("route = 'similar'").join(titles.filter("pos = 1"), "id").select("id", "mal_id")
    near = catalog.similar_by_genre(scored, k, similar_order(), base=cat.join(bases.select("mal_id").distinct(), "mal_id", "left_semi"))
    similar = bases.join(near.select("mal_id", "item"), "mal_id").select("id", zero, "item")
    genre = g.filter("route = 'genre'")
    top = catalog.genre_top(cat, genre.select("token").distinct(), k)
    by_genre = genre.join(top.select("token", "mal_id"), "token").select("id", zero, F.col("mal_id").alias("item"))
    finished = g.filter("route = 'finished'").select(
        "id", zero, F.explode(_finished(scored, k)).alias("f")
    ).select("id", "intent_no", F.col("f.mal_id").alias("item"))
    tokens = g.filter("route = 'multi'").select("id", F.posexplode(text.genre_tokens(F.col("entities"))).alias("n", "token"))
    every = catalog.genre_top(cat, tokens.select("token").distinct(), None)
    direct = reduce(DataFrame.unionByName, [named, similar, by_genre, finished]).distinct()
    asked = tokens.select("id", (F.col("n") + 1).alias("intent_no"), "token").distinct()
    return direct, asked, every.select("token", F.col("mal_id").alias("item")).distinct()


def relevance_sets(golden: DataFrame, cat: DataFrame, k: int = 3) -> DataFrame:
    """(id, intent_no, item): the relevant items per question; multi-intent rows have one set per genre."""
    direct, asked, listed = relevance_parts(golden, cat, k)
    multi = asked.join(listed, "token").select("id", "intent_no", "item")
    return direct.unionByName(multi).distinct()


def mixed_lists(direct: DataFrame, asked: DataFrame, listed: DataFrame, others: DataFrame, order: Column, k: int) -> DataFrame:
    """(query, item, rank): the first ``k`` of each question's relevant items and ``others`` (id, item) by (``order``, item).

    Of a genre no more than its own first k can be among them, so only these meet the questions.
    """
    w = W.partitionBy("token").orderBy(order, "item")
    heads = listed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    multi = asked.join(heads, "token").select("id", "item")
    pool = direct.select("id", "item").unionByName(multi).unionByName(others.select("id", "item")).distinct()
    ranked = pool.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(order, "item")))
    return ranked.filter(F.col("rank") <= k).withColumnRenamed("id", "query")


def listed_intents(asked: DataFrame, listed: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query, intent, item): every intent that has items, with those of its items that are on its question's list, or with null."""
    some = asked.join(listed.select("token").distinct(), "token", "left_semi").withColumnsRenamed({"id": "query", "intent_no": "intent"})
    met = some.join(ranked.select("query", "item"), "query").join(listed, ["token", "item"], "left_semi").select("query", "intent", "item")
    return some.select("query", "intent").join(met, ["query", "intent"], "left").select("query", "intent", "item")


def golden_genres(golden: DataFrame, cat: DataFrame) -> DataFrame:
    """(query, genre): genres of the titles a question names, else of its top genre picks."""
    titles, g = _routed_once(golden, cat)
    by_title = F.col("intent").isin("qa_detail", "search", "search_fuzzy", "compare", "recommend") | _has(
        "entities", "field=", "title=", "title~", "similar_to=", "compare="
    )
    direct = (F.col("n_titles") > 0) & by_title
    pool = cat.select("mal_id", F.explode("genres").alias("g")).select("mal_id", F.lower(F.trim("g")).alias("genre"))
    a = g.filter(direct).select("id").join(titles, "id").join(pool, "mal_id").select("id", "genre")
    rest = g.filter(~direct & F.col("token").isNotNull()).select("id", "token")
    picks = catalog.genre_top(cat, rest.select("token").distinct(), 3)
    b = rest.join(picks.select("token", "mal_id"), "token").join(pool, "mal_id").select("id", "genre")
    return a.unionByName(b).distinct().select(F.col("id").alias("query"), "genre")


def _facts() -> Column:
    """Text forms of one catalog row, by name."""
    t = F.col("title")
    shown = {
        c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("score", "year", "episodes", "status", "scored_by")
    }
    season = F.coalesce(F.nullif(F.col("season"), F.lit("")), F.lit("?"))
    votes = F.coalesce(F.col("scored_by").cast("string"), F.lit("?"))
    return F.struct(
        F.concat(t, F.lit(": score "), shown["score"], F.lit("/10 ("), votes, F.lit(" votes)")).alias("score"),
        F.concat(t, F.lit(": studio(s) "), F.array_join("studios", ", ")).alias("studio"),
        F.concat(t, F.lit(": year "), shown["year"], F.lit(" ("), season, F.lit(")")).alias("year"),
        F.concat(t, F.lit(": "), shown["episodes"], F.lit(" episodes")).alias("episodes"),
        F.concat(t, F.lit(": status "), shown["status"]).alias("season_status"),
        F.concat(t, F.lit(" ("), shown["year"], F.lit(", score "), shown["score"], F.lit(")")).alias("short"),
        F.concat(t, F.lit(" ("), shown["year"], F.lit(", "), shown["episodes"], F.lit(" eps, score "), shown["score"], F.lit(")")).alias("full"),
    )


def golden_reference(golden: DataFrame, cat: DataFrame, k: int = 3) -> DataFrame:
    """(id, reference, contexts, needs_review): answer text and documents per question.

    Each question contributes a few rows (its titles or its top picks), joined
    once with the facts and folded in order.
    """
    c = cat if "scored_by" in cat.columns else cat.withColumn("scored_by", F.lit(None).cast("int"))
    facts = retrieval.with_document(c).select(
        "mal_id", "title", "doc", F.array_join("genres", ", ").alias("genre_text"), _facts().alias("f")
    )
    titles, g = _routed_once(golden, cat)
    # a recommendation without a usable base answers by mood or genre only if it names no title
    named = _has("entities", "similar_to=", "title=", "title~")
    g = g.withColumn(
        "route",
        F.when((F.col("intent") == "recommend") & (F.col("n_titles") == 0) & named, "none").when(
            (F.col("intent") == "recommend") & (F.col("n_titles") > 0), "similar"
        ).otherwise(F.col("route")),
    ).withColumn("route", F.when(F.col("route") == "multi", F.when(F.col("token").isNotNull(), "genre").otherwise("none")).otherwise(F.col("route")))
    scored = cat.withColumns({"score": F.coalesce("score", F.lit(0.0)), "members": F.coalesce("members", F.lit(0))})
    r = g.select("id", "route", "token")
    first = r.join(titles, "id").filter(
        (F.col("route").isin("one", "similar") & (F.col("pos") == 1)) | (F.col("route") == "two")
    ).select("id", F.col("pos").cast("int").alias("pos"), "mal_id")
    bases = r.filter("route = 'similar'").join(titles.filter("pos = 1"), "id").select("id", "mal_id")
    near = catalog.similar_by_genre(scored, k, similar_order(), base=cat.join(bases.select("mal_id").distinct(), "mal_id", "left_semi"))
    similar = bases.join(near.select("mal_id", "item", "rank"), "mal_id").select(
        "id", (F.col("rank") + 1).cast("int").alias("pos"), F.col("item").alias("mal_id")
    )
    genre = r.filter("route = 'genre'")
    top = catalog.genre_top(cat, genre.select("token").distinct(), k)
    by_genre = genre.join(top.select("token", "mal_id", "rank"), "token").select("id", F.col("rank").cast("int").alias("pos"), "mal_id")
    finished = r.filter("route = 'finished'").select("id", F.explode(_finished(scored, k)).alias("f")).select(
        "id", F.col("f.pos").cast("int").alias("pos"), F.col("f.mal_id").alias("mal_id")
    )
    rows = reduce(DataFrame.unionByName, [first, similar, by_genre, finished])
    packed = (
        rows.join(facts, "mal_id")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "title", "doc", "genre_text", "f"))).alias("rs"))
    )
    joined = g.join(packed, "id", "left")
    rs = F.coalesce(F.col("rs"), F.array().cast(packed.schema["rs"].dataType))
    n = F.size(rs)
    one, two = F.get(rs, F.lit(0)), F.get(rs, F.lit(1))
    field = F.regexp_extract("entities", "field=([a-z_]+)", 1)
    by_field = F.coalesce(*[F.when(field == name, one["f"][name]) for name in FIELDS], one["f"]["short"])
    listed = F.array_join(F.transform(rs, lambda x: x["title"]), ", ")
    rest = F.array_join(F.transform(F.slice(rs, 2, k), lambda x: x["title"]), ", ")
    detail = (F.col("intent") == "qa_detail") | _has("entities", "field=")
    reference = (
        F.when((F.col("route") == "one") & (n > 0) & detail, by_field)
        .when((F.col("route") == "one") & (n > 0), F.concat(F.lit("Canonical title: "), one["f"]["short"]))
        .when((F.col("route") == "two") & (n >= 2), F.concat(one["f"]["full"], F.lit(" VS "), two["f"]["full"]))
        .when(
            (F.col("route") == "similar") & (n >= 2),
            F.concat(F.lit("Base: "), one["title"], F.lit(" ("), one["genre_text"], F.lit("). Valid same-genre picks from DB: "), rest),
        )
        .when((F.col("route") == "genre") & (n > 0), F.concat(F.lit("Top "), F.col("token"), F.lit(" picks from DB by score: "), listed))
        .when((F.col("route") == "finished") & (n > 0), F.concat(F.lit("Finished-airing picks from DB: "), listed))
        .otherwise("")
    )
    kept = F.when((F.col("route") == "two") & (n >= 2), F.slice(rs, 1, 2)).otherwise(rs)
    return joined.select(
        "id",
        reference.alias("reference"),
        F.transform(kept, lambda x: x["doc"]).alias("contexts"),
        (reference == "").alias("needs_review"),
    )
