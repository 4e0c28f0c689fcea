"""Retrieval over a batch of queries: vector search, prefilter, reranking, translation, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfspark.functions import text
from shelfspark.operators import blocks
from shelfspark.runtime import cut_lineage, spread


def vector_search(queries: DataFrame, points: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """(query, item, score, rank): exact cosine top k. Both inputs are (id, vector)."""
    return blocks.score_top(
        blocks.dense(queries, "id", "vector"), blocks.dense(points, "id", "vector"), k, exclude_self=exclude_self
    )


def vector_search_approx(queries: DataFrame, points: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """Approximate twin of :func:`vector_search`: only the nearest clusters of each query are scored, by default as many as a measured recall needs."""
    return blocks.approx_top(queries, points, k, probes=probes)


def rerank_blend(hits: DataFrame, boost: float = 0.02) -> DataFrame:
    """Re-ordered by vector score + boost * item score / 10; ties keep the previous order.

    ``hits``: (query, rank, score, item_score, …); adds ``blend`` and ``new_rank``.
    """
    blend = F.coalesce("score", F.lit(0.0)) + F.lit(boost) * (F.coalesce("item_score", F.lit(0.0)) / 10)
    w = W.partitionBy("query").orderBy(F.round("blend", blocks.DIGITS).desc(), F.asc("rank"))
    return hits.withColumn("blend", blend).withColumn("new_rank", F.row_number().over(w))


def fetch_size(genre: Column, k: int) -> Column:
    """Over-fetch twice k when a genre filter leaves room to rerank: at most 10, but never less than k."""
    return F.when(genre.isNotNull(), max(k, min(2 * k, 10))).otherwise(k)


def hybrid_search(queries: DataFrame, points: DataFrame, k: int = 5, boost: float = 0.02) -> DataFrame:
    """(query, item, genre, score, item_score, blend, rank): genre prefilter (all words of the genre), over-fetch, blend, cut to k.

    ``queries`` (id, text, vector); ``points`` (id, vector, genres array, item_score).
    Queries without a recognised genre search everything.
    """
    asked = queries.withColumn("genre", text.infer_genre(F.col("text")))
    q = blocks.dense(asked, "id", "vector").join(
        asked.select("id", F.col("genre").alias("want"), fetch_size(F.col("genre"), k).alias("fetch")), "id"
    )
    tokens = F.split(F.lower(F.array_join("genres", " ")), r"[^\p{L}\p{N}]+")
    p = blocks.dense(points.withColumn("tokens", tokens), "id", "vector", ["tokens"])
    found = blocks.filtered_top(q, p, max(k, min(2 * k, 10)), "want", limit_col="fetch")
    hits = found.join(points.select(F.col("id").alias("item"), "item_score"), "item")
    ranked = rerank_blend(hits, boost).filter(F.col("new_rank") <= k)
    genres = asked.select(F.col("id").alias("query"), "genre")
    return ranked.join(genres, "query").select(
        "query", "item", "genre", "score", "item_score", "blend", F.col("new_rank").alias("rank")
    )


def bilingual_search(queries: DataFrame, points: DataFrame, k: int = 10) -> DataFrame:
    """Vietnamese queries search ``vector_vi``, others ``vector``; points without a translation are skipped."""
    lang = queries.withColumn("lang", text.detect_language(F.col("text")))
    usable = points.filter(F.col("vector_vi").isNotNull())
    arms = [
        vector_search(lang.filter(F.col("lang") == code), usable.select("id", F.col(col).alias("vector")), k)
        for code, col in (("vi", "vector_vi"), ("en", "vector"))
    ]
    return arms[0].unionByName(arms[1]).join(lang.select(F.col("id").alias("query"), "lang"), "query")


def token_overlap(query: Column, doc: Column) -> Column:
    """Default pair score: share of the query's distinct words found in the document."""
    words = [F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))) for c in (query, doc)]
    size = F.size(words[0])
    return F.when(size > 0, F.size(F.array_intersect(*words)) / size)


def rerank_model(
    pairs: DataFrame, k: int, scorer: Callable | None = None, max_chars: int | None = None
) -> DataFrame:
    """(query, rank, query_text, doc, …) re-ordered by a pair scorer, cut to k.

    ``scorer(queries, docs) -> scores`` runs in Arrow batches; without one the
    word overlap is computed in the JVM. A failing batch scores null, and null
    scores leave the input order as it was. Whole documents are scored unless
    the scorer has a limit of its own (``max_chars``).
    """
    doc = F.col("doc") if max_chars is None else F.substring("doc", 1, max_chars)
    if scorer is None:
        scored = pairs.withColumn("model_score", token_overlap(F.col("query_text"), doc))
    else:
        scored = pairs.withColumn("model_score", _as_series_udf(scorer)(F.col("query_text"), doc))
    w = W.partitionBy("query").orderBy(F.round("model_score", blocks.DIGITS).desc_nulls_last(), F.asc("rank"))
    return scored.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k)


def _as_series_udf(scorer: Callable):
    import pandas as pd

    def run(q, d):
        try:
            return pd.Series([float(x) for x in scorer(q.tolist(), d.tolist())])
        except Exception:  # an unavailable model must not lose the hits
            return pd.Series([None] * len(q), dtype="float64")

    run.__annotations__ = {"q": pd.Series, "d": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def translate(df: DataFrame, col: str, translator: Callable | None, only: Column, out: str) -> DataFrame:
    """Adds ``out``: ``translator(list) -> list`` on each distinct text where ``only`` holds, else the text itself.

    Distinct texts are the cache; a failing batch or an empty answer keeps the original.
    """
    if translator is None:
        return df.withColumn(out, F.col(col))

    def run(batches):
        for pdf in batches:
            texts = pdf["src"].tolist()
            try:
                answers = [a if a else t for a, t in zip(translator(texts), texts)]
            except Exception:  # fail open: untranslated text is still searchable
                answers = texts
            yield pdf.assign(dst=answers)

    # written with its flag: a filter would be tested below a repartition, in the few tasks of the scan
    rows = cut_lineage(df.withColumn("__asked", F.coalesce(only, F.lit(False))), "asked")
    asked, rest = rows.filter("__asked"), rows.filter("not __asked")
    done = asked.select(F.col(col).alias("src")).distinct().mapInPandas(run, "src string, dst string")
    # the other rows have no key to join by, which would put them all into one task
    joined = asked.join(done, F.col(col) == F.col("src"), "left").unionByName(rest.withColumns({c: F.lit(None).cast("string") for c in ("src", "dst")}))
    return joined.withColumn(out, F.coalesce("dst", F.col(col))).drop("src", "dst", "__asked")


def translate_queries(queries: DataFrame, translator: Callable | None = None, col: str = "text") -> DataFrame:
    """Adds ``text_en``; only Vietnamese queries are sent to the translator."""
    return translate(queries, col, translator, text.detect_language(F.col(col)) == "vi", "text_en")


def translate_docs(cat: DataFrame, translator: Callable, doc: str = "doc") -> DataFrame:
    """(mal_id, doc_vi) for rows without a translation; a failed batch gives null, to be retried."""

    def run(batches):
        for pdf in batches:
            try:
                answers = translator(pdf[doc].tolist())
            except Exception:  # retried on the next run
                answers = [None] * len(pdf)
            yield pdf[["mal_id"]].assign(doc_vi=answers)

    todo = cat.filter(F.col("doc_vi").isNull()).select("mal_id", doc)
    return todo.mapInPandas(run, f"mal_id {dict(cat.dtypes)['mal_id']}, doc_vi string").filter("doc_vi <> ''")


def with_document(cat: DataFrame, out: str = "doc", max_tags: int | None = None, max_synopsis: int | None = None) -> DataFrame:
    """Catalog rows with their retrieval document."""
    none = F.lit(None).cast("string")
    tags = F.col("tags_anilist") if "tags_anilist" in cat.columns else F.col("tags")
    digest = F.col("review_digest") if "review_digest" in cat.columns else none
    return cat.withColumn(
        out,
        text.retrieval_document(
            F.col("mal_id"), F.col("title"), F.col("title_japanese"), F.col("synopsis"), F.col("episodes"),
            F.col("status"), F.col("season"), F.col("year"), F.col("studios"), F.col("source"), F.col("genres"),
            F.col("score"), tags, digest, max_tags, max_synopsis,
        ),
    )


def index_incremental(cat: DataFrame, indexed: DataFrame, encoder: Callable | None = None, force: bool = False) -> DataFrame:
    """New points: rows not yet indexed -> document -> vector -> point; ``force`` re-embeds all. A catalog of few files is spread over the cores."""
    from shelfspark.operators.features import text_embed
    from shelfspark.sources.sinks import vector_points

    todo = cat if force else cat.join(indexed.select("mal_id"), "mal_id", "left_anti")
    return vector_points(text_embed(with_document(spread(todo)), "doc", "vector", encoder))


def build_prompts(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, lang, messages): system message with a language pin, user message with numbered blocks.

    ``queries`` (query, text); ``candidates`` (query, rank, title, genres text, synopsis, year, score),
    a short ranked list per query.
    """
    block = text.context_block(
        F.col("rank"), F.col("title"), F.col("genres"), F.col("synopsis"), F.col("year"), F.col("score")
    )
    packed = candidates.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs")
    )
    joined = queries.join(packed, "query", "left").withColumn("lang", text.detect_language(F.col("text")))
    n = F.coalesce(F.size("bs"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    context = F.when(n > 0, F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n")).otherwise(text.NO_CANDIDATES)
    pin = F.when(F.col("lang") == "vi", text.PIN_VI).otherwise(text.PIN_EN)
    system = F.concat(F.lit(text.SYSTEM_PROMPT + " "), pin)
    user = F.concat(
        F.lit("[User Query]\n"), F.col("text"), F.lit("\n\n[Context - Top "), n.cast("string"),
        F.lit(" Retrieved Items]\n"), context,
    )
    message = [
        F.struct(F.lit(role).alias("role"), body.alias("content")) for role, body in (("system", system), ("user", user))
    ]
    return joined.select("query", "lang", F.array(*message).alias("messages"))
