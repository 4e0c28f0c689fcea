"""Batch recommenders: popularity, neighbour-based, content, hybrid, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from shelfspark.functions import values
from shelfspark.operators import blocks, bounded, skew
from shelfspark.runtime import block_count, cut_lineage


def popularity(cat: DataFrame, log: bool = True) -> DataFrame:
    """(item_id, pop): members, min-max scaled after log1p."""
    x = F.log1p(F.col("members").cast("double")) if log else F.col("members").cast("double")
    raw = cat.select(F.col("mal_id").alias("item_id"), x.alias("x"))
    # one row, read as a scalar subquery
    span = raw.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    return raw.withColumn("s", span).select("item_id", values.min_max(F.col("x"), F.col("s.lo"), F.col("s.hi")).alias("pop"))


def popularity_order(pop: DataFrame, score: str = "pop") -> DataFrame:
    """(item_id, place): place 1 is the most popular, ties by id. Written once: every list reads it."""
    keyed = pop.select(F.struct((-F.col(score)).alias("s"), "item_id").alias("o"))
    placed = skew.dense_index(keyed, "o", "place")  # an item occurs once, so its key carries its id
    return cut_lineage(placed.select("o.item_id", (F.col("place") + 1).alias("place")), "places")


def popular_unseen(users: DataFrame, seen: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, place, rank): each user's k most popular unseen items.

    A user with h seen items finds them among places 1..k+h, so no item behind
    place k + the largest h counts for anyone. Of the others a user has seen u:
    only places 1..k+u are generated, k rows per user plus one per such item.
    """
    most = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("h")).agg(F.max("h")).first()[0] or 0
    near = order.filter(F.col("place") <= k + most)
    # read twice; small where users have seen little of what is popular
    used = cut_lineage(seen.select("user_id", "item_id").join(near, "item_id").select("user_id", "place"), "used-places")
    n_used = used.groupBy("user_id").agg(F.count(F.lit(1)).alias("u"))
    places = (
        users.select("user_id")
        .distinct()
        .join(n_used, "user_id", "left")
        .select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k) + F.coalesce("u", F.lit(0)))).alias("place"))
    )
    free = places.join(used, ["user_id", "place"], "left_anti")
    w = W.partitionBy("user_id").orderBy("place")
    top = free.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(near, "place").select("user_id", "item_id", "place", "rank")


def exclude_seen(scored: DataFrame, seen: DataFrame) -> DataFrame:
    return scored.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def user_cf_predict(ratings: DataFrame, requests: DataFrame, k: int = 10, value: str = "score") -> DataFrame:
    """Requested (user, item) with the prediction of the k most similar raters; null when there is none."""
    preds = blocks.neighbour_predictions(ratings, "user_id", "item_id", value, k, requests)
    return requests.join(preds, ["user_id", "item_id"], "left")


def item_cf_predict(ratings: DataFrame, requests: DataFrame, k: int = 10, value: str = "score") -> DataFrame:
    """As above over the user's own most similar items; a rated item returns its rating."""
    preds = blocks.neighbour_predictions(ratings, "item_id", "user_id", value, k, requests)
    own = ratings.select("user_id", "item_id", F.col(value).cast("double").alias("own"))
    return (
        requests.join(preds, ["user_id", "item_id"], "left")
        .join(own, ["user_id", "item_id"], "left")
        .withColumn("pred", F.coalesce("own", "pred"))
        .drop("own")
    )


def user_cf_recommend(ratings: DataFrame, n: int = 10, k: int = 10, value: str = "score") -> DataFrame:
    return blocks.neighbour_top(ratings, "user_id", "item_id", value, n, k, "row")


def item_cf_recommend(ratings: DataFrame, n: int = 10, k: int = 10, value: str = "score") -> DataFrame:
    return blocks.neighbour_top(ratings, "item_id", "user_id", value, n, k, "col")


def _packed(entries: DataFrame, row: str, dims: DataFrame) -> DataFrame:
    """(row, dim, weight) entries to packed vectors through a dense index of dims, written once."""
    return cut_lineage(blocks.pack(entries.join(dims, "dim"), row, "idx", "weight"), "packed")


def _neighbours(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query, item, score, rank): the k best other items. Equal vectors ask once, for k + 1, and each leaves itself out."""
    key = F.array_sort(F.transform(F.arrays_zip("dims", "weights"), lambda e: F.struct(e["dims"].alias("d"), e["weights"].alias("w"))))
    asked = queries.select("id", key.alias("v"))
    kinds = cut_lineage(asked.groupBy("v").agg(F.min("id").alias("kind")), "kinds")
    found = bounded.top(kinds.select(F.col("kind").alias("id"), F.col("v.d").alias("dims"), F.col("v.w").alias("weights")), items, k + 1)
    lists = found.groupBy(F.col("query").alias("kind")).agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("best"))
    each = asked.join(kinds, "v").select("id", "kind").join(lists, "kind")
    others = F.slice(F.filter("best", lambda b: b["item"] != F.col("id")), 1, k)
    rows = each.select(F.col("id").alias("query"), F.posexplode(others).alias("p", "b"))
    return rows.select("query", F.col("b.item").alias("item"), F.col("b.score").alias("score"), (F.col("p") + 1).alias("rank"))


def content_similar(entries: DataFrame, k: int = 10, reviews: DataFrame | None = None) -> DataFrame:
    """(query, item, score, rank): k most similar items per item, itself excluded.

    ``reviews`` (mal_id, dim, weight): items that have reviews are compared by
    them, among reviewed items; all others by their features.
    """
    dims = skew.dense_index(entries, "dim")
    packed = _packed(entries, "mal_id", dims)
    if reviews is None:
        return _neighbours(packed, packed, k)
    review_vecs = _packed(reviews, "mal_id", skew.dense_index(reviews, "dim"))
    plain = packed.join(review_vecs.select("id"), "id", "left_anti")
    by_review = blocks.score_top(review_vecs, review_vecs, k, exclude_self=True)
    return by_review.unionByName(_neighbours(plain, packed, k))


#: Consumed items that one task of the profiles reads.
PROFILE_ROWS = 500_000


def _dealt(seen: DataFrame, entries: DataFrame, parts: int) -> DataFrame:
    """The entries of the consumed items, dealt by item for the join and by user behind it."""
    met = seen.repartition(parts, "mal_id").join(entries.repartition(parts, "mal_id"), "mal_id")
    return met.select("user_id", "dim", "weight").repartition(parts, "user_id")


def user_profile(seen: DataFrame, entries: DataFrame) -> DataFrame:
    """(user_id, dim, weight): mean of the consumed items' vectors; absent dims are 0."""
    seen = cut_lineage(seen.select("user_id", F.col("item_id").alias("mal_id")), "history")
    parts = block_count(seen.count(), PROFILE_ROWS)
    n = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_hist"))
    sums = seen.join(entries, "mal_id")
    if parts > 1:  # as many tasks as the rows need, so that none grows with them
        n, sums = n.repartition(parts, "user_id"), _dealt(seen, entries, parts)
    sums = sums.groupBy("user_id", "dim").agg(F.sum("weight").alias("w"))
    return sums.join(n, "user_id").select("user_id", "dim", (F.col("w") / F.col("n_hist")).alias("weight"))


def _user_scores(seen, entries, k, metric, spans=False, whole=False, counters=None):
    """Top k unseen items per user by the profile; ``whole`` lists are ranked by a full scan."""
    dims = skew.dense_index(entries, "dim")
    users = _packed(user_profile(seen, entries), "user_id", dims)
    items = _packed(entries, "mal_id", dims)
    skip = seen.select("user_id", "item_id")
    if whole:
        found = blocks.score_top(users, items, k, metric, exclude=skip, bounds=spans)
    else:
        found = bounded.top(users, items, k, metric, skip, spans=spans, counters=counters)
    return found.withColumnsRenamed({"query": "user_id", "item": "item_id"})


def candidates(
    users: DataFrame, seen: DataFrame, entries: DataFrame, n: int = 200, order: DataFrame | None = None, counters: dict | None = None
) -> DataFrame:
    """(user_id, item_id, rank): top n unseen items by cosine with the profile; cold users by popularity.

    Items without overlap score 0 and still fill the list, in id order. ``counters`` as in ``bounded.top``.
    """
    warm = _user_scores(seen, entries, n, "cosine", counters=counters).select("user_id", "item_id", "rank")
    if order is None:
        return warm
    cold = users.select("user_id").join(seen.select("user_id"), "user_id", "left_anti")
    return warm.unionByName(popular_unseen(cold, seen, order, n).select("user_id", "item_id", "rank"))


def content_arm(seen: DataFrame, entries: DataFrame, k: int, whole: bool = False) -> DataFrame:
    """(user_id, item_id, score, rank): dot with the profile, min-max scaled over all items of the user.

    ``whole``: k is about the number of items, so that no block can be left out.
    """
    found = _user_scores(seen, entries, k, "dot", spans=True, whole=whole)
    return found.withColumn("score", values.min_max(F.col("score"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def cf_arm(clicks: DataFrame, k: int, users: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score, rank): similarity-weighted click counts over all neighbours; popularity if there are none."""
    counts = clicks.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    found = blocks.neighbour_top(counts, "user_id", "item_id", "n", k, None).withColumnRenamed("pred", "score")
    if users is None or order is None:
        return found
    cold = users.select("user_id").join(found.select("user_id"), "user_id", "left_anti")
    fill = popular_unseen(cold, counts, order, k).withColumn("score", F.lit(None).cast("double"))
    return found.select("user_id", "item_id", "score", "rank").unionByName(
        fill.select("user_id", "item_id", "score", "rank")
    )


def content_places(seen: DataFrame, entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(user_id, item_id, rank): the ranks that ``content_arm`` gives the asked, unseen (user_id, item_id), without its lists."""
    dims = skew.dense_index(entries, "dim")
    users, items = _packed(user_profile(seen, entries), "user_id", dims), _packed(entries, "mal_id", dims)
    pairs = asked.select(F.col("user_id").alias("query"), F.col("item_id").alias("item"))
    found = bounded.places(users, items, pairs, seen.select("user_id", "item_id"))
    return found.withColumnsRenamed({"query": "user_id", "item": "item_id"})


def hybrid_heads(k: int, alpha: float = 0.7) -> tuple[int, int]:
    """How much of the content ranking and of the CF ranking can hold an item of the ``k`` best of ``hybrid_switch``.

    The first k of the content ranking score alpha / k or more. An item behind the first 2k of it
    reaches that only by a place among the first of the CF ranking. Items that the content ranking
    lacks need the first k of the CF ranking.
    """
    content, cf = 2 * k, k
    while alpha / (content + 1) + (1 - alpha) / (cf + 1) > alpha / k - 1e-6:
        cf += 1
    return content, cf


def hybrid_switch(
    content: DataFrame, cf: DataFrame, seen: DataFrame, k: int, alpha: float = 0.7, switch_at: int = 5
) -> DataFrame:
    """Content alone below ``switch_at`` seen items, else alpha/rank + (1 - alpha)/rank of the two full rankings.

    Of these it needs the rows that ``hybrid_heads`` names, with their ranks in both.
    """
    n = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("h"))
    both = content.select("user_id", "item_id", F.col("rank").alias("rc")).join(
        cf.select("user_id", "item_id", F.col("rank").alias("rf")), ["user_id", "item_id"], "full_outer"
    )
    scale = 1.0 + 1e-9
    content_part = F.coalesce(F.lit(1.0) / F.col("rc"), F.lit(0.0)) / scale
    cf_part = F.coalesce(F.lit(1.0) / F.col("rf"), F.lit(0.0)) / scale
    few = F.coalesce("h", F.lit(0)) < switch_at
    score = F.when(few, content_part).otherwise(F.lit(alpha) * content_part + F.lit(1 - alpha) * cf_part)
    scored = both.join(n, "user_id", "left").withColumn("score", score).filter(~few | F.col("rc").isNotNull())
    w = W.partitionBy("user_id").orderBy(F.round("score", blocks.DIGITS).desc(), F.asc("item_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("user_id", "item_id", "score", "rank")


def next_prime(n: int) -> int:
    p = max(2, n)
    while any(p % d == 0 for d in range(2, int(p**0.5) + 1)):
        p += 1
    return p


def explore_slots(slates: DataFrame, seen: DataFrame, items: DataFrame, k: int, e: int = 2, seed: int = 7) -> DataFrame:
    """Last ``e`` slots of each slate replaced by items neither seen nor on the slate.

    The draw walks a permutation of the item numbers, (a * j + b) mod prime with
    a and b from user and seed. The first e + |seen| + |slate| + gap steps hold e
    free items, so only those are generated.
    """
    slates = cut_lineage(slates, "slates")
    numbered = cut_lineage(skew.dense_index(items, "item_id", "no"), "numbered")
    n = numbered.count()
    p = next_prime(n)
    used = slates.select("user_id", "item_id").unionByName(seen.select("user_id", "item_id")).distinct()
    users = slates.groupBy("user_id").agg(F.count(F.lit(1)).alias("slate"))
    h = used.groupBy("user_id").agg(F.count(F.lit(1)).alias("h"))
    # ids are reduced before they are multiplied: no overflow; text ids by their hash
    whole = dict(users.dtypes)["user_id"] in ("tinyint", "smallint", "int", "bigint")
    user = F.col("user_id").cast("long") if whole else F.xxhash64("user_id")
    a = F.lit(1) + F.pmod(F.pmod(user, F.lit(max(1, p - 1))) * 48271 + seed, F.lit(max(1, p - 1)))
    b = F.pmod(F.pmod(user, F.lit(p)) * 69621 + seed * 7, F.lit(p))
    steps = F.least(F.col("h") + e + (p - n), F.lit(p)) - 1
    walk = (
        users.join(h, "user_id")
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
        .withColumn("no", (a * F.col("j") + b) % p)
        .join(numbered, "no")
        .join(used, ["user_id", "item_id"], "left_anti")
    )
    w = W.partitionBy("user_id").orderBy("j")
    extra = walk.withColumn("x", F.row_number().over(w)).filter(F.col("x") <= e).select("user_id", "item_id", "x")
    extra = cut_lineage(extra, "extra")
    n_extra = extra.groupBy("user_id").agg(F.count(F.lit(1)).alias("ne"))
    kept = (
        slates.join(n_extra, "user_id", "left")
        .filter(F.col("rank") <= F.lit(k) - F.coalesce("ne", F.lit(0)))
        .select("user_id", "item_id", F.col("rank").cast("int").alias("rank"), F.lit(False).alias("explored"))
    )
    placed = extra.join(n_extra, "user_id").select(
        "user_id", "item_id", (F.lit(k) - F.col("ne") + F.col("x")).cast("int").alias("rank"), F.lit(True).alias("explored")
    )
    return kept.unionByName(placed)


def concat_arms(arms: list[DataFrame], k: int) -> DataFrame:
    """Ranked arms (user_id, item_id, rank) one after another, first occurrence kept, cut to k."""
    stacked = reduce(
        DataFrame.unionByName,
        [a.select("user_id", "item_id", F.lit(i).alias("arm"), F.col("rank").cast("int").alias("pos")) for i, a in enumerate(arms)],
    )
    firsts = stacked.groupBy("user_id", "item_id").agg(F.min(F.struct("arm", "pos")).alias("s"))
    w = W.partitionBy("user_id").orderBy("s.arm", "s.pos", "item_id")
    ranked = firsts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("user_id", "item_id", F.col("s.arm").alias("arm"), "rank")


def for_you(
    users: DataFrame, user_cf: DataFrame, item_cf: DataFrame, similar: DataFrame, popular: DataFrame, k: int = 10
) -> DataFrame:
    """User-CF, item-CF, items similar to the first pick, popularity; cold users get popularity only.

    ``similar``: (query, item, rank); ``popular``: (item_id, place).
    """
    first = (
        concat_arms([user_cf, item_cf], 1).select("user_id", F.col("item_id").alias("query"))
    )
    content = first.join(similar, "query").select("user_id", F.col("item").alias("item_id"), "rank")
    # k places, the same for everyone
    top = popular.filter(F.col("place") <= k).select("item_id", F.col("place").alias("rank"))
    slots = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")))
    fill = users.select("user_id").distinct().withColumn("rank", slots).join(F.broadcast(top), "rank")
    return concat_arms([user_cf, item_cf, content, fill.select("user_id", "item_id", "rank")], k)


def with_fallback(users: DataFrame, recs: DataFrame, popular: DataFrame, k: int = 10) -> DataFrame:
    """Each user's own list, or the popular list where it is empty."""
    own = recs.filter(F.col("rank") <= k).select("user_id", "item_id", "rank").withColumn("fallback", F.lit(False))
    cold = users.select("user_id").distinct().join(own.select("user_id"), "user_id", "left_anti")
    top = popular.filter(F.col("place") <= k).select("item_id", F.col("place").alias("rank"))
    slots = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")))
    fill = cold.withColumn("rank", slots).join(F.broadcast(top), "rank")
    return own.unionByName(
        fill.select("user_id", "item_id", F.col("rank").cast("int").alias("rank")).withColumn("fallback", F.lit(True))
    )


def als_model(ratings: DataFrame, value: str = "score", rank: int = 16, iterations: int = 8, implicit: bool = False, seed: int = 7):
    """Matrix factorisation on dense integer ids; returns (model, users, items)."""
    from pyspark.ml.recommendation import ALS

    from shelfspark.runtime import work_dir

    work_dir(ratings.sparkSession)  # ALS cuts its own lineage in the checkpoint folder
    users = skew.dense_index(ratings, "user_id", "u")
    items = skew.dense_index(ratings, "item_id", "i")
    rows = ratings.join(users, "user_id").join(items, "item_id").select(
        F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), F.col(value).cast("float").alias("r")
    )
    als = ALS(
        rank=rank, maxIter=iterations, userCol="u", itemCol="i", ratingCol="r", seed=seed, implicitPrefs=implicit,
        coldStartStrategy="drop", checkpointInterval=1,  # each iteration removes the shuffle files of the one before
    )
    return als.fit(rows), users, items


def als_recommend(ratings: DataFrame, n: int = 10, value: str = "score", **params) -> DataFrame:
    """(user_id, item_id, pred, rank) from the factor model, seen items skipped.

    Factors are short dense vectors, so the ranking is the same blocked top-k
    as for any vectors; seen pairs are skipped inside the cells.
    """
    ratings = cut_lineage(ratings.select("user_id", "item_id", value), "ratings")  # read by the indexes, the fit and the cells
    model, users, items = als_model(ratings, value, **params)
    uf = model.userFactors.join(users, model.userFactors["id"] == users["u"]).select("user_id", "features")
    itf = model.itemFactors.join(items, model.itemFactors["id"] == items["i"]).select("item_id", "features")
    found = blocks.score_top(
        blocks.dense(uf, "user_id", "features"), blocks.dense(itf, "item_id", "features"), n, "dot",
        exclude=ratings.select("user_id", "item_id"), plain=True,
    )
    return found.withColumnsRenamed({"query": "user_id", "item": "item_id", "score": "pred"})


def blend_reasons(cf: DataFrame, content: DataFrame, k: int, w_cf: float = 0.6, w_content: float = 0.4) -> DataFrame:
    """Weighted blend of two scored lists with the dominant reason."""
    joined = cf.select("user_id", "item_id", F.col("score").alias("a")).join(
        content.select("user_id", "item_id", F.col("score").alias("b")), ["user_id", "item_id"], "full_outer"
    )
    a = F.lit(w_cf) * F.coalesce("a", F.lit(0.0))
    b = F.lit(w_content) * F.coalesce("b", F.lit(0.0))
    scored = joined.withColumn("score", a + b).withColumn(
        "reason", F.when(a >= b, "similar users").otherwise("similar content")
    )
    w = W.partitionBy("user_id").orderBy(F.round("score", blocks.DIGITS).desc(), F.asc("item_id"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "user_id", "item_id", "score", "reason", "rank"
    )


def batch_predict(ratings: DataFrame, requests: DataFrame, value: str = "score") -> DataFrame:
    """(user_id, item_id, k, model) requests; model 'user' or 'item'.

    One grid pass per model with the largest k asked of it; each request cuts
    its own k from the list of neighbours.
    """
    parts = []
    for model, row, col in (("user", "user_id", "item_id"), ("item", "item_id", "user_id")):
        asked = requests.filter(F.col("model") == model)
        most = asked.agg(F.max("k")).first()[0]
        if most is None:
            continue
        near = blocks.neighbour_lists(ratings, row, col, value, most, asked.select("user_id", "item_id").distinct())
        cut = F.slice("b", 1, F.col("k").cast("int"))
        size = F.aggregate(cut, F.lit(0.0), lambda t, c: t + F.abs(c["s"]))
        total = F.aggregate(cut, F.lit(0.0), lambda t, c: t + c["s"] * c["v"])
        both = asked.join(near, ["user_id", "item_id"], "left").withColumn("pred", F.when(size > 0, total / size))
        if model == "item":
            own = ratings.select("user_id", "item_id", F.col(value).cast("double").alias("own"))
            both = both.join(own, ["user_id", "item_id"], "left").withColumn("pred", F.coalesce("own", "pred")).drop("own")
        parts.append(both.drop("b"))
    other = requests.filter(~F.coalesce(F.col("model").isin("user", "item"), F.lit(False))).withColumn("pred", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, parts, other)


def ground_truth_top(tastes: DataFrame, entries: DataFrame, m: int = 50) -> DataFrame:
    """(user_id, item_id, score, rank): top m items by dot with a taste (user_id, dim, weight), seen or not."""
    dims = skew.dense_index(entries, "dim")
    found = bounded.top(_packed(tastes, "user_id", dims), _packed(entries, "mal_id", dims), m, "dot")
    return found.withColumnsRenamed({"query": "user_id", "item": "item_id"})

