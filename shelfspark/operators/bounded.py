"""Exact top k by inner product, with blocks of items left out by their bounds.

Items with equal vectors have equal scores, so they are one *run*: the vector and
the sorted ids, cut into several runs when there are many. Runs are put in order
of their leading dims, then of falling norm, and cut into blocks, so that similar
vectors stand together. Of a block only the largest and smallest weight of each
dim, its largest norm and its smallest id are kept. These give an upper bound for every
query. A query first meets the blocks with the highest bounds, as many as can fill
its list; the k-th of what it finds there is its threshold. Then it meets only those
other blocks whose bound exceeds the threshold, or equals it with a smaller id. What
is left out cannot be in the list, so the result is that of a full scan. With
``FEW_BLOCKS`` or fewer, every query meets all of them at once.

Both the bounds and the scores are computed in cells of a grid (queries by blocks
of bounds, queries of one block by its runs), in numpy inside a task. A block that
many queries want is dealt to several cells by the hash of the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfspark.operators import skew
from shelfspark.operators.blocks import CELL, DIGITS, _dense, _entries, _parallelism, _renewed, block_of, cell_tasks
from shelfspark.runtime import block_count, cut_lineage

#: Items of a run.
RUN = 4096
#: Runs of a block.
BLOCK_RUNS = 512
#: So many blocks are not worth a bound.
FEW_BLOCKS = 4
#: Queries of a cell.
CELL_QUERIES = 2048


def _norm() -> Column:
    return F.sqrt(F.aggregate("weights", F.lit(0.0), lambda t, w: t + w * w))


def units(packed: DataFrame) -> DataFrame:
    """Vectors divided by their norm; a zero vector stays zero."""
    norm = F.greatest(_norm(), F.lit(1e-300))
    return packed.withColumn("__n", norm).withColumn("weights", F.transform("weights", lambda w: w / F.col("__n"))).drop("__n")


def _frame(pd, names, columns):
    """Columns as they are: texts stay plain objects, which Arrow takes in one piece."""
    kept = [list(c) if getattr(c, "dtype", object) == object else c for c in columns]
    return pd.DataFrame({n: pd.Series(c, dtype=object if isinstance(c, list) and c and isinstance(c[0], str) else None) for n, c in zip(names, kept)})


def _first_ids(keyed: DataFrame, need: int, run: int) -> DataFrame:
    """The rows (id, v) with the ``need`` smallest ids of each v, repeated and null ids besides.

    First among those of one hash, so that a frequent vector is not one task's.
    """
    cut = keyed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(block_count(keyed.count(), 64 * run))))
    for by in (["v", "part"], ["v"]):
        w = W.partitionBy(*by).orderBy("id")
        cut = cut.withColumn("place", F.dense_rank().over(w)).filter(F.col("place") <= need + 1)
    return cut.select("id", "v")


def run_blocks(items: DataFrame, block_runs: int = BLOCK_RUNS, run: int = RUN, need: int | None = None) -> DataFrame:
    """(block, first, n, ids, dims, weights, norm): runs of equal vectors, similar ones side by side, in each group by falling norm.

    With ``need`` only the ``need`` smallest ids of equal vectors are kept: those behind them cannot be in a list.
    """
    entries = F.array_sort(F.transform(F.arrays_zip("dims", "weights"), lambda e: F.struct(e["dims"].alias("d"), e["weights"].alias("w"))))
    keyed = items.select("id", entries.alias("v"))
    if need is not None:
        keyed = _first_ids(keyed, need, run)
    parts = keyed.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / run).alias("parts"))
    pieces = keyed.join(parts, "v").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    # about ``run`` ids in each list
    runs = pieces.groupBy("v", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lead = F.transform(F.array_sort(F.transform("v", lambda e: F.struct((-F.abs(e["w"])).alias("w"), e["d"].alias("d")))), lambda e: e["d"])
    runs = runs.select(
        F.col("ids")[0].alias("first"), F.size("ids").cast("long").alias("n"), "ids", F.col("v.d").alias("dims"), F.col("v.w").alias("weights"), lead.alias("lead")
    )
    runs = cut_lineage(runs.withColumn("norm", _norm()), "runs")
    placed = skew.dense_index(runs.select(F.struct("lead", (-F.col("norm")).alias("s"), "first").alias("o")), "o", "place")
    placed = placed.select(F.col("o.first").alias("first"), F.floor(F.col("place") / block_runs).alias("block"))
    return cut_lineage(runs.drop("lead").join(placed, "first"), "blocks")


def block_bounds(blocks: DataFrame) -> DataFrame:
    """(block, n, first, norm, dims, hi, lo): largest and smallest weight of each dim that occurs in the block."""
    whole = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("norm").alias("norm"))
    each = blocks.select("block", F.explode(F.arrays_zip("dims", "weights")).alias("e")).groupBy("block", F.col("e.dims").alias("dim"))
    spans = each.agg(F.max("e.weights").alias("hi"), F.min("e.weights").alias("lo"), F.count(F.lit(1)).alias("c")).join(whole.select("block", "runs"), "block")
    # a run without the dim has 0 there
    some = F.col("c") < F.col("runs")
    spans = spans.select(
        "block", "dim", F.when(some, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"),
        F.when(some, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
    )
    packed = spans.groupBy("block").agg(F.collect_list(F.struct("dim", "hi", "lo")).alias("e"))
    packed = packed.select("block", F.col("e.dim").alias("dims"), F.col("e.hi").alias("hi"), F.col("e.lo").alias("lo"))
    empty = [F.coalesce("dims", F.array().cast("array<bigint>")).alias("dims"), *[F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in ("hi", "lo")]]
    return cut_lineage(whole.join(packed, "block", "left").select("block", "n", "first", "norm", *empty), "bounds")


def _wanted(queries: DataFrame, bounds: DataFrame, dims: int, again: bool, spans: bool) -> DataFrame:
    """(query, block, ub, n): blocks that each query has to meet.

    At first those with the highest bounds that hold ``need`` items; ``again``, those
    that can still beat ``tau``. ``spans`` adds what can hold the smallest score.
    """
    rows = max(16, min(4096, CELL // (4 * max(1, dims))))
    nq = block_count(queries.count(), CELL_QUERIES)
    nq = max(nq, min(_parallelism(queries), block_count(queries.count(), 64)))
    nb = block_count(bounds.count(), rows)
    left = queries.withColumn("c", block_of("id", nq)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    right = bounds.withColumn("r", F.pmod(F.xxhash64("block"), F.lit(nb)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def meet(key, lpdf, rpdf):
        import numpy as np
        import pandas as pd

        names = ["query", "block", "ub", "n"]
        if not len(lpdf) or not len(rpdf):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        rpdf = rpdf.sort_values("first")
        block, count, firsts = rpdf["block"].to_numpy(), rpdf["n"].to_numpy(), rpdf["first"].to_numpy()
        b_at, b_dim, b_hi = _entries(np, rpdf.rename(columns={"hi": "weights"}))
        b_lo = _entries(np, rpdf.rename(columns={"lo": "weights"}))[2]
        q_at, q_dim, q_val = _entries(np, lpdf)
        common = np.intersect1d(b_dim, q_dim)
        high, low = (_dense(np, b_at, b_dim, v, len(rpdf), common).T if len(common) else np.zeros((0, len(rpdf))) for v in (b_hi, b_lo))
        qid, parts = lpdf["id"].to_numpy(), []
        step = max(1, CELL // (len(common) + 4 * len(rpdf)))
        for at in range(0, len(qid), step):
            end = min(len(qid), at + step)
            m = (q_at >= at) & (q_at < end)
            own = (q_at[m] - at, q_dim[m], q_val[m], end - at)
            size = np.sqrt(np.bincount(own[0], own[2] ** 2, end - at))[:, None] * rpdf["norm"].to_numpy()[None, :]
            u = _dense(np, *own, common) if len(common) else np.zeros((end - at, 0))
            up, down = np.maximum(u, 0), np.minimum(u, 0)
            slack = 1e-12 * (1 + size)
            ub = np.round(np.minimum(up @ high + down @ low, size) + slack, DIGITS)
            if again:
                tau, tau_id = lpdf["tau"].to_numpy(dtype=float)[at:end], lpdf["tau_id"].to_numpy()[at:end]
                take = ub > np.where(np.isnan(tau), -np.inf, tau)[:, None]
                q, b = np.nonzero(ub == tau[:, None])
                if len(q):
                    take[q, b] = firsts[b] <= tau_id[q]
            else:
                order = np.argsort(-ub, axis=1, kind="stable")
                before = np.cumsum(count[order], axis=1) - count[order]
                take = np.zeros(ub.shape, bool)
                np.put_along_axis(take, order, before < lpdf["need"].to_numpy()[at:end, None], axis=1)
            if spans:
                lb = np.maximum(up @ low + down @ high, -size) - slack
                take |= lb < lpdf["lo"].to_numpy(dtype=float)[at:end, None] if again else lb == lb.min(axis=1, keepdims=True)
            q, b = np.nonzero(take)
            parts.append((qid[at:end][q], block[b], ub[q, b], count[b]))
        return _frame(pd, names, map(np.concatenate, zip(*parts)))

    n_cells = cell_tasks(nq * nb)
    kind = dict(queries.dtypes)["id"]
    cells = left.repartition(n_cells, "c", "r").groupBy("c", "r").cogroup(_renewed(right).repartition(n_cells, "c", "r").groupBy("c", "r"))
    return cells.applyInPandas(meet, f"query {kind}, block long, ub double, n long")


def _scored(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, exclude: DataFrame | None, k: int, exclude_self: bool, cut: bool) -> DataFrame:
    """(query, items, scores, lo, hi): the best k of each (query, block); with ``cut`` only what comes before the threshold."""
    kind_q, kind_i = dict(queries.dtypes)["id"], dict(blocks.dtypes)["first"]
    spread = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_QUERIES), F.least(F.lit(_parallelism(queries)), F.ceil(F.count(F.lit(1)) / 64)))
    parts = cut_lineage(pairs.groupBy("block").agg(spread.cast("int").alias("parts")), "parts")
    asked = pairs.select("query", "block").join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    vectors = queries.select(F.col("id").alias("query"), "dims", "weights", *([F.col("tau")] if cut else []))
    left = asked.join(vectors, "query")
    if exclude is not None:
        names = exclude.columns
        there = exclude.select(F.col(names[0]).alias("query"), F.col(names[1]).alias("skip")).join(blocks.select(F.explode("ids").alias("skip"), "block"), "skip")
        # one row for each (query, block): a list is never longer than the block
        left = left.join(there.groupBy("query", "block").agg(F.collect_list("skip").alias("hide")), ["query", "block"], "left")
    else:
        left = left.withColumn("hide", F.lit(None).cast(f"array<{kind_i}>"))
    right = blocks.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def score(key, lpdf, rpdf):
        import numpy as np
        import pandas as pd

        names = ["query", "items", "scores", "lo", "hi"]
        if not len(lpdf) or not len(rpdf):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        rpdf = rpdf.sort_values("first")
        qid, ids, many = lpdf["query"].to_numpy(), list(rpdf["ids"]), rpdf["n"].to_numpy()
        r_at, r_dim, r_val = _entries(np, rpdf)
        q_at, q_dim, q_val = _entries(np, lpdf)
        dims = np.unique(r_dim)
        right = _dense(np, r_at, r_dim, r_val, len(ids), dims).T if len(dims) else np.zeros((0, len(ids)))
        hidden = list(lpdf["hide"])
        taus = lpdf["tau"].to_numpy(dtype=float) if cut else np.full(len(qid), np.nan)
        out = []
        step = max(1, CELL // (len(dims) + 4 * len(ids)))
        for at in range(0, len(qid), step):
            end = min(len(qid), at + step)
            m = (q_at >= at) & (q_at < end)
            s = (_dense(np, q_at[m] - at, q_dim[m], q_val[m], end - at, dims) if len(dims) else np.zeros((end - at, 0))) @ right
            ranked = np.round(s, DIGITS)
            order = np.argsort(-ranked, axis=1, kind="stable")
            upto = np.cumsum(many[order], axis=1)
            low, high = s.min(axis=1), s.max(axis=1)
            for n in range(end - at):
                q = qid[at + n]
                gone = hidden[at + n] if hidden[at + n] is not None else ()
                # runs that fill the list, and all that tie with the last of them
                last = min(int(np.searchsorted(upto[n], k + len(gone) + exclude_self)), len(ids) - 1)
                limit = max(ranked[n, order[n, last]], taus[at + n]) if cut and taus[at + n] == taus[at + n] else ranked[n, order[n, last]]
                used = order[n, : int(np.searchsorted(-ranked[n, order[n]], -limit, side="right"))]
                if not len(used):
                    out.append((q, [], [], low[n], high[n]))
                    continue
                who = np.concatenate([ids[r] for r in used])
                of = np.repeat(used, many[used])
                free = ~np.isin(who, gone) if len(gone) else np.ones(len(who), bool)
                if exclude_self:
                    free &= who != q
                who, of = who[free], of[free]
                best = np.lexsort((who, -ranked[n, of]))[:k]
                picked = who[best]
                out.append((q, picked.tolist() if picked.dtype == object else picked, s[n, of[best]], low[n], high[n]))
        return _frame(pd, names, zip(*out))

    n_cells = max(1, min(parts.agg(F.sum("parts")).first()[0] or 1, 4 * _parallelism(queries)))
    cells = left.repartition(n_cells, "block", "part").groupBy("block", "part").cogroup(_renewed(right).repartition(n_cells, "block", "part").groupBy("block", "part"))
    return cells.applyInPandas(score, f"query {kind_q}, items array<{kind_i}>, scores array<double>, lo double, hi double")


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """(query, best, lo, hi): the k best of all parts, in order. The parts are shuffled as two plain arrays; entries are made afterwards."""

    def entries(part: Column) -> Column:
        return F.zip_with(part["items"], part["scores"], lambda i, s: F.struct((-F.round(s, DIGITS)).alias("o"), i.alias("item"), s.alias("score")))

    best = F.slice(F.array_sort(F.flatten(F.transform(F.collect_list(F.struct("items", "scores")), entries))), 1, k)
    return parts.groupBy("query").agg(best.alias("best"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def top(
    queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", exclude: DataFrame | None = None, exclude_self: bool = False,
    spans: bool = False, block_runs: int = BLOCK_RUNS, run: int = RUN, counters: dict | None = None,
) -> DataFrame:
    """(query, item, score, rank): the k best items per query, ties by id.

    ``queries`` and ``items`` are (id, dims, weights). ``exclude`` is (query, item)
    pairs to skip. ``spans`` adds ``lo`` and ``hi``, the query's smallest and largest
    score over all items. ``counters`` receives the number of (query, block) pairs
    there are and of those that were scored.
    """
    if metric == "cosine":
        queries, items = units(queries), units(items)
    asked = queries.select("id", "dims", "weights")
    most = 0
    if exclude is not None:
        exclude = cut_lineage(exclude.distinct(), "exclude")
        most = exclude.groupBy(F.col(exclude.columns[0]).alias("id")).agg(F.count(F.lit(1)).alias("h")).agg(F.max("h")).first()[0] or 0
    # of equal vectors a list holds the smallest ids that its query has not excluded
    blocks = run_blocks(items, block_runs, run, k + int(exclude_self) + most)
    bounds = block_bounds(blocks)
    n_blocks = bounds.count()
    kept = ["lo", "hi"] if spans else []

    def listed(parts: DataFrame) -> DataFrame:
        if n_blocks == 1:  # a list of one block is in order
            rows = parts.select("query", F.posexplode(F.arrays_zip("items", "scores")).alias("p", "b"), *kept)
            return rows.select("query", F.col("b.items").alias("item"), F.col("b.scores").alias("score"), (F.col("p") + 1).alias("rank"), *kept)
        rows = _merged(parts, k).select("query", F.posexplode("best").alias("p", "b"), *kept)
        return rows.select("query", F.col("b.item").alias("item"), F.col("b.score").alias("score"), (F.col("p") + 1).alias("rank"), *kept)

    if n_blocks <= FEW_BLOCKS:
        asked = cut_lineage(asked, "queries")
        every = asked.select(F.col("id").alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_blocks, 1) - 1).cast("long"))).alias("block"))
        if counters is not None:
            counters.update(pairs=asked.count() * n_blocks, scored=asked.count() * n_blocks)
        return listed(_scored(every, asked, blocks, exclude, k, exclude_self, False))

    dims = blocks.agg(F.max(F.array_max("dims"))).first()[0] or 0
    need = F.lit(k + int(exclude_self))
    if exclude is not None:
        n = exclude.groupBy(F.col(exclude.columns[0]).alias("id")).agg(F.count(F.lit(1)).alias("h"))
        asked = asked.join(n, "id", "left").withColumn("need", need + F.coalesce("h", F.lit(0))).drop("h")
    else:
        asked = asked.withColumn("need", need)
    asked = cut_lineage(asked, "queries")
    found = _wanted(asked, bounds, dims, False, spans)
    if not spans:
        # cells saw only some of the bounds: of all, again those that hold enough items
        w = W.partitionBy("query").orderBy(F.desc("ub"), "block").rowsBetween(W.unboundedPreceding, -1)
        found = found.join(asked.select(F.col("id").alias("query"), "need"), "query").withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter("before < need")
    first = cut_lineage(found.select("query", "block"), "first")
    parts = cut_lineage(_scored(first, asked, blocks, exclude, k, exclude_self, False), "scored")
    last = F.try_element_at("best", F.lit(k))
    tau = _merged(parts, k).select(F.col("query").alias("id"), (-last["o"]).alias("tau"), last["item"].alias("tau_id"), "lo")
    asked = cut_lineage(asked.drop("need").join(tau, "id", "left"), "thresholds")
    more = _wanted(asked, bounds, dims, True, spans).select("query", "block").join(first, ["query", "block"], "left_anti")
    more = cut_lineage(more, "more")
    if counters is not None:
        counters.update(pairs=asked.count() * n_blocks, scored=first.count() + more.count())
    if not more.isEmpty():
        parts = parts.unionByName(_scored(more, asked, blocks, exclude, k, exclude_self, True))
    return listed(parts)


def places(queries: DataFrame, items: DataFrame, asked: DataFrame, exclude: DataFrame | None = None, block_runs: int | None = None, run: int = RUN) -> DataFrame:
    """(query, item, rank): which place each asked (query, item) has in the whole list of its query by dot, without the list.

    What comes before a pair is counted by run: a cell of (queries, block of runs) holds the
    scores of its runs and emits one number for each asked pair. ``asked`` holds none of ``exclude``.
    """
    last = items.agg(F.max(F.array_max("dims"))).first()[0] or 0
    blocks = run_blocks(items, block_runs or max(BLOCK_RUNS, min(16_384, CELL // (4 * (int(last) + 1)))), run)
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    # a dim that an item names twice counts once, with its largest weight, as in the runs
    weight = F.array_max(F.transform(F.filter(F.arrays_zip("dims", "weights"), lambda e: e["dims"] == F.col("d")), lambda e: e["weights"]))
    entries = items.select(F.col("id").alias("item"), "dims", "weights", F.explode(F.array_distinct("dims")).alias("d")).select("item", F.col("d").alias("dim"), weight.alias("w"))
    vectors = queries.select(F.col("id").alias("query"), F.map_from_arrays("dims", "weights").alias("m"))
    pairs = asked.select("query", "item").distinct()
    by_dim = pairs.join(entries, "item").join(vectors, "query").select("query", "item", (F.col("w") * F.coalesce(F.try_element_at("m", "dim"), F.lit(0.0))).alias("s"))
    scores = by_dim.groupBy("query", "item").agg(F.sum("s").alias("s"))
    wanted = scores.groupBy("query").agg(F.collect_list(F.struct("item", "s")).alias("a"))
    left = wanted.join(queries.withColumnRenamed("id", "query").select("query", "dims", "weights"), "query").select(
        "query", "dims", "weights", F.col("a.item").alias("items"), F.col("a.s").alias("scores")
    )
    left = cut_lineage(left, "asked")
    parts = max(1, min(block_count(left.count(), 64), 4 * _parallelism(queries)))
    kind_q, kind_i = dict(queries.dtypes)["id"], dict(blocks.dtypes)["first"]
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    if exclude is not None:
        names = exclude.columns
        there = exclude.select(F.col(names[0]).alias("query"), F.col(names[1]).alias("skip")).distinct().join(blocks.select(F.explode("ids").alias("skip"), "block"), "skip")
        # one row for each (query, block): a list is never longer than the block
        left = left.join(there.groupBy("query", "block").agg(F.collect_list("skip").alias("hide")), ["query", "block"], "left")
    else:
        left = left.withColumn("hide", F.lit(None).cast(f"array<{kind_i}>"))
    left = left.withColumn("part", block_of("query", parts))
    right = blocks.select("block", "n", "ids", "dims", "weights").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def count(key, lpdf, rpdf):
        import numpy as np
        import pandas as pd

        names = ["query", "item", "before"]
        if not len(lpdf) or not len(rpdf):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        qid, ids, many = lpdf["query"].to_numpy(), list(rpdf["ids"]), rpdf["n"].to_numpy()
        r_at, r_dim, r_val = _entries(np, rpdf)
        q_at, q_dim, q_val = _entries(np, lpdf)
        dims = np.unique(r_dim)
        right = _dense(np, r_at, r_dim, r_val, len(ids), dims).T if len(dims) else np.zeros((0, len(ids)))
        flat, of = np.concatenate(ids), np.repeat(np.arange(len(ids)), many)
        by_id = np.argsort(flat, kind="stable")
        flat, of = flat[by_id], of[by_id]
        out = []
        step = max(1, CELL // (len(dims) + 4 * len(ids)))
        for at in range(0, len(qid), step):
            end = min(len(qid), at + step)
            m = slice(*np.searchsorted(q_at, [at, end]))
            s = (_dense(np, q_at[m] - at, q_dim[m], q_val[m], end - at, dims) if len(dims) else np.zeros((end - at, 0))) @ right
            ranked = np.round(s, DIGITS)
            order = np.argsort(-ranked, axis=1, kind="stable")
            falling = -np.take_along_axis(ranked, order, 1)
            upto = np.c_[np.zeros(end - at, np.int64), np.cumsum(many[order], axis=1)]
            for n, (own, goal, gone) in enumerate(zip(lpdf["items"][at:end], lpdf["scores"][at:end], lpdf["hide"][at:end])):
                goal = -np.round(np.asarray(goal, float), DIGITS)
                low, high = np.searchsorted(falling[n], goal, "left"), np.searchsorted(falling[n], goal, "right")
                before = upto[n][low]
                for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
                    for r in order[n, a:b]:
                        before[i] += np.searchsorted(ids[r], own[i], "left")
                if gone is not None:
                    gone = np.asarray(gone, dtype=flat.dtype)
                    lost = -ranked[n, of[np.searchsorted(flat, gone)]]
                    before -= ((lost < goal[:, None]) | ((lost == goal[:, None]) & (gone < np.asarray(own, dtype=flat.dtype)[:, None]))).sum(axis=1)
                out.append((np.repeat(qid[at + n], len(own)), own, before))
        return _frame(pd, names, map(np.concatenate, zip(*out)))

    n_cells = cell_tasks(parts * n_blocks)
    cells = left.repartition(n_cells, "block", "part").groupBy("block", "part").cogroup(_renewed(right).repartition(n_cells, "block", "part").groupBy("block", "part"))
    counts = cells.applyInPandas(count, f"query {kind_q}, item {kind_i}, before long")
    return counts.groupBy("query", "item").agg((F.sum("before") + 1).alias("rank"))
