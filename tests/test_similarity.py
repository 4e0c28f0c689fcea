"""Grid operators against brute force, with blocks small enough to use many cells."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfspark.operators import blocks, recommend, retrieval


@pytest.fixture(scope="module")
def ratings(spark):
    rnd = random.Random(5)
    data = [(u, i, rnd.randint(1, 10)) for u in range(40) for i in range(25) if rnd.random() < 0.3 or i == 0]
    data += [(99, i, 5) for i in range(25)]  # a user with everything, item 0 rated by everyone
    return spark.createDataFrame(data, "user_id bigint, item_id bigint, score int"), data


def dense(data):
    us = sorted({u for u, _, _ in data})
    it = sorted({i for _, i, _ in data})
    m = np.zeros((len(us), len(it)))
    for u, i, s in data:
        m[us.index(u), it.index(i)] = s
    n = np.linalg.norm(m, axis=1)
    return us, it, m, (m @ m.T) / np.outer(n, n)


@pytest.mark.parametrize("dims", [1000, 6])
def test_pairs(ratings, dims):
    df, data = ratings
    us, _, _, sims = dense(data)
    got = {(r.a, r.b): r.sim for r in blocks.cosine_pairs(df, "user_id", "item_id", "score", 7, dims).collect()}
    want = {(us[a], us[b]): sims[a, b] for a in range(len(us)) for b in range(a + 1, len(us)) if sims[a, b] > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs_leave_the_task_in_pieces(ratings, monkeypatch):
    """a cell does not hold its pairs; the result is that of whole cells, also for rows sent in several pieces."""
    df, data = ratings
    us, _, _, sims = dense(data)
    monkeypatch.setattr(blocks, "PAIRS_OUT", 3)
    monkeypatch.setattr(blocks, "PIECE", 4)
    found = blocks.cosine_pairs(df, "user_id", "item_id", "score", 9)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapCoGroups" not in plan
    got = [((r.a, r.b), r.sim) for r in found.collect()]
    want = {(us[a], us[b]): sims[a, b] for a in range(len(us)) for b in range(a + 1, len(us)) if sims[a, b] > 0}
    assert len(got) == len(want) and all(abs(v - want[k]) < 1e-9 for k, v in got)


def brute(data, k, transpose=False):
    if transpose:
        data = [(i, u, s) for u, i, s in data]
    us, it, m, sims = dense(data)
    out = {}
    for a in range(len(us)):
        for c in range(len(it)):
            raters = [b for b in range(len(us)) if m[b, c] > 0]
            top = sorted(raters, key=lambda b: (-round(sims[a, b], 9), us[b]))[:k]
            den = sum(sims[a, b] for b in top)
            if den > 0:
                out[(us[a], it[c])] = (sum(sims[a, b] * m[b, c] for b in top) / den, m[a, c] > 0)
    return out


@pytest.mark.parametrize("raters", [1000, 9])
def test_user_predictions(ratings, raters):
    df, data = ratings
    want = {k: v for k, (v, rated) in brute(data, 4).items() if not rated}
    got = {
        (r.user_id, r.item_id): r.pred
        for r in blocks.neighbour_predictions(df, "user_id", "item_id", "score", 4, None, 8, raters).collect()
    }
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("raters", [1000, 9])
def test_requests_only(spark, ratings, raters):
    df, data = ratings
    want = brute(data, 3)
    asked = [(u, i) for u in (0, 3, 99, 777) for i in (0, 4, 24, 555)]
    req = spark.createDataFrame(asked, "user_id bigint, item_id bigint")
    got = {
        (r.user_id, r.item_id): r.pred
        for r in blocks.neighbour_predictions(df, "user_id", "item_id", "score", 3, req, 8, raters).collect()
    }
    assert got.keys() == {a for a in asked if a in want}
    assert all(abs(got[a] - want[a][0]) < 1e-9 for a in got)
    full = recommend.user_cf_predict(df, req, 3)
    assert full.count() == 16 and full.filter("pred is null and user_id = 777").count() == 4


@pytest.mark.parametrize("raters", [1000, 7])
@pytest.mark.parametrize("per", ["row", "col"])
def test_top(ratings, raters, per):
    df, data = ratings
    row, col = ("user_id", "item_id") if per == "row" else ("item_id", "user_id")
    found = blocks.neighbour_top(df, row, col, "score", 3, 4, per, 8, raters)
    want = {}
    for (a, c), (v, rated) in brute(data, 4, per == "col").items():
        if not rated:
            user, item = (a, c) if per == "row" else (c, a)
            want.setdefault(user, []).append((-round(v, 9), item))
    got = {}
    for r in found.collect():
        got.setdefault(r.user_id, {})[r["rank"]] = r.item_id
    assert {u: [g[n] for n in sorted(g)] for u, g in got.items()} == {u: [i for _, i in sorted(w)[:3]] for u, w in want.items()}


@pytest.mark.parametrize("raters", [1000, 9])
def test_sum_over_all_neighbours(ratings, raters):
    df, data = ratings
    us, it, m, sims = dense(data)
    s = (sims - np.diag(np.diag(sims))) @ m
    want = {(us[a], it[c]): s[a, c] for a in range(len(us)) for c in range(len(it)) if m[a, c] == 0 and s[a, c] > 0}
    got = {
        (r.user_id, r.item_id): r.pred
        for r in blocks.neighbour_predictions(df, "user_id", "item_id", "score", None, None, 8, raters).collect()
    }
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


@pytest.mark.parametrize("block", [1000, 6])
def test_score_top(spark, block):
    rnd = np.random.default_rng(2)
    q, p = rnd.normal(size=(9, 5)).round(1), rnd.normal(size=(23, 5)).round(1)
    big = 2**60  # ids beyond double precision
    qs = spark.createDataFrame([(big + i, [float(x) for x in v]) for i, v in enumerate(q)], "id bigint, vector array<double>")
    ps = spark.createDataFrame([(big + i, [float(x) for x in v]) for i, v in enumerate(p)], "id bigint, vector array<double>")
    skip = spark.createDataFrame([(big, big + 3), (big + 2, big + 5)], "a bigint, b bigint")
    for metric in ("cosine", "dot"):
        found = blocks.score_top(
            blocks.dense(qs, "id", "vector"), blocks.dense(ps, "id", "vector"), 4, metric, skip, True, bounds=True, query_block=4, item_block=block
        )
        s = q @ p.T
        lo, hi = s.min(axis=1), s.max(axis=1)
        if metric == "cosine":
            s = s / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(p, axis=1))
            lo, hi = s.min(axis=1), s.max(axis=1)
        got = {}
        for r in found.collect():
            got.setdefault(r.query - big, {})[r["rank"]] = r.item - big
            assert abs(r.lo - lo[r.query - big]) < 1e-9 and abs(r.hi - hi[r.query - big]) < 1e-9
        for i in range(9):
            gone = {i} | ({3} if i == 0 else set()) | ({5} if i == 2 else set())
            want = sorted((j for j in range(23) if j not in gone), key=lambda j: (-round(s[i, j], 9), j))[:4]
            assert [got[i][n] for n in (1, 2, 3, 4)] == want


def test_text_ids(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 1.0), ("c", "y", 1.0)], "r string, d string, v double")
    assert rows(blocks.cosine_pairs(df, "r", "d", "v", 1), "a", "b") == [("a", "b"), ("b", "c")]


def test_reference_example(spark):
    ratings = spark.createDataFrame([(1, 10, 1.0), (2, 10, 1.0), (2, 20, 1.0)], "user_id int, item_id int, rating double")
    assert rows(recommend.user_cf_recommend(ratings, value="rating").filter("user_id = 1"), "item_id") == [(20,)]
    assert rows(recommend.item_cf_recommend(ratings, value="rating").filter("user_id = 1"), "item_id") == [(20,)]


def test_no_seen_item_is_recommended(ratings):
    df, _ = ratings
    for recs in (recommend.user_cf_recommend(df, 20), recommend.item_cf_recommend(df, 20)):
        assert recs.join(df, ["user_id", "item_id"], "left_semi").count() == 0


def test_popular_unseen_reads_only_places_that_count(spark, monkeypatch):
    """what users have seen behind the first places is left out before places are generated; lists stay the same."""
    rnd = random.Random(3)
    log = [(u, rnd.randint(1, 60)) for u in range(30) for _ in range(4)] + [(7, 2), (7, 2), (7, 2), (None, 3), (8, None)]
    seen = spark.createDataFrame(log, "user_id bigint, item_id bigint")
    order = spark.createDataFrame([(i, i) for i in range(1, 61)], "item_id bigint, place bigint")
    users = spark.createDataFrame([(u,) for u in [*range(33), None, 1]], "user_id bigint")
    most = max(sum(a == u for a, _ in log) for u in [*range(30), None])
    want = []
    for u in [*range(33), None]:
        free = [i for i in range(1, 61) if u is None or (u, i) not in log][:5]
        want += [(u, i, r) for r, i in enumerate(free, 1)]
    kept = []
    monkeypatch.setattr(recommend, "cut_lineage", lambda df, name="cut": kept.append(df) or df)
    got = recommend.popular_unseen(users, seen, order, 5)
    assert rows(got, "user_id", "item_id", "rank") == sorted(want, key=repr)
    assert kept[0].count() == sum(i is not None and i <= 5 + most for _, i in log) < 100


def test_popular_unseen_and_cold(spark):
    order = spark.createDataFrame([(i, i) for i in range(1, 9)], "item_id bigint, place bigint")
    seen = spark.createDataFrame([(1, 1), (1, 3), (1, 8)], "user_id bigint, item_id bigint")
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    got = recommend.popular_unseen(users, seen, order, 3)
    assert rows(got, "user_id", "rank", "item_id") == [(1, 1, 2), (1, 2, 4), (1, 3, 5), (2, 1, 1), (2, 2, 2), (2, 3, 3)]


def test_candidates_pad_and_exclude(spark):
    vecs = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", 1.0), (4, "c", 1.0)], "mal_id bigint, dim string, weight double")
    seen = spark.createDataFrame([(7, 1)], "user_id bigint, item_id bigint")
    users = spark.createDataFrame([(7,), (8,)], "user_id bigint")
    order = spark.createDataFrame([(4, 1), (3, 2), (2, 3), (1, 4)], "item_id bigint, place bigint")
    got = rows(recommend.candidates(users, seen, vecs, 3, order), "user_id", "rank", "item_id")
    assert got == [(7, 1, 2), (7, 2, 3), (7, 3, 4), (8, 1, 4), (8, 2, 3), (8, 3, 2)]


def test_concat_keeps_first(spark):
    kind = "user_id int, item_id int, rank int"
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], kind)
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2), (2, 9, 1)], kind)
    got = recommend.concat_arms([a, b], 3)
    assert rows(got, "user_id", "rank", "item_id", "arm") == [(1, 1, 5, 0), (1, 2, 6, 0), (1, 3, 7, 1), (2, 1, 9, 1)]


def test_hybrid_switch_small_history(spark):
    kind = "user_id int, item_id int, rank int"
    content = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2)], kind)
    cf = spark.createDataFrame([(1, 2, 1), (2, 2, 1)], kind)
    seen = spark.createDataFrame([(2, i) for i in range(10, 16)], "user_id int, item_id int")
    got = recommend.hybrid_switch(content, cf, seen, 2, alpha=0.3)
    assert rows(got, "user_id", "rank", "item_id") == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]


def test_hybrid_heads_hold_the_best():
    """Whatever the ranks are, an item outside both heads is behind the k best."""
    rng = random.Random(5)
    for k, alpha in ((1, 0.7), (10, 0.7), (10, 0.2), (25, 0.95)):
        content, cf = recommend.hybrid_heads(k, alpha)
        n = 4 * content + cf
        for _ in range(20):
            places = list(range(1, n + 1))
            rng.shuffle(places)
            score = [alpha / (c + 1) + (1 - alpha) / f for c, f in enumerate(places)]
            best = sorted(range(n), key=lambda c: (-score[c], c))[:k]
            assert all(c < content or places[c] <= cf for c in best)


def test_explore_keeps_slate_size(spark):
    slates = spark.createDataFrame([(u, i, i) for u in (1, 2) for i in range(1, 6)], "user_id bigint, item_id bigint, rank int")
    seen = spark.createDataFrame([(1, i) for i in range(6, 18)], "user_id bigint, item_id bigint")
    items = spark.range(1, 21).withColumnRenamed("id", "item_id")
    got = recommend.explore_slots(slates, seen, items, 5, 2)
    assert rows(got.groupBy("user_id").agg(F.count("*"), F.countDistinct("item_id"))) == [(1, 5, 5), (2, 5, 5)]
    assert got.filter("explored").join(seen, ["user_id", "item_id"], "left_semi").count() == 0
    assert {r["rank"] for r in got.filter("explored").collect()} == {4, 5}


def test_als_excludes_seen(ratings):
    df, _ = ratings
    recs = recommend.als_recommend(df, 3, rank=4, iterations=3)
    assert recs.groupBy("user_id").count().filter("count > 3").count() == 0
    assert recs.join(df, ["user_id", "item_id"], "left_semi").count() == 0


def test_batch_predict_takes_any_number_of_settings(spark):
    import random

    from shelfspark.operators import recommend as rec

    rng = random.Random(4)
    data = [(u, i, float(rng.randrange(1, 11))) for u in range(30) for i in rng.sample(range(25), 9)]
    ratings = spark.createDataFrame(data, "user_id long, item_id long, score double")
    asked = [(u, i, k, m) for k in range(1, 12) for m in ("user", "item") for u, i in ((1, 2), (3, 4), (99, 1))]
    req = spark.createDataFrame(asked, "user_id long, item_id long, k int, model string")
    got = {(r.user_id, r.item_id, r.k, r.model): r.pred for r in rec.batch_predict(ratings, req).collect()}
    assert len(got) == len(asked) and len({(k, m) for _, _, k, m in asked}) == 22
    for k in (1, 4, 11):
        for model, run in (("user", rec.user_cf_predict), ("item", rec.item_cf_predict)):
            one = req.filter((F.col("k") == k) & (F.col("model") == model)).select("user_id", "item_id")
            for r in run(ratings, one, k).collect():
                want = got[r.user_id, r.item_id, k, model]
                assert (want is None) == (r.pred is None) and (want is None or abs(want - r.pred) < 1e-9)


def test_explore_slots_take_large_and_text_ids(spark):
    from shelfspark.operators import recommend as rec

    items = spark.range(40).withColumnRenamed("id", "item_id")
    for user, kind in ((9_000_000_000_000_000_000, "long"), (-5, "long"), ("someone", "string")):
        slates = spark.createDataFrame([(user, i, i + 1) for i in range(5)], f"user_id {kind}, item_id long, rank int")
        seen = spark.createDataFrame([(user, 7)], f"user_id {kind}, item_id long")
        got = rec.explore_slots(slates, seen, items, 5, 2).collect()
        assert sorted(r.rank for r in got) == [1, 2, 3, 4, 5] and sum(r.explored for r in got) == 2
        assert len({r.item_id for r in got}) == 5 and not {r.item_id for r in got if r.explored} & {0, 1, 2, 3, 4, 7}


def test_cf_recommendations_equal_sql(spark):
    import duckdb

    from shelfspark import queries
    from shelfspark.queries import recommend as rq

    queries.load()
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in rq.TOP_SQL.items():
        cur = con.execute(sql)
        columns = [c[0] for c in cur.description]
        got = queries.QUERIES[name](spark, d).select(*columns).collect()
        assert sorted(tuple(r) for r in got) == sorted(cur.fetchall())


@pytest.mark.parametrize("block", [4, 1000])
def test_filtered_top(spark, block):
    """Only items with all words of the filter, against brute force; a filter nobody has finds nothing."""
    rnd = random.Random(11)
    names = ["slice", "life", "mecha", "drama", "of"]
    items = [(i, [rnd.gauss(0, 1) for _ in range(5)], rnd.sample(names, rnd.randrange(0, 4))) for i in range(120)]
    filters = [None, "Mecha", "slice of Life", "drama", "none such", "life"]
    asked = [(q, [rnd.gauss(0, 1) for _ in range(5)], filters[q % 6], 3 + q % 2) for q in range(40)]
    df_i = blocks.dense(spark.createDataFrame(items, "id long, vector array<double>, tokens array<string>"), "id", "vector", ["tokens"])
    df_q = blocks.dense(spark.createDataFrame(asked, "id long, vector array<double>, want string, most int"), "id", "vector", ["want", "most"])
    found = blocks.filtered_top(df_q, df_i, 4, "want", limit_col="most", query_block=block, item_block=block)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query, r.rank)):
        got.setdefault(r.query, []).append(r.item)
    for q, v, want, most in asked:
        words = set((want or "").lower().split())
        some = [(i, float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x))) for i, x, t in items if words <= set(t)]
        assert got.get(q, []) == [i for i, _ in sorted(some, key=lambda s: (-round(s[1], 9), s[0]))[:most]]


def test_products_come_in_bounded_chunks():
    rng = np.random.default_rng(3)
    m = np.where(rng.random((40, 30)) < 0.3, rng.integers(-5, 6, (40, 30)), 0).astype(float)
    at, dim = np.nonzero(m)
    for every in (False, True):
        got, chunks = np.zeros((40, 40)), 0
        for i, j, d in blocks._products(np, at, dim, m[at, dim], 40, at, dim, m[at, dim], 40, every, 100):
            got[i, j] = d
            chunks += 1
            assert len(i) <= 100 + 40 * 30
        assert chunks > 10 and np.allclose(got, m @ m.T)


@pytest.mark.parametrize("raters", [1000, 5])
def test_signed_ratings(spark, raters):
    rng = np.random.default_rng(11)
    m = np.where(rng.random((25, 12)) < 0.5, rng.integers(1, 6, (25, 12)) * rng.choice([-1, 1], (25, 12)), 0).astype(float)
    u, i = np.nonzero(m)
    df = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(u, i)], "u int, i int, v double")
    norm = np.linalg.norm(m, axis=1)
    sims = m @ m.T / np.outer(norm, norm)
    got = {(r.u, r.i): r.pred for r in blocks.neighbour_predictions(df, "u", "i", "v", 3, None, 8, raters).collect()}
    want = {}
    for a, b in zip(*np.nonzero(m == 0)):
        near = sorted(np.flatnonzero(m[:, b]), key=lambda r: (-round(sims[r, a], 9), r))[:3]
        size = sum(abs(sims[r, a]) for r in near)
        if size > 0:
            want[(a, b)] = sum(sims[r, a] * m[r, b] for r in near) / size
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_equal_items_ask_once(spark, monkeypatch):
    """24 items with 6 different vectors: 6 queries, and the lists of a full scan."""
    entries = spark.createDataFrame([(i, d, float(1 + i % 3)) for i in range(24) for d in ("a", "b")[: 1 + i % 2] + (f"c{i % 6}",)], "mal_id int, dim string, weight double")
    asked, whole = [], recommend.bounded.top
    monkeypatch.setattr(recommend.bounded, "top", lambda q, *a, **kw: asked.append(q.count()) or whole(q, *a, **kw))
    found = rows(recommend.content_similar(entries, 4), "query", "item", "rank")
    packed = recommend._packed(entries, "mal_id", recommend.skew.dense_index(entries, "dim"))
    assert found == rows(blocks.score_top(packed, packed, 4, exclude_self=True), "query", "item", "rank")
    assert asked == [6]


def test_sums_over_all_neighbours_without_neighbours(spark, monkeypatch):
    rnd = random.Random(3)
    data = [(u, i, rnd.randint(1, 4)) for u in range(300) for i in rnd.sample(range(30), 4)]
    us, it, m, sims = dense(data)
    np.fill_diagonal(sims, 0)
    sums = sims @ m
    want = []
    for a, u in enumerate(us):
        free = [c for c in range(len(it)) if m[a, c] == 0 and sums[a, c] > 0]
        want += [(u, it[c], p + 1) for p, c in enumerate(sorted(free, key=lambda c: (-round(sums[a, c], 9), it[c]))[:5])]
    df = spark.createDataFrame(data, "user_id bigint, item_id bigint, n int")
    # 300 users are 45,000 pairs, 30 items at most 870: pairs of users are not formed
    monkeypatch.setattr(blocks, "_predict", None)
    assert rows(blocks.neighbour_top(df, "user_id", "item_id", "n", 5, None), "user_id", "item_id", "rank") == sorted(want, key=repr)
    found = blocks._sums_by_columns(blocks.unit_entries(df, "user_id", "item_id", "n"), "user_id", "item_id", 5, block_entries=200)
    found = {(r.user_id, r.item_id): r.pred for r in found.collect()}
    assert all(abs(found[u, i] - sums[us.index(u), it.index(i)]) < 1e-9 for u, i, _ in want)


def test_top_of_rows():
    rng = np.random.default_rng(1)
    for n in (1, 9, 90, 700):
        for s in (rng.normal(size=(6, n)), rng.integers(0, 4, (6, n)) / 3 + rng.normal(size=(6, n)) * 4e-10, rng.normal(size=(6, n)) * 1e7):
            s[rng.random(s.shape) < 0.1] = -np.inf
            lims = rng.integers(0, 15, 6)
            got = sorted((int(r), int(c), int(p)) for found in blocks._top_of_rows(np, s, lims) for r, c, p in zip(*found))
            want = []
            for r in range(6):
                best = sorted(np.flatnonzero(s[r] > -np.inf), key=lambda c: (-np.round(s[r, c], blocks.DIGITS), c))[: lims[r]]
                want += [(r, int(c), p + 1) for p, c in enumerate(best)]
            assert got == sorted(want)


def test_top_of_rows_screened_in_32_bits():
    """F20-F22: scores of 32 bits only pick what is scored in 64 bits: few pairs, and the same places, also where 32 bits cannot tell scores apart."""
    rng = np.random.default_rng(2)
    for n, closeness in ((5, 1.0), (300, 1.0), (3000, 1.0), (3000, 1e-7), (3000, 0.0)):
        left, right = rng.normal(size=(20, 16)), rng.normal(size=16) * (closeness < 1) + closeness * rng.normal(size=(n, 16))
        left[3], right[1], right[2] = 0, 0, right[0]
        left, right = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (left, right))
        right[4] = np.nan if n == 300 else right[4]
        whole, lims, scored = left @ right.T, rng.integers(0, 15, 20), []
        whole[5, :3] = -np.inf
        short = (left.astype(np.float32) @ right.astype(np.float32).T)
        short[5, :3] = -np.inf

        def exact(rows, columns):
            scored.append(len(rows))
            return blocks._exact_scores(np, left, np.ascontiguousarray(right).T, rows, columns)

        found = blocks._top_of_rows(np, short, lims, 2 * 24 * 2.0**-24, exact, lambda r: whole[r])
        got = [(int(r), int(c), int(p)) for part in found for r, c, p in zip(*part)]
        want = [(int(r), int(c), int(p)) for part in blocks._top_of_rows(np, whole, lims) for r, c, p in zip(*part)]
        assert sorted(got) == sorted(want)
        assert closeness < 1 or n != 3000 or sum(scored) < 20 * 15 + n + 20  # the zero row ties with all


def test_vector_search_tells_apart_what_32_bits_do_not(spark):
    points = [(i, [1.0, (i * 7 % 400) * 1e-6, 0.5]) for i in range(400)] + [(900, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(points, "id long, vector array<double>")
    unit = np.array([v for _, v in points])
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    ids = np.array([i for i, _ in points])
    want = []
    for at, q in enumerate(ids):
        score = np.round(unit @ unit[at], blocks.DIGITS)
        best = sorted((c for c in range(len(ids)) if c != at), key=lambda c: (-score[c], ids[c]))[:10]
        want += [(int(q), int(ids[c]), p + 1) for p, c in enumerate(best)]
    assert rows(retrieval.vector_search(df, df, 10, exclude_self=True), "query", "item", "rank") == sorted(want, key=repr)


def test_only_raters_that_count_are_sent(spark):
    """A rater goes to the target blocks that share a dim with it and ask for one of its columns, long rows in pieces to all."""
    e = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 2), (4, 8), (4, 3), (5, 9)], "row long, dim long").withColumns({"value": F.lit(1.0), "norm": F.lit(1.0)})
    ask = spark.createDataFrame([(1, 3), (1, 9)], "row long, dim long")
    marked = blocks._with_blocks(e, e.filter("row = 1"), ask, 7, False)
    assert rows(blocks._row_pieces(marked, 1, True), "row") == [(2,)]
    assert rows(blocks._row_pieces(marked, 3, True).select("row").distinct()) == [(1,), (2,), (3,), (4,), (5,)]
    packed = blocks._row_pieces(e, 1).collect()
    assert sorted((r["row"], sorted(r["dims"]), len(r["values"])) for r in packed) == [(1, [1, 2], 2), (2, [1, 3], 2), (3, [2], 1), (4, [3, 8], 2), (5, [9], 1)]


def test_profiles_of_many_tasks(spark, monkeypatch):
    seen = spark.createDataFrame([(u, i) for u in range(6) for i in range(u, 20, 3)], "user_id long, item_id long")
    entries = spark.createDataFrame([(i, f"d{i % 4}", 0.5) for i in range(20) if i != 7], "mal_id long, dim string, weight double")
    plain = rows(recommend.user_profile(seen, entries))
    monkeypatch.setattr(recommend, "PROFILE_ROWS", 5)
    dealt = recommend.user_profile(seen, entries)
    assert rows(dealt) == plain
    assert dealt.rdd.getNumPartitions() >= 8


def test_plain_vectors_travel_without_dims(spark):
    """places in a dense vector are made inside the cells; lists stay the same."""
    rnd = np.random.default_rng(6)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.normal(size=(40, 5)))]
    df = spark.createDataFrame(data, "id bigint, vector array<double>")
    vecs = blocks.dense(df, "id", "vector")
    skip = df.select("id", (F.col("id") + 1).alias("gone"))
    for metric in ("cosine", "dot"):
        plain, full = (blocks.score_top(vecs, vecs, 4, metric, skip, True, query_block=9, item_block=15, plain=p) for p in (True, False))
        assert "null AS dims" in plain._jdf.queryExecution().optimizedPlan().toString()
        assert rows(plain, "query", "rank", "item") == rows(full, "query", "rank", "item")
    assert "null AS dims" in blocks.approx_top(df, df, 3, lists=4, probes=2)._jdf.queryExecution().optimizedPlan().toString()


def test_factorization_reads_ratings_once(spark, ratings):
    """the ratings are written once for the indexes, the fit and the cells."""
    df, data = ratings
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    found = recommend.als_recommend(df.mapInArrow(count, df.schema), 3, rank=2, iterations=2).collect()
    assert read.value == len(data)
    seen = {(u, i) for u, i, _ in data}
    assert len(found) > 40 and not any((r.user_id, r.item_id) in seen for r in found)


def test_cf_arm_falls_back_to_popularity(spark, tmp_path):
    """users without clicks (2), and clickers whose items nobody else has (3 is a customer, 4 is none), get the popular unseen items."""
    from shelfspark.queries import recommend as queries

    parts = [(i, f"red blue {i}", "STEEL", "Brand#1", 1) for i in range(1, 31)]
    tables = {
        "part": (parts, "p_partkey bigint, p_name string, p_type string, p_brand string, p_size int"),
        "lineitem": ([(i,) for i in range(1, 31) for _ in range(31 - i)], "l_partkey bigint"),
        "customer": ([(u,) for u in (1, 2, 3, 5)], "c_custkey bigint"),
        "events": ([(1, 1.5), (5, 1.2), (5, 2.0), (3, 7.0), (4, 3.9), (None, 9.0)], "user_id bigint, value double"),
    }
    for name, (data, kind) in tables.items():
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {}
    for r in queries.cf_arm(spark, str(tmp_path)).orderBy("rank").collect():
        got.setdefault(r.user_id, []).append((r.item_id, r.score is None))
    popular = {u: [(i, True) for i in range(1, 31) if i not in seen][:20] for u, seen in ((2, []), (3, [7]), (4, [3]), (5, [1, 2]))}
    assert got == {1: [(2, False)], **popular}
