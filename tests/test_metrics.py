import pytest
from conftest import rows

from shelfspark.operators import metrics as op, quality


def lists(spark, ranked, rel):
    q = spark.createDataFrame([(i,) for i in range(len(ranked))], "query int")
    r = spark.createDataFrame([(i, n + 1, x) for i, l in enumerate(ranked) for n, x in enumerate(l)], "query int, rank int, item int")
    g = spark.createDataFrame([(i, x) for i, s in enumerate(rel) for x in s], "query int, item int")
    return q, r, g


@pytest.mark.parametrize(
    "name,k,ranked,rel,want",
    [
        ("precision", 5, [1, 2, 3, 4, 5], {1, 3}, 0.4),
        ("precision", 5, [1, 2], {1}, 0.2),
        ("recall", 3, [1, 2, 3], {1, 3, 9}, 0.666667),
        ("recall", 3, [1, 1, 1], {1, 2}, 0.5),
        ("mrr", 10, [9, 1, 2], {1}, 0.5),
        ("map", 3, [1, 9, 2], {1, 2}, 0.833333),
        ("ndcg", 3, [1, 2, 3], {1, 2, 3}, 1.0),
        ("ndcg", 5, [1], {1, 2}, 1.0),
        ("ndcg_full", 5, [1], {1, 2}, 0.613147),
        ("precision", 5, [1, 2], set(), 0.0),
        ("ndcg", 5, [1, 2], set(), 0.0),
        ("map", 5, [], {1}, 0.0),
    ],
)
def test_single(spark, name, k, ranked, rel, want):
    # a filler query keeps the frames non-empty
    q, r, g = lists(spark, [ranked, [5]], [rel, {5}])
    assert dict(rows(op.one_metric(q, r, g, name, k)))[0] == want


def test_mrr_looks_past_k(spark):
    q, r, g = lists(spark, [list(range(20))], [{15}])
    (m,) = op.ranked_list_metrics(q, r, g).collect()
    assert m.mrr == round(1 / 16, 6) and m.precision_10 == 0


def test_query_without_hits_stays(spark):
    q, r, g = lists(spark, [[1], []], [{2}, {3}])
    assert rows(op.ranked_list_metrics(q, r, g), "query", "mrr", "map_10") == [(0, 0.0, 0.0), (1, 0.0, 0.0)]


def test_candidate_recall(spark):
    _, c, g = lists(spark, [[1, 2, 3], []], [{1, 9}, {4}])
    assert rows(op.candidate_recall(c, g)) == [(0, 0.5), (1, 0.0)]


def test_loose(spark):
    q, r, _ = lists(spark, [[1, 2, 3]], [set()])
    genres = spark.createDataFrame([(1, "action"), (2, "drama"), (3, "action")], "item int, genre string")
    gold = spark.createDataFrame([(0, "action")], "query int, genre string")
    (m,) = op.loose_metrics(q, r, genres, gold).collect()
    assert m.p5 == 0.4 and m.mrr == 1.0


def test_graded(spark):
    _, r, _ = lists(spark, [[1, 2]], [set()])
    gains = spark.createDataFrame([(0, 1, 0.5), (0, 2, 1.0)], "query int, item int, gain double")
    ideal = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.5), (0, 3, 0.4)], "query int, rank int, gain double")
    from math import log2

    want = (0.5 + 1 / log2(3)) / (1 + 0.5 / log2(3))
    assert rows(op.graded_ndcg(r, gains, ideal, 5)) == [(0, round(want, 6))]


def test_intents(spark):
    _, r, _ = lists(spark, [[1, 2, 3]], [set()])
    intents = spark.createDataFrame([(0, "a", 1), (0, "a", 7), (0, "b", 8)], "query int, intent string, item int")
    assert rows(op.intent_recall(r, intents)) == [(0, 0.5)]
    tastes = spark.createDataFrame([(0, "x", 0.5), (0, "y", 0.1), (1, "p", 0.1), (1, "q", 0.15), (1, "r", 0.05), (1, "s", 0.01)], "query int, dim string, weight double")
    assert rows(op.taste_intents(tastes)) == [(0, "x"), (1, "p"), (1, "q"), (1, "r")]


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_percentile_rule(spark, n):
    xs = [(i * 37 % 101) ** 2 / 7 for i in range(n)]
    df = spark.createDataFrame([("g", x) for x in xs] + [("h", 1.0)], "g string, x double")
    got = {(r.g, r.p): r.value for r in quality.percentile_nearest(df, ["g"], "x", [50, 95, 99]).collect()}
    for p in (50, 95, 99):
        assert got[("g", p)] == sorted(xs)[min(int(p / 100 * n), n - 1)] and got[("h", p)] == 1.0


def test_steps_and_means(spark):
    curves = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.4), ("a", 2, 0.2), ("b", 0, 0.1)], "arm string, step int, ndcg double")
    assert rows(quality.steps_to_target(curves)) == [("a", 1), ("b", None)]
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0)], "arm string, g string, m double")
    assert rows(quality.macro_means(df, "arm", "g", "m"), "g", "mean_m") == [("x", 1.0), ("y", 3.0), (None, 2.0)]
    nan = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "s double")
    assert rows(quality.null_skipping_means(nan, ["s"])) == [("s", 1.0, 1, 3)]


def test_report(spark):
    golden = spark.createDataFrame([(0, "search"), (1, "search"), (2, "recommend_multi")], "query int, intent string")
    ranked = spark.createDataFrame([(0, 1, 10), (2, 1, 5)], "query int, rank int, item int")
    rel = spark.createDataFrame([(0, 10), (2, 5)], "query int, item int")
    intents = spark.createDataFrame([(2, 1, 5), (2, 2, 6)], "query int, intent int, item int")
    times = spark.createDataFrame([(float(i),) for i in range(100)], "ms double")
    (r,) = op.benchmark_report(golden, ranked, rel, intents, times).collect()
    assert (r.n, r.mrr, r.precision_5, r.intent_recall_5, r.n_multi) == (2, 0.5, 0.1, 0.5, 1)
    assert (r.latency_p50, r.latency_p95) == (50.0, 95.0)


def test_percentiles_of_nothing_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", float("nan"))], "g string, x double")
    got = quality.percentile_nearest(df, ["g"], "x", [50])
    assert [(r.g, r.p, r.value, r.n) for r in got.collect()] == [("a", 50, 1.0, 1)]
    assert quality.percentile_nearest(df.filter("g = 'b'"), ["g"], "x", [50]).count() == 0
    assert quality.percentile_nearest(df.limit(0), [], "x", [50]).count() == 0


def test_graded_ndcg_keeps_queries_without_a_list(spark):
    r = spark.createDataFrame([(0, 1, 10)], "query int, rank int, item int")
    gains = spark.createDataFrame([(0, 10, 1.0), (1, 11, 1.0)], "query int, item int, gain double")
    ideal = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0)], "query int, rank int, gain double")
    assert rows(op.graded_ndcg(r, gains, ideal, 5)) == [(0, 1.0), (1, 0.0)]


def test_shared_labels_equal_their_pairs(spark):
    labels = spark.createDataFrame(
        [(i, i % 4) for i in range(30)] + [(3, 3), (5, 2), (5, 0), (9, 2), (40, 7), (41, None), (None, 1)], "id int, label int"
    )
    pairs = labels.toDF("query", "label").join(labels.toDF("item", "label"), "label").filter("query <> item").select("query", "item")
    ranked = spark.createDataFrame([(q, r, (q * 5 + r * r) % 42) for q in range(42) for r in range(1, 8)], "query int, rank int, item int")
    queries = labels.select(op.F.col("id").alias("query"))
    shared = op.SameLabel(labels)
    assert "query" not in shared.labels.columns  # no pairs are built before they are asked for
    assert rows(op.score_hits(ranked, shared)) == rows(op.score_hits(ranked, pairs))
    assert rows(op.candidate_recall(ranked, shared)) == rows(op.candidate_recall(ranked, pairs))
    for name in ("precision", "recall", "ndcg", "ndcg_full", "mrr", "map"):
        assert rows(op.one_metric(queries, ranked, shared, name, 5)) == rows(op.one_metric(queries, ranked, pairs, name, 5))
