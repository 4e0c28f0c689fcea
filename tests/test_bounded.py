"""Bounded top k against a full scan."""

import random

import numpy as np
import pytest

from shelfspark.operators import bounded

KIND = "id long, dims array<long>, weights array<double>"


def vectors(n, seed, dims=9, signed=False, patterns=None):
    rng = random.Random(seed)

    def one():
        some = sorted(rng.sample(range(dims), rng.randrange(1, 4)))
        return some, [rng.choice([1.0, 2.0, 0.5, rng.random()]) * (-1 if signed and rng.random() < 0.4 else 1) for _ in some]

    fixed = [one() for _ in range(patterns or n)]
    return [(i, *fixed[rng.randrange(len(fixed))]) for i in range(n)]


def dense(rows, dims=9):
    out = np.zeros((len(rows), dims))
    for n, (_, d, w) in enumerate(rows):
        out[n, d] = w
    return out


def scan(queries, items, k, cosine, skip=(), own=False):
    q, i = dense(queries), dense(items)
    if cosine:
        q, i = q / np.linalg.norm(q, axis=1, keepdims=True), i / np.linalg.norm(i, axis=1, keepdims=True)
    s = q @ i.T
    out = {}
    for n, (qid, *_) in enumerate(queries):
        ids = [m for m in range(len(items)) if (qid, items[m][0]) not in skip and not (own and qid == items[m][0])]
        ids.sort(key=lambda m: (-round(s[n, m], 9), items[m][0]))
        out[qid] = [items[m][0] for m in ids[:k]], s[n].min(), s[n].max()
    return out


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("signed", [True, False])
@pytest.mark.parametrize("few", [4, 500])
def test_equals_scan(spark, cosine, signed, few):
    queries, items = vectors(30, 1, signed=signed), vectors(200, 2, signed=signed, patterns=40)
    skip = {(q, i) for q in range(0, 30, 2) for i in range(0, 200, 3)}
    df_q, df_i = spark.createDataFrame(queries, KIND), spark.createDataFrame(items, KIND)
    gone = spark.createDataFrame(sorted(skip), "q long, i long")
    got = bounded.top(df_q, df_i, 12, "cosine" if cosine else "dot", gone, spans=True, block_runs=few, run=5)
    lists = {}
    for r in sorted(got.collect(), key=lambda r: (r["query"], r["rank"])):
        lists.setdefault(r["query"], []).append(r)
    wanted = scan(queries, items, 12, cosine, skip)
    assert lists.keys() == wanted.keys()
    for q, rows in lists.items():
        assert [r["item"] for r in rows] == wanted[q][0] and [r["rank"] for r in rows] == list(range(1, 13))
        assert all(abs(r["lo"] - wanted[q][1]) < 1e-9 and abs(r["hi"] - wanted[q][2]) < 1e-9 for r in rows)


def test_blocks_skipped(spark):
    """Most blocks are never scored where vectors differ in their dims, and more than k items are never missed."""
    queries, items = vectors(60, 3, patterns=60), vectors(1500, 4, patterns=200)
    counters = {}
    got = bounded.top(spark.createDataFrame(queries, KIND), spark.createDataFrame(items, KIND), 10, block_runs=8, counters=counters)
    wanted = scan(queries, items, 10, True)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query"], r["rank"])):
        found.setdefault(r["query"], []).append(r["item"])
    assert found == {q: w[0] for q, w in wanted.items()}
    assert counters["pairs"] >= 60 * 15 and counters["scored"] < counters["pairs"] / 4


@pytest.mark.parametrize("k", [1, 50, 400])
def test_self_and_short_lists(spark, k):
    rows = vectors(70, 5)
    df = spark.createDataFrame(rows, KIND)
    got = bounded.top(df, df, k, exclude_self=True, block_runs=6)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query"], r["rank"])):
        found.setdefault(r["query"], []).append(r["item"])
    assert found == {q: w[0] for q, w in scan(rows, rows, k, True, own=True).items()}


def test_text_ids_and_nothing(spark):
    kind = KIND.replace("id long", "id string")
    items = spark.createDataFrame([(f"i{n}", [n % 3], [1.0]) for n in range(30)], kind)
    queries = spark.createDataFrame([("a", [0], [1.0]), ("b", [7], [1.0])], kind)
    got = {(r["query"], r["rank"]): r["item"] for r in bounded.top(queries, items, 2, block_runs=1).collect()}
    assert got == {("a", 1): "i0", ("a", 2): "i12", ("b", 1): "i0", ("b", 2): "i1"}
    assert bounded.top(queries.limit(0), items, 2).count() == 0
    assert bounded.top(queries, items.limit(0), 2).count() == 0


@pytest.mark.parametrize("run", [4096, 20])
def test_only_ids_that_can_be_listed_are_sent(spark, run):
    """of equal vectors the first k ids and as many as a query can skip are kept, so that blocks do not grow with the items."""
    queries, items = vectors(20, 1), vectors(3000, 2, patterns=12)
    items += [(i, d, w) for i, d, w in items[:40]]  # ids that come twice
    skip = {(q, i) for q in range(0, 20, 2) for i in range(0, 60, 3)}
    counters = {}
    df_i = spark.createDataFrame([*items, (None, *items[0][1:])], KIND)
    gone = spark.createDataFrame(sorted(skip), "q long, i long")
    got = bounded.top(spark.createDataFrame(queries, KIND), df_i, 15, "dot", gone, block_runs=12, run=run, counters=counters)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query"], r["rank"])):
        found.setdefault(r["query"], []).append(r["item"])
    assert found == {q: w[0] for q, w in scan(queries, items, 15, False, skip).items()}
    # 12 vectors with at most 15 + 20 + 1 ids of 250, some twice
    assert counters["pairs"] <= 20 * (1 if run == 4096 else 4)
    kept = bounded.run_blocks(df_i, run=run, need=35)
    assert kept.agg({"n": "sum"}).first()[0] <= 12 * 36 + 40


def test_parts_are_merged_after_the_shuffle(spark):
    """Plain arrays of ids and scores cross the shuffle, not an entry of three numbers for each item."""
    parts = spark.createDataFrame(
        [(1, [5, 3], [0.5, 0.25], 0.0, 0.5), (1, [2, 9], [0.5, 0.1], -0.5, 0.5), (2, [], [], 0.0, 0.0)],
        "query int, items array<bigint>, scores array<double>, lo double, hi double",
    )
    merged = bounded._merged(parts, 3)
    found = {r["query"]: ([(e["item"], e["score"]) for e in r.best], r.lo, r.hi) for r in merged.collect()}
    assert found == {1: ([(2, 0.5), (5, 0.5), (3, 0.25)], -0.5, 0.5), 2: ([], 0.0, 0.0)}
    below = merged._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]
    assert "zip_with" not in below and "arrays_zip" not in below


@pytest.mark.parametrize("few", [4, 500])
def test_places_equal_scan(spark, few):
    """Ranks of asked pairs, of which the list itself is never made."""
    queries, items = vectors(20, 1, signed=True), vectors(150, 2, signed=True, patterns=30)
    skip = {(q, i) for q in range(0, 20, 2) for i in range(0, 150, 3)}
    asked = [(q, i) for q in range(20) for i in range(q % 3, 150, 7) if (q, i) not in skip]
    frames = [spark.createDataFrame(x, k) for x, k in ((queries, KIND), (items, KIND), (asked, "query long, item long"), (sorted(skip), "q long, i long"))]
    got = {(r["query"], r["item"]): r["rank"] for r in bounded.places(*frames, block_runs=few, run=4).collect()}
    wanted = scan(queries, items, len(items), False, skip)
    assert got == {(q, i): wanted[q][0].index(i) + 1 for q, i in asked}
