import math
from datetime import datetime

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfspark.functions import values
from shelfspark.operators import features as op
from shelfspark.plans import features as plan


def test_clean_measures_nulls_first(spark):
    data = [(1, None, "2024-01-01", "x")] * 9 + [(None, None, None, None), (2, "v", "2024-01-02", "2024-02-30")]
    df = spark.createDataFrame(data, "a int, mostly string, d string, bad string")
    out = op.clean_frame(df, ["d", "bad"])
    assert out.columns == ["a", "d", "bad"] and out.count() == 2
    assert dict(out.dtypes)["d"] == "timestamp" and dict(out.dtypes)["bad"] == "string"


def test_weekday(spark):
    df = spark.createDataFrame([(datetime(2026, 9, 26, 13),)], "t timestamp_ntz")  # a Saturday
    (r,) = op.time_features(df, ["t"]).collect()
    assert (r.t_year, r.t_hour, r.t_dayofweek, r.t_is_weekend) == (2026, 13, 5, 1)


def test_seasons(spark):
    df = spark.createDataFrame([(datetime(2026, 9, 25).date(),)], "d date")
    (r,) = df.select(values.season_window(F.col("d"), 3).alias("w")).collect()
    assert [tuple(x) for x in r.w] == [(2026, "summer"), (2026, "fall"), (2027, "winter")]


@pytest.mark.parametrize("n", [1, 7, 100, 1003])
def test_exact_split_size(spark, n):
    parts = op.split_exact(spark.range(n), ["id"])
    assert parts.count() == n and parts.filter("split = 'test'").count() == math.ceil(n * 0.2)


def test_hash_split_is_stable(spark):
    df = spark.range(2000)
    a = rows(op.split_hash(df, ["id"]))
    assert a == rows(op.split_hash(df.repartition(7), ["id"]))
    assert 300 < sum(1 for _, s in a if s == "test") < 500


def test_labels_raise_on_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    fitted = op.fit_labels(train, "c")
    assert rows(op.label_encode(train, "c", fitted)) == [(0,), (1,), (2,)]
    with pytest.raises(Exception, match="unseen label"):
        op.label_encode(spark.createDataFrame([("z",)], "c string"), "c", fitted).collect()


def test_onehot_unknown_is_zero(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    fitted = {"c": op.categories(train, "c")}
    out = op.onehot_encode(spark.createDataFrame([("b",), ("z",), (None,)], "c string"), ["c"], fitted)
    assert out.columns == ["c_a", "c_b"] and rows(out) == [(0.0, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_multilabel_names_may_differ_in_case(spark):
    df = spark.createDataFrame([(1, ["Red", "red"]), (2, ["Blue"])], "i int, g array<string>")
    out = op.multilabel_encode(df, "g", op.array_classes(df, "g"))
    assert out.columns == ["i", "g_Blue", "g_Red", "g_red~2"] and rows(out) == [(1, 0, 1, 1), (2, 1, 0, 0)]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, same double")
    std = op.apply_scaler(df, ["x", "same"], op.fit_scaler(df, ["x", "same"]))
    assert rows(std) == [(-1.0, 0.0), (1.0, 0.0)]
    mm = op.apply_scaler(df, ["x", "same"], op.fit_scaler(df, ["x", "same"], "minmax"))
    assert rows(mm) == [(0.0, 0.0), (1.0, 0.0)]


def test_scaling_fits_on_train_only(spark):
    df = spark.range(200).select("id", F.col("id").cast("double").alias("x"))
    out = plan.split_and_scale(df, ["id"], ["x"], [])
    m = out.filter("split = 'train'").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1] - 1) < 1e-9


def test_tfidf_formula(spark):
    docs = spark.createDataFrame([(1, "red red Ring a"), (2, "blue ring"), (3, "!")], "id int, t string")
    fitted = op.fit_tfidf(docs, "id", "t", 2)  # red and ring occur twice, blue once
    assert [r.term for r in fitted.orderBy("idx").collect()] == ["red", "ring"]
    got = {(r.id, r.term): r.weight for r in op.tfidf(docs, "id", "t", fitted).collect()}
    red, ring = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    n = math.hypot(red, ring)
    assert got.keys() == {(1, "red"), (1, "ring"), (2, "ring")}
    assert abs(got[(1, "red")] - red / n) < 1e-12 and abs(got[(2, "ring")] - 1) < 1e-12
    wide = {r.id: r.vector for r in op.dense_rows(op.tfidf(docs, "id", "t", fitted), "id", 2).collect()}
    assert np.allclose(wide[1], [red / n, ring / n]) and np.allclose(wide[2], [0, 1])


def test_embedding_is_unit(spark):
    df = spark.createDataFrame([(1, "red ring"), (2, ""), (3, None)], "i int, t string")
    got = {r.i: np.linalg.norm(r.vector) for r in op.text_embed(df, "t").collect()}
    assert abs(got[1] - 1) < 1e-9 and got[2] == got[3] == 0


def test_item_features_take_the_larger(spark):
    kind = "mal_id int, genres array<string>, tags array<struct<name:string,weight:int>>"
    df = spark.createDataFrame([(1, ["Action"], [("Action", 50), ("Mecha", 90), (None, 3)])], kind)
    assert rows(op.item_features(df)) == [(1, "Action", 1.0), (1, "Mecha", 0.9)]


@pytest.mark.parametrize("max_rows", [10**6, 5])
def test_asof(spark, max_rows):
    t = [datetime(2026, 1, d) for d in range(1, 30)]
    feats = spark.createDataFrame([(1, t[3], 10), (1, t[10], 20), (2, t[5], 30)], "k int, event_timestamp timestamp_ntz, f int")
    ents = spark.createDataFrame([(1, t[i], i) for i in range(12)] + [(2, t[4], 99), (3, t[4], 98)], "k int, event_timestamp timestamp_ntz, e int")
    got = {r.e: r.f for r in op.asof_join(ents, feats, ["k"], max_rows=max_rows).collect()}
    assert got == {**{i: None if i < 3 else 10 if i < 10 else 20 for i in range(12)}, 99: None, 98: None}
    aged = {r.e: r.f for r in op.asof_join(ents, feats, ["k"], ttl_seconds=86400 * 2, max_rows=max_rows).collect()}
    assert aged[5] == 10 and aged[6] is None and aged[10] == 20


def test_materialize_in_steps(spark):
    kind = "k int, ts timestamp_ntz, v int"
    f = spark.createDataFrame([(1, datetime(2026, 1, 1), 1), (1, datetime(2026, 1, 5), 2), (2, datetime(2026, 1, 2), 3), (2, datetime(2026, 2, 1), 4)], kind)
    one = op.materialize(None, f, ["k"], "ts", "2025-01-01", "2026-01-03")
    assert rows(one, "k", "v") == [(1, 1), (2, 3)]
    two = op.materialize(one, f, ["k"], "ts", "2026-01-03", "2026-01-31")
    assert rows(two, "k", "v") == [(1, 2), (2, 3)]
    asked = spark.createDataFrame([(1,), (9,)], "k int")
    assert rows(op.online_lookup(two, asked, ["k"]), "k", "v") == [(1, 2), (9, None)]


def test_views(spark):
    ratings = spark.createDataFrame([(1, 5, datetime(2026, 1, 3), 4), (1, 6, datetime(2026, 1, 4), 2)], "user_id int, item_id int, timestamp timestamp_ntz, rating int")
    a, b = plan.rating_features(ratings).orderBy("item_id").collect()
    assert a.time_since_last is None and b.time_since_last == 86400.0 and a.timestamp_is_weekend == 1
    items = spark.createDataFrame([(1, ["A"], datetime(2026, 1, 3), "red ring"), (2, ["B"], None, "red")], "id int, g array<string>, d timestamp_ntz, t string")
    out = plan.item_features(items, "g", "d", "t", "id", classes=["A"])
    got = {r.id: r for r in out.collect()}
    assert got[1].g_A == 1 and got[2].g_A == 0 and got[2].d_year is None and len(got[1].t_tfidf) == 2
    sparse = {r.id: r.g for r in plan.item_features(items, "g", "d", "t", "id").collect()}
    assert sparse[1].size == 2 and sparse[1].indices == [0] and sparse[2].indices == [1] and sparse[2]["values"] == [1.0]


def test_asof_ties_do_not_depend_on_the_plan(spark):
    import datetime

    t = datetime.datetime(2026, 1, 1)
    feats = spark.createDataFrame([(1, t, i, float(i)) for i in range(20)], "k int, event_timestamp timestamp, f int, v double")
    ents = spark.createDataFrame([(1, t, i) for i in range(5)], "k int, event_timestamp timestamp, e int")
    plain = {r.f for r in op.asof_join(ents, feats, ["k"]).collect()}
    hot = {r.f for r in op.asof_join(ents, feats.repartition(5), ["k"], max_rows=3).collect()}
    assert len(plain) == 1 and plain == hot
    assert {r.f for r in op.asof_join(ents, feats, ["k"], tie=["f"]).collect()} == {19}


def test_many_categories(spark):
    """Classes without number go through an index join; a wide encoding of them is refused."""
    df = spark.range(1_000_000).select("id", F.concat(F.lit("c"), "id").alias("c"))
    with pytest.raises(ValueError, match="onehot_sparse"):
        op.categories(df, "c")
    with pytest.raises(ValueError):
        op.array_classes(df.select(F.array("c").alias("a")), "a")
    coded = op.onehot_sparse(df, "c", op.fit_index(df, "c"))
    assert coded.agg(F.count_distinct(F.col("c.indices")[0])).first()[0] == 1_000_000
    assert coded.filter("c.size = 1000000 and size(c.indices) = 1 and c.values[0] = 1.0").count() == 1_000_000
    assert op.onehot_long(df, "id", ["c"]).count() == 1_000_000


def test_sparse_equals_dense(spark):
    train = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z", "x", "x"]), (3, "a", []), (4, None, None)], "k int, c string, g array<string>")
    asked = train.union(spark.createDataFrame([(5, "new", ["w", "y"])], train.schema))
    classes, labels = op.categories(train, "c"), op.array_classes(train, "g")
    wide = {r.k: r for r in op.multilabel_encode(op.onehot_encode(asked, ["c"], {"c": classes}), "g", labels).collect()}
    sparse = op.multilabel_sparse(op.onehot_sparse(asked, "c", op.fit_index(train, "c")), "k", "g", op.fit_index(train, "g"))
    for r in sparse.collect():
        assert r.c.size == len(classes) and r.g.size == len(labels)
        assert [float(i in r.c.indices) for i in range(r.c.size)] == [wide[r.k][f"c_{v}"] for v in classes]
        assert [int(i in r.g.indices) for i in range(r.g.size)] == [wide[r.k][f"g_{v}"] or 0 for v in labels]
