from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfspark.functions import values
from shelfspark.operators import interactions as op, skew


@pytest.fixture(scope="module")
def log(spark):
    scores = {1: 9, 2: 8, 3: 7, 4: 4, 5: 2, 6: 10}
    data = [(u, i, s, datetime(2026, 1 + i % 3, 1)) for u in "abc" for i, s in scores.items()]
    return spark.createDataFrame(data, "user_id string, item_id int, score int, ts timestamp_ntz")


def test_rare_user_is_dropped(spark, log):
    rare = spark.createDataFrame([("z", 99, 5, datetime(2026, 1, 1))], log.schema)
    kept = op.min_count_filter(log.union(rare), 5, 3)
    assert kept.count() == 18 and kept.filter("user_id = 'z'").count() == 0


def test_two_rounds_not_a_fixed_point(spark):
    data = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3), ("c", 4), ("d", 4), ("d", 5), ("e", 5), ("e", 6)]
    df = spark.createDataFrame(data, "user_id string, item_id int")
    want = [(u, i) for u, i in data]
    for _ in range(2):
        users = {u for u, _ in want if sum(1 for x, _ in want if x == u) >= 2}
        want = [(u, i) for u, i in want if u in users]
        items = {i for _, i in want if sum(1 for _, x in want if x == i) >= 2}
        want = [(u, i) for u, i in want if i in items]
    assert rows(op.min_count_filter(df, 2, 2), "user_id", "item_id") == sorted(want)


@pytest.mark.parametrize("max_rows", [1000, 2])
def test_time_split_has_no_leak(log, max_rows):
    split = op.time_split(log, 0.2, max_rows)
    assert rows(split.groupBy("user_id", "split").count()) == sorted(
        [(u, s, n) for u in "abc" for s, n in (("train", 5), ("test", 1))]
    )
    ends = split.groupBy("user_id").agg(
        F.max(F.when(F.col("split") == "train", F.col("ts"))).alias("a"),
        F.min(F.when(F.col("split") == "test", F.col("ts"))).alias("b"),
    )
    assert ends.filter("b < a").count() == 0
    assert {r[0] for r in split.filter("split = 'test'").select("item_id").collect()} == {5}


def test_single_row_stays_in_train(spark):
    one = spark.createDataFrame([("a", 1, 5, datetime(2026, 1, 1))], "user_id string, item_id int, score int, ts timestamp_ntz")
    assert rows(op.time_split(one), "split") == [("train",)]


def test_matrix_stats_count_explicit_zeros(log):
    implied = op.implicit(log, 7)
    assert implied.agg(F.sum("value")).first()[0] == 12
    assert rows(op.matrix_stats(implied)) == [(3, 6, 18, 1.0)]


def test_dense_index_both_routes(spark):
    df = spark.createDataFrame([("u2",), ("u1",), ("u2",), ("u3",)], "id string")
    want = [("u1", 0), ("u2", 1), ("u3", 2)]
    assert rows(skew.dense_index(df, "id")) == want


def test_hot_and_plain_routes_agree(spark):
    data = [("hot", i % 50, i, None if i % 3 else i) for i in range(400)] + [("cold", i, i, i) for i in range(5)]
    df = spark.createDataFrame(data, "k string, t int, id int, v int").repartition(4)
    order = [F.asc("t"), F.asc("id")]
    for fn, args in (
        (skew.row_numbers, ("x",)),
        (skew.previous_value, ("id", "x")),
        (skew.last_known, ("v", "x")),
    ):
        plain = rows(fn(df, ["k"], order, *args), "k", "id", "x")
        hot = rows(fn(df, ["k"], order, *args, max_rows=20), "k", "id", "x")
        assert plain == hot and len(plain) == 405


def test_gap_in_seconds(spark):
    data = [("a", 1, datetime(2026, 1, 1)), ("a", 2, datetime(2026, 1, 1, 0, 1)), ("b", 3, datetime(2026, 1, 1))]
    df = spark.createDataFrame(data, "u string, id int, ts timestamp_ntz")
    assert rows(op.interaction_gap(df, ["u"], "ts", "id"), "id", "time_since_last") == [(1, None), (2, 60.0), (3, None)]


def test_normalize_score(spark):
    cases = [
        (85.0, "POINT_100", 8), (8.6, "POINT_10_DECIMAL", 9), (7.0, "POINT_10", 7), (4.0, "POINT_5", 8), (3.0, "POINT_3", 10),
        (0.0, "POINT_10", None), (None, "POINT_10", None), (11.0, "POINT_10", None), (9.0, "POINT_3", None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s double, f string, want int")
    got = df.select("i", values.normalize_score(F.col("s"), F.col("f")).alias("x"), "want")
    assert all(r["x"] == r["want"] for r in got.collect())


def test_partial_date(spark):
    kind = "d struct<year:int,month:int,day:int>"
    df = spark.createDataFrame([((2020, 3, 5),), ((2020, None, None),), (None,), ((None, 1, 1),)], kind)
    got = df.select(values.partial_date(F.col("d"), F.lit("2024-01-01").cast("date")).alias("x"))
    assert [r[0] for r in got.collect()] == [date(2020, 3, 5), date(2020, 1, 1), date(2024, 1, 1), date(2024, 1, 1)]


def test_status_ratings(spark):
    data = [(1, 10, "completed", None), (2, 10, "completed", None), (2, 20, "completed", None), (3, 30, "dropped", None), (4, 40, "watching", 8)]
    df = spark.createDataFrame(data, "user_id int, item_id int, status string, score int")
    assert rows(op.ratings_from_list(df)) == [(1, 10, 1.0), (2, 10, 1.0), (2, 20, 1.0), (4, 40, 0.8)]


def test_list_rules(spark):
    data = [(1, 1, "watching", 5), (1, 2, "gone", 5), (1, 3, "dropped", 11), (1, 4, "dropped", None), (2, 1, "dropped", 1), (2, 1, "dropped", 2)]
    df = spark.createDataFrame(data, "user_id int, item_id int, status string, score int")
    assert rows(op.valid_entries(df), "user_id", "item_id") == [(1, 1), (1, 4)]
    assert {r["reason"] for r in op.quarantined(df).collect()} == {"invalid status", "score out of range", "duplicate entry"}


def test_pivot_refuses_duplicates(spark, log):
    assert op.pivot_matrix(log, [1, 2, 3]).count() == 3
    with pytest.raises(ValueError):
        op.pivot_matrix(log.union(log), [1, 2, 3])


def test_parse_entries(spark):
    entries = (
        '{"media":{"idMal":1},"score":85,"completedAt":{"year":2021,"month":5,"day":1}},{"media":{"idMal":3},"score":92,"completedAt":{}},'
        '{"media":{"idMal":null},"score":50},{"media":{"idMal":4},"score":0}'
    )
    payload = '{"data":{"MediaListCollection":{"lists":[{"entries":[' + entries + "]}]}}}"
    df = spark.createDataFrame([("u", "POINT_100", payload, date(2024, 1, 1))], "user_id string, fmt string, payload string, fallback date")
    assert rows(op.parse_entries(df)) == [("u", 1, 8, date(2021, 5, 1)), ("u", 3, 9, date(2024, 1, 1))]


def test_unscored_rows_go(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, float("nan"))], "i int, score double")
    assert rows(op.drop_unscored(df), "i") == [(1,)]
