import pytest
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from shelfspark.operators import catalog as op, quality, resolve, upserts


def raw(spark, *payloads):
    data = [(i + 1, s, p, datetime(2024, 1, 1), datetime(2024, 1, 2)) for i, (s, p) in enumerate(payloads)]
    return spark.createDataFrame(data, "mal_id bigint, source string, payload string, fetched_at timestamp_ntz, expires_at timestamp_ntz")


def test_flatten_defaults_and_unions(spark):
    full = (
        '{"title":"T","episodes":"12","year":"","studios":[{"name":"S"},{"name":null}],"genres":[{"name":"B"}],"themes":[{"name":"A"},{"name":"B"}],'
        '"score":"8.5","images":{"jpg":{"image_url":"j"},"webp":{"large_image_url":"w"}},"rank":7}'
    )
    got = op.flatten_payload(raw(spark, ("jikan", full), (None, "{}"))).orderBy("mal_id").collect()
    a, b = got
    assert (a.title, a.episodes, a.year, a.studios, a.genres, a.score, a.image_url) == ("T", 12, None, ["S"], ["A", "B"], 8.5, "j")
    assert (a.rank_mal, a.sources) == (7, ["jikan"])
    assert (b.title, b.genres, b.studios, b.tags, b.sources) == ("Anime 2", [], [], [], ["tenrai"])


def test_basic_mapping_ignores_themes(spark):
    p = '{"genres":[{"name":"B"}],"themes":[{"name":"A"}],"images":{"webp":{"large_image_url":"w"}}}'
    (r,) = op.flatten_payload_basic(raw(spark, ("x", p))).collect()
    assert r.genres == ["B"] and r.image_url is None and r.title == "Anime 1"


def test_media_row(spark):
    kind = "idMal int, tags array<struct<name:string,rank:int>>, averageScore int, favourites int, popularity int, description string"
    df = spark.createDataFrame([(1, [("X", 95), (None, 1), ("Y", None)], 85, 3, 4, "<br>Hi <i>there</i>  x"), (2, None, None, None, None, ""), (None, [], 1, 1, 1, "z")], kind)
    a, b = op.media_to_row(df).orderBy("mal_id").collect()
    assert a.score_anilist == 8.5 and [tuple(t) for t in a.tags_anilist] == [("X", 95), ("Y", 0)] and a.description_anilist == "Hi there x"
    assert b.score_anilist is None and b.description_anilist is None and b.tags_anilist == []


def shelf(spark):
    data = [(10, "Alpha", ["Action", "Mecha"], 8.0, 5, "TV"), (20, "Alpha Two", ["Action"], 9.0, 1, "Movie"), (30, "Beta", ["Romance"], None, 9, "TV"), (40, "Gamma", ["Mecha"], 8.0, 7, "TV")]
    return spark.createDataFrame(data, "mal_id bigint, title string, genres array<string>, score double, members bigint, type string")


def test_similar_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    data = [(i, rnd.sample("abcdef", rnd.randint(1, 3)), rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(60)]
    cat = spark.createDataFrame(data, "mal_id bigint, genres array<string>, score double")
    got = {}
    for r in op.similar_by_genre(cat, 4).collect():
        got.setdefault(r.mal_id, {})[r["rank"]] = r.item
    for i, g, _ in data:
        near = [(-(s or -1), j) for j, h, s in data if j != i and set(g) & set(h)]
        assert [got.get(i, {}).get(n + 1) for n in range(min(4, len(near)))] == [j for _, j in sorted(near)[:4]]


def test_genre_top_with_wording(spark):
    cat = shelf(spark).withColumn("synopsis", F.when(F.col("mal_id") == 30, "Sent to ANOTHER  world").otherwise("x"))
    tokens = spark.createDataFrame([("act",), ("Isekai",), ("none",)], "token string")
    got = rows(op.genre_top(cat, tokens, 2), "token", "mal_id", "rank")
    assert got == [("Isekai", 30, 1), ("act", 10, 2), ("act", 20, 1)]


def test_search_filters_are_optional(spark):
    cat = shelf(spark).withColumns({c: F.lit(None).cast("string") for c in ("title_japanese", "image_url", "season", "status")}).withColumn("year", F.lit(2000))
    assert [r.mal_id for r in op.search(cat, "ALPHA").collect()] == [20, 10]
    assert [r.mal_id for r in op.search(cat, "", genre="Mecha", year=2000).collect()] == [10, 40]
    assert [r.mal_id for r in op.trending(cat, 99).collect()] == [20, 10, 40, 30]


def test_resolve(spark):
    cat = shelf(spark)
    names = spark.createDataFrame([("ALPHA (2001)",), ("lpha t",), ("amm",), ("zzz",), ("a",), ("  ",)], "name string")
    got = dict(rows(resolve.resolve_titles(names, cat)))
    assert got == {"ALPHA (2001)": 10, "lpha t": 20, "amm": 40, "a": 30}


def test_substring_pairs_equal_contains(spark):
    keys = ["abcabc", "bca", "c", "xyz", "zabcz", "", "ab c"]
    needles = ["abc", "bc", "c", "zz", "abcabcx", "b c"]
    hay = spark.createDataFrame([(k,) for k in keys], "key string")
    ask = spark.createDataFrame([(n,) for n in needles], "n string")
    assert rows(resolve.substring_pairs(ask, "n", hay, "key")) == sorted((n, k) for n in needles for k in keys if n in k)


def test_gate(spark):
    cols = "title string, image_url string, score double, year int"
    good = spark.createDataFrame([("t", "u", 1.0, 2000)] * 10, cols)
    assert quality.gate(good) == [] and quality.gate(good, 11) == ["rows 10 < min_rows 11"]
    assert quality.gate(good.limit(0)) == ["row_count is 0"]
    bad = good.union(spark.createDataFrame([("t", None, 1.0, 2000)], cols))
    assert quality.gate(bad) == ["image_url null-rate 0.091 > 0.05"]


def test_insert_ignore_first_wins(spark):
    t = spark.createDataFrame([(1, "old", 0)], "id int, v string, seq int")
    b = spark.createDataFrame([(1, "new", 1), (2, "a", 2), (2, "b", 3)], t.schema)
    assert rows(upserts.insert_ignore(t, b, ["id"], ["seq"]), "id", "v") == [(1, "old"), (2, "a")]
    assert rows(upserts.insert_ignore(t, b, ["id"], ["seq"], refresh=True), "id", "v") == [(1, "new"), (2, "a")]


def test_scores_keep_first_time(spark):
    t = spark.createDataFrame([("u", 1, 5, 100)], "user_id string, item_id int, score int, ts int")
    b = spark.createDataFrame([("u", 1, 9, 200), ("u", 2, 3, 300)], t.schema)
    assert rows(upserts.upsert_scores(t, b)) == [("u", 1, 9, 100), ("u", 2, 3, 300)]


def test_list_changes(spark):
    t = spark.createDataFrame([(1, 1, "watching", 3, None), (1, 2, "dropped", 0, 5)], "user_id int, item_id int, status string, progress int, score int")
    kind = "user_id int, item_id int, seq int, op string, status string, progress int, score int"
    log = [
        (1, 1, 1, "patch", None, 4, 9), (1, 1, 2, "patch", "completed", None, None), (1, 2, 1, "delete", None, None, None), (1, 2, 2, "patch", "x", 1, 1),
        (1, 3, 1, "upsert", "on_hold", 0, None), (1, 3, 2, "patch", None, 7, None), (1, 4, 1, "patch", "watching", 1, 1),
    ]
    got = rows(upserts.apply_list_changes(t, spark.createDataFrame(log, kind)))
    assert got == [(1, 1, "completed", 4, 9), (1, 3, "on_hold", 7, None)]


def test_discover_first_seen(spark):
    data = [(0, p, i) for p, i in enumerate([1, 2, 3, 2])] + [(1, p, i) for p, i in enumerate([3, 99])]
    pages = spark.createDataFrame(data, "arm int, pos int, id int")
    got = op.discover_ids(pages).orderBy("arm", "pos")
    assert [r.id for r in got.collect()] == [1, 2, 3, 99]


def test_todo_skips_done_and_fresh(spark):
    ids = spark.range(1, 6).withColumnRenamed("id", "mal_id")
    assert rows(op.crawl_todo(ids, ids.filter("mal_id = 1"), ids.filter("mal_id = 5"))) == [(2,), (3,), (4,)]


def test_similar_by_genre_deals_items_before_the_cut(spark, tmp_path, monkeypatch):
    """One file is one scan task: the sort for the best of each genre must not be in it."""
    monkeypatch.setattr(op, "TASK_ROWS", 10)
    cat = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"], float(i % 7)) for i in range(40)], "mal_id bigint, genres array<string>, score double")
    cat.coalesce(1).write.parquet(str(tmp_path / "cat"))
    found = op.similar_by_genre(spark.read.parquet(str(tmp_path / "cat")), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.index("WindowGroupLimit") < plan.index("REPARTITION_BY_NUM")
    assert rows(found, "mal_id", "rank", "item") == rows(op.similar_by_genre(cat, 3), "mal_id", "rank", "item")
