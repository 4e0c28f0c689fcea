import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from shelfspark import schemas
from shelfspark.operators import interactions, upserts
from shelfspark.runtime import scratch_path
from shelfspark.sources import files, sinks
from shelfspark.streaming import jobs


def test_bundle(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t10\t5\t881250949\n2\t11\t3\t881250950\n")
    genres = "|".join(["0"] * 18 + ["1"])
    (tmp_path / "u.item").write_bytes(f"1|Café (1995)|01-Jan-1995||http://x|{genres}\n".encode("latin-1"))
    (tmp_path / "u.user").write_text("1|24|M|technician|85711\n")
    b = files.read_ratings_bundle(spark, str(tmp_path))
    assert rows(b["ratings"]) == [(1, 10, 5, 881250949), (2, 11, 3, 881250950)]
    (m,) = b["movies"].collect()
    assert m.title == "Café (1995)" and m.Western == 1 and m["Children's"] == 0 and len(m) == 24
    assert rows(b["users"]) == [(1, 24, "M", "technician", "85711")]
    with pytest.raises(ValueError):
        files.read_delimited(spark, "x.xlsx", "a int")


def test_ndjson(spark, tmp_path):
    p = tmp_path / "a.ndjson"
    p.write_text("\n".join(json.dumps({"mal_id": i, "title": f"t{i}"}) for i in range(20_000)) + "\n\n")
    assert files.read_ndjson(spark, str(p), "mal_id int, title string").count() == 20_000
    bad = tmp_path / "b.ndjson"
    bad.write_text('{"mal_id": 1}\n{"mal_id": \n')
    kept = files.read_ndjson(spark, str(bad), "mal_id int", strict=False).collect()
    assert [r[files.CORRUPT] is None for r in kept] == [True, False]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_ndjson(spark, str(bad), "mal_id int").collect()


def test_crawl_and_documents(spark, tmp_path):
    p = tmp_path / "c.ndjson"
    p.write_text('{"mal_id":3,"data":{"title":"T","genres":[{"name":"A"}],"score":8.5}}\n')
    (r,) = files.read_crawl(spark, str(p)).collect()
    assert (r.mal_id, r.title, r.score, r.genres[0].name) == (3, "T", "8.5", "A")
    a = tmp_path / "a.json"
    a.write_text('[{"id": 1},\n {"id": 2}]')
    assert rows(files.read_json_documents(spark, str(a), "id int")) == [(1,), (2,)]
    t = tmp_path / "t.json"
    t.write_text('{"_default": {"1": {"email": "a@x"}, "2": {"email": ""}, "3": {"name": "n"}}}')
    assert rows(files.read_document_store(spark, str(t), "email:string,name:string"), "email") == [("a@x",)]


def test_first_table_only(spark):
    html = "<table><tr><th>a</th></tr><tr><td>1 &amp; 2<table><tr><td>inner</td></tr></table></td></tr></table><table><tr><td>no</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id bigint, html string")
    got = rows(files.html_table_rows(df))
    assert [(p, n, c[0].split("<")[0][:5]) for p, n, c in got] == [(1, 0, "a"), (1, 1, "1 & 2")]


def test_digest_ignores_layout(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (2, None, 1.5)], "i int, s string, x double")
    base = rows(sinks.content_digest(df))
    assert base == rows(sinks.content_digest(df.repartition(3).select("x", "i", "s")))
    assert base != rows(sinks.content_digest(df.distinct()))
    assert base != rows(sinks.content_digest(spark.createDataFrame([(1, None, None), (2, "a", 1.5), (2, None, 1.5)], df.schema)))


def test_manifest(spark):
    m = spark.createDataFrame([(1.23456789, 3)], "a double, n int")
    (r,) = sinks.run_manifest(m, "run", {"k": 1}, "simulated", datetime(2026, 1, 1)).collect()
    assert json.loads(r.metrics) == {"a": 1.234568, "n": 3} and json.loads(r.params) == {"k": 1}
    with pytest.raises(ValueError):
        sinks.run_manifest(m, "run", {}, "made-up", datetime(2026, 1, 1))


def test_keyed_json(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (None, 3, "x")], "id int, seq int, v string")
    store = sinks.keyed_json(df, "movie", "id", "seq")
    (r,) = sinks.lookup_keyed(store, "movie", "1").collect()
    assert json.loads(r.value) == {"id": 1, "seq": 2, "v": "new"} and store.count() == 1


def test_points(spark):
    kind = "mal_id int, title string, genres array<string>, year int, score double, image_url string, synopsis string, vector array<float>, vi array<float>"
    df = spark.createDataFrame([(1, "T", ["A", "B"], 2000, 8.0, None, "x" * 2000, [1.0], [2.0])], kind)
    (r,) = sinks.vector_points(df, "vector", "vi").collect()
    assert r.payload.genres == "A, B" and len(r.payload.synopsis) == 2000 and r.vector_vi == [2.0]
    (r,) = sinks.vector_points(df, "vector", "vi", max_synopsis=1500).collect()
    assert len(r.payload.synopsis) == 1500


def feed(spark, files_):
    """Event files delivered in the given order, one per micro-batch."""
    import time

    folder = scratch_path(spark, "feed")
    kind = "event_id bigint, user_id bigint, ts timestamp, value double"
    for n, data in enumerate(files_):
        spark.createDataFrame(data, kind).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)


def at(h, m=0):
    return datetime(2026, 1, 1 + h // 24, h % 24, m)


def test_dedupe_across_batches(spark):
    s = feed(spark, [[(1, 1, at(0), 1.0), (2, 1, at(0, 5), 1.0)], [(1, 1, at(0), 1.0), (3, 1, at(0, 10), 1.0)]])
    assert rows(jobs.drain(jobs.dedupe_stream(s, ["event_id"], "ts"), "d"), "event_id") == [(1,), (2,), (3,)]


def test_late_rows_are_dropped(spark):
    s = feed(spark, [[(1, 1, at(0), 1.0), (2, 1, at(30), 1.0)], [(3, 1, at(31), 1.0)], [(4, 1, at(1), 1.0), (5, 1, at(40), 1.0)], [(6, 1, at(60), 1.0)]])
    got = sorted(rows(jobs.drain(jobs.freshness(s), "f"), "window_start", "n"))
    assert got == [(at(0), 1), (at(30), 2), (at(36), 1)]


def test_latest_over_batches(spark):
    s = feed(spark, [[(1, 1, at(5), 1.0), (2, 2, at(1), 2.0)], [(3, 1, at(2), 3.0), (4, 2, at(9), 4.0)]])
    assert rows(jobs.latest_features(s, ["user_id"], ["ts", "event_id"]), "user_id", "event_id") == [(1, 1), (2, 4)]


def test_gap_equals_batch(spark):
    data = [(i, i % 3, at(i // 4, i % 60), 0.0) for i in range(60)]
    s = feed(spark, [data[:20], data[20:45], data[45:]])
    got = rows(jobs.interaction_gaps(s), "event_id", "time_since_last")
    batch = spark.createDataFrame(data, "event_id bigint, user_id bigint, ts timestamp, value double")
    assert got == rows(interactions.interaction_gap(batch, ["user_id"], "ts", "event_id"), "event_id", "time_since_last")


def test_catalog_stream_equals_batch(spark):
    from shelfspark.operators import catalog

    folder = scratch_path(spark, "raw")

    def put(rows_):
        df = spark.createDataFrame([(i, "jikan", json.dumps(p), t, t) for i, p, t in rows_], schemas.RAW)
        df.coalesce(1).write.mode("append").json(folder)

    put([(1, {"title": "A", "score": "5"}, datetime(2026, 1, 1)), (2, {"title": "B"}, datetime(2026, 1, 1))])
    put([(1, {"title": "A2", "score": "6"}, datetime(2026, 1, 2)), (3, {}, datetime(2026, 1, 2))])
    out = jobs.ndjson_to_catalog(spark, folder)
    assert out.count() == 3 and {r.title for r in out.collect()} >= {"B", "Anime 3"}
    final = catalog.flatten_payload(spark.read.schema(schemas.RAW).json(folder).groupBy("mal_id").agg(
        F.max_by("source", "fetched_at").alias("source"), F.max_by("payload", "fetched_at").alias("payload")))
    assert rows(out.filter("mal_id <> 1"), "mal_id", "title") == rows(final.filter("mal_id <> 1"), "mal_id", "title")


def test_repeated_batch_changes_nothing(spark):
    """A run that dies inside a batch repeats it, whatever the dead run has left in the batch's folder."""
    kind = "id bigint, v string"
    folder, path, state = (scratch_path(spark, n) for n in ("in", "table", "state"))

    def put(data):
        spark.createDataFrame(data, kind).coalesce(1).write.mode("append").parquet(folder)

    def run(merge=lambda old, new: upserts.upsert(old, new, ["id"], ["v"])):
        stream = spark.readStream.schema(kind).parquet(folder)
        return jobs.drain_into(stream, path, stream.schema, merge, state)

    def dies(old, new):
        new.write.mode("overwrite").parquet(f"{path}/1")
        raise RuntimeError("lost")

    put([(1, "a"), (2, "a")])
    assert rows(run(), "id", "v") == [(1, "a"), (2, "a")]
    assert rows(run(), "id", "v") == [(1, "a"), (2, "a")]
    put([(2, "b"), (3, "b")])
    with pytest.raises(StreamingQueryException):
        run(dies)
    assert jobs.finished_batch(spark, state) == 0
    assert rows(run(), "id", "v") == [(1, "a"), (2, "b"), (3, "b")] and jobs.finished_batch(spark, state) == 1


def test_static_enrichment_keeps_unmatched(spark):
    s = feed(spark, [[(1, 1, at(0), 1.0), (2, 9, at(0), 1.0)]])
    static = spark.createDataFrame([(1, "one")], "user_id bigint, name string")
    assert rows(jobs.drain(jobs.enrich_stream(s, static, "user_id"), "e"), "event_id", "name") == [(1, "one"), (2, None)]


def test_gap_after_weeks_and_late_rows(spark):
    s = feed(spark, [[(1, 1, at(0), 0.0)], [(2, 1, at(24 * 21), 0.0)], [(3, 1, at(5), 0.0), (4, 1, at(24 * 21 + 1), 0.0)], [(5, 1, at(6), 0.0)]])
    got = rows(jobs.interaction_gaps(s), "event_id", "time_since_last")
    assert got == [(1, None), (2, 1_814_400.0), (3, None), (4, 3600.0), (5, None)]


def test_streams_go_on_where_they_stopped(spark):
    folder, out, state = (scratch_path(spark, n) for n in ("grow", "grow-out", "grow-state"))
    kind = "event_id bigint, user_id bigint, ts timestamp, value double"

    def put(data):
        spark.createDataFrame(data, kind).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return spark.readStream.schema(kind).parquet(folder)

    put([(1, 1, at(0), 1.0), (2, 2, at(1), 1.0)])
    assert jobs.drain(stream(), "x", out=out, state=state).count() == 2
    put([(3, 1, at(2), 1.0)])
    assert rows(jobs.drain(stream(), "x", out=out, state=state), "event_id") == [(1,), (2,), (3,)]
    path, mark = scratch_path(spark, "latest"), scratch_path(spark, "latest-state")
    for want in (2, 3):
        got = jobs.latest_features(stream(), ["user_id"], ["ts", "event_id"], path=path, state=mark)
        assert rows(got, "user_id", "event_id") == [(1, max(3, want)), (2, 2)] if want == 3 else got.count() == 2


def test_gaps_forget_idle_users(spark):
    day = 24
    s = feed(spark, [[(1, 1, at(0), 0.0), (2, 2, at(1), 0.0)], [(3, 2, at(5 * day), 0.0)], [(4, 1, at(5 * day + 1), 0.0), (5, 2, at(5 * day + 2), 0.0)]])
    assert rows(jobs.interaction_gaps(s, idle_seconds=3 * 86_400), "event_id", "time_since_last") == [(1, None), (2, None), (3, 428_400.0), (4, None), (5, 7200.0)]


def test_gaps_go_on_and_hold_a_busy_user(spark):
    """One user has nearly all rows of a batch: the window is cut into chunks, nothing is gathered in Python."""
    folder, path, state = (scratch_path(spark, n) for n in ("busy", "busy-out", "busy-state"))
    kind = "event_id bigint, user_id bigint, ts timestamp, value double"

    def put(low, high):
        second = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
        part = spark.range(low, high).select(F.col("id").alias("event_id"), F.when(F.col("id") % 1000 == 7, 2).otherwise(1).cast("long").alias("user_id"), second.alias("ts"), F.lit(0.0).alias("value"))
        part.write.mode("append").parquet(folder)

    for low, high in ((0, 200_000), (200_000, 1_200_000)):
        put(low, high)
        stream = spark.readStream.schema(kind).parquet(folder)
        out = jobs.interaction_gaps(stream, path=path, state=state, max_rows=100_000)
    assert out.count() == 1_200_000
    counts = {(r["user_id"], r["time_since_last"]): r["count"] for r in out.groupBy("user_id", "time_since_last").count().collect()}
    assert counts == {(1, None): 1, (1, 1.0): 1_200_000 - 1200 - 1201, (1, 2.0): 1200, (2, None): 1, (2, 1000.0): 1199}
