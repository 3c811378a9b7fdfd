import datetime
import json
import random
import time

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.operators import maintenance, relational, sequence, signal
from voxlake.sources import tables
from voxlake.streaming import running


def test_files(spark, tmp_path):
    for name, at in (("a_model", "2024-01-01"), ("b_model", "2024-02-01")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(json.dumps({"voice_name": name, "created_at": at}))
    assert [r["folder"] for r in tables.read_catalog(spark, str(tmp_path)).collect()] == ["b_model", "a_model"]
    assert tables.read_sections(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text(json.dumps([{"pdf": "p", "week": 1, "start_page": 2, "end_page": 3}]))
    assert tables.read_sections(spark, str(tmp_path / "s.json")).first()["end_page"] == 3
    (tmp_path / "d.json").write_text(json.dumps({"word": {"a": "1"}, "syllable": {"b": "2"}}))
    assert {tuple(r) for r in tables.read_dictionary(spark, str(tmp_path / "d.json")).collect()} == {("word", "a", "1"), ("syllable", "b", "2")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-02 03:04:05")], "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    tables.write_by_day(df, str(tmp_path / "days"), "ts")
    assert (tmp_path / "days" / "day=20240102").is_dir()
    for _ in range(2):
        tables.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    rows = spark.range(4000).withColumn("d", F.lit(0.5))
    train, test, total = tables.train_eval_split(rows, "id", "d")
    assert train.count() + test.count() == 4000 and total == 2000.0 and 500 < test.count() < 700
    out = tables.conform(spark.range(1), T.StructType([T.StructField("name", T.StringType()), T.StructField("id", T.LongType())]), {"name": "x"})
    assert out.columns == ["name", "id"] and tuple(out.first()) == ("x", 0)


def test_merge_and_budget(spark):
    df = spark.createDataFrame([("a", 0.0, 2.0, 1.0), ("a", 2.5, 4.0, 3.0), ("a", 5.0, 6.0, 9.0)], "speaker string, start double, end double, energy double")
    got = sorted(tuple(r) for r in sequence.merge_segments(df).collect())
    assert got == [("a", 1, 0.0, 4.0, 2.0, 2), ("a", 2, 5.0, 6.0, 9.0, 1)]
    big = spark.createDataFrame([("a", float(i * 100), float(i * 100 + 40)) for i in range(4)], "speaker string, start double, end double")
    taken = [r["taken"] for r in sequence.select_budget(big).orderBy("start").collect()]
    assert taken == [40.0, 40.0, 10.0]
    assert [r["taken"] for r in sequence.select_preview(big).collect()] == [10.0]


def test_upsert_twice_changes_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    ch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, s string, at int")
    once = maintenance.upsert(base, ch, ["k"], ["s"], "at")
    twice = maintenance.upsert(once, ch, ["k"], ["s"], "at")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_clusters(spark):
    rows = [(0, i, [1.0, 0.01 * i]) for i in range(4)] + [(0, 9 + i, [0.01 * i, 1.0]) for i in range(4)] + [(1, 50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "g int, k int, v array<double>")
    got = {r["k"]: r["label"] for r in signal.cluster(df, "g", "k", "v").collect()}
    assert len({got[i] for i in range(4)}) == 1 and len({got[9 + i] for i in range(4)}) == 1 and got[0] != got[9] and got[50] == "speaker 1"


def test_clusters_of_few(spark):
    """One vector is one speaker, two are two, ties go to the first; a large group is quick and equals merging the nearest pair each time."""
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 1, [0.9, 0.1])] + [(3, i, v) for i, v in enumerate(([1.0, 0.0], [1.0, 0.0], [0.0, 1.0]))]
    got = {(r["g"], r["k"]): r["label"] for r in signal.cluster(spark.createDataFrame(rows, "g int, k int, v array<double>"), "g", "k", "v").collect()}
    assert got == {(1, 0): "speaker 1", (2, 0): "speaker 1", (2, 1): "speaker 2", (3, 0): "speaker 1", (3, 1): "speaker 1", (3, 2): "speaker 2"}
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    groups = [[i] for i in range(60)]
    while len(groups) > 4:
        gap = {(i, j): d[np.ix_(groups[i], groups[j])].mean() for i in range(len(groups)) for j in range(i)}
        i, j = min(gap, key=gap.get)
        groups[j] += groups.pop(i)
    label = signal._cut(signal._dendrogram(d), 60, 4)
    assert sorted(map(sorted, groups)) == sorted(np.flatnonzero(label == k).tolist() for k in range(4))
    x = rng.normal(size=(2000, 8))
    began = time.perf_counter()
    signal._dendrogram(np.linalg.norm(x[:, None] - x[None], axis=2))
    assert time.perf_counter() - began < 30


def test_speaker_report(spark):
    rows = [("b", 0.0, 50.0, 1.0), ("b", 60.0, 110.0, 1.0), ("b", 200.0, 203.0, 1.0), ("a", 0.0, 10.0, 1.0), ("a", 20.0, 24.0, 1.0), ("c", 0.0, 1.0, 1.0)]
    for recording in (None, "rec"):
        df = spark.createDataFrame([(*r, 1) for r in rows], "speaker string, start double, end double, energy double, rec int")
        got = {r["speaker"]: r for r in signal.speaker_report(df, recording).collect()}
        assert {k: (r["label"], r["segment_count"], r["total_duration"], r["tts_duration"], r["quality"]) for k, r in got.items()} == {"a": ("speaker 1", 2, 14.0, 14.0, "short"), "b": ("speaker 2", 2, 103.0, 90.0, "good"), "c": ("speaker 3", 0, 1.0, 0.0, "short")}
        assert [tuple(s) for s in got["b"]["segments"]] == [(0.0, 50.0), (60.0, 100.0)] and [tuple(s) for s in got["a"]["segments"]] == [(0.0, 10.0), (20.0, 24.0)]
        assert [tuple(s) for s in got["b"]["all_segments"]] == [(0.0, 50.0), (60.0, 110.0), (200.0, 203.0)] and got["c"]["segments"] == []


def test_streams_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (1, -1), (2, 1)], "checkpoint_id int, score int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running.running_feedback(stream).writeStream.outputMode("complete").format("memory").queryName("fb").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("fb").collect())) == [(1, 0.0, 2), (2, 1.0, 1)]
    path = f"file://{tmp_path}/out"
    for _ in range(2):
        ch = stream.withColumn("at", F.col("score"))
        q = running.upsert_sink(ch, path, ["checkpoint_id"], "at").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
        q.awaitTermination()
    assert sorted(map(tuple, running.read_versions(spark, path).select("checkpoint_id", "score").collect())) == [(1, 1), (2, 1)]
    rec = spark.createDataFrame([(1, 50, "2024-01-01 16:00:00"), (1, 70, "2024-01-01 14:00:00")], "user_id int, score int, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    rec.write.parquet(str(tmp_path / "rec"))
    s = spark.readStream.schema(rec.schema).parquet(str(tmp_path / "rec"))
    q = running.running_days(s).writeStream.outputMode("update").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    assert sorted((str(r["day"]), r["n"]) for r in spark.table("days").collect()) == [("2024-01-01", 1), ("2024-01-02", 1)]


def test_late_attempts_are_left_out_and_told(spark, tmp_path):
    """A day goes out once, when the watermark has passed it; what comes later is dropped and counted."""
    kind = "user_id int, score int, at string"
    loads = [[(1, 10, "2024-01-01 01:00:00"), (1, 20, "2024-01-01 02:00:00"), (2, 5, "2024-01-05 01:00:00")], [(1, 99, "2024-01-01 03:00:00"), (2, 7, "2024-01-05 02:00:00"), (2, 9, "2024-01-09 01:00:00")]]
    for i, rows in enumerate(loads):
        part = spark.createDataFrame(rows, kind).select("user_id", "score", F.to_timestamp_ntz("at").alias("created_at"))
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        out = running.running_days(stream, "1 day").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
        out.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    got = running.late_attempts(spark.read.parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "out")))
    assert sorted((r["user_id"], str(r["day"]), r["n"], r["avg_score"], r["max_score"], r["late"]) for r in got.collect()) == [(1, "2024-01-01", 2, 15.0, 20, 1), (2, "2024-01-05", 2, 6.0, 7, 0)]


def test_dashboard_of_a_hot_day(spark):
    """One user's day with most rows, ties in time, a record without a time, a user with cards alone: as told by a plain version."""
    rng = random.Random(9)
    at = lambda day, s: datetime.datetime(2024, 1, day, 3) + datetime.timedelta(seconds=s)
    rows = [(1, i, rng.randrange(5), rng.randrange(-1, 9), at(9, rng.randrange(40))) for i in range(300)] + [(1, 300 + i, 1, 4, at(1 + i % 8, i)) for i in range(12)] + [(2, 900, 3, None, None), (2, 901, 77, 0, at(3, 1))]
    rec = spark.createDataFrame([(*r, False) for r in rows], "user_id long, id long, card_id long, score int, created_at timestamp_ntz, is_starred boolean")
    cards = spark.createDataFrame([(i, f"c{i}", "own", u) for i, u in enumerate([1, 1, 3, None, 2])] + [(9, "c9", "textbook", 1)], "id long, chinese string, category string, user_id long")
    for salts in (1, 5, 64):
        got = {r["user_id"]: r for r in relational.dashboard(rec, cards, "2024-01-09 05:00:00", 3, 4, salts).collect()}
        assert set(got) == {1, 2, 3} and got[3]["recent"] is None and [got[u]["total_cards"] for u in (1, 2, 3)] == [3, 2, 2]
        for u in (1, 2):
            own = sorted((r for r in rows if r[0] == u), key=lambda r: (r[4] is not None, r[4] or at(1, 0), r[1]), reverse=True)
            assert [(a["id"], a["created_at"], a["chinese"]) for a in got[u]["recent"]] == [(r[1], r[4], f"c{r[2]}" if r[2] < 5 else None) for r in own[:4]]
            assert got[u]["attempts"] == len(own) and got[u]["today"] == sum(r[4] is not None and r[4].day == 9 for r in own)
            days = sorted({r[4].date() for r in own if r[4]}, reverse=True)[:3]
            assert [(d["day"], d["n"]) for d in got[u]["daily"]][: len(days)] == [(d, sum(r[4] is not None and r[4].date() == d for r in own)) for d in days]
