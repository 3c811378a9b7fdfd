"""Scans of hot keys by shards, and pages by bounds and cursors, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from voxlake.operators import scan, sequence, signal


def islands(rows):
    out, groups = [], {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1:])):
        groups.setdefault(r[0], []).append(r[1:])
    for k, part in groups.items():
        found, last = [], None
        for start, end, energy in part:
            if last is None or start - last >= 1.0:
                found.append([start, end, energy, 1])
            else:
                found[-1] = [found[-1][0], end, (found[-1][2] + energy) / 2, found[-1][3] + 1]
            last = end
        out += [(str(k), i + 1, *f) for i, f in enumerate(found)]
    return out


@pytest.mark.parametrize("size", [25, 10**6])
def test_islands_by_shards(spark, size):
    rng = random.Random(2)
    rows = []
    for k, n, spread in (("hot", 400, 2.0), ("dense", 150, 0.2), (None, 90, 2.5), ("one", 1, 1.0)):
        at = 0.0
        for _ in range(n):
            at += rng.choice([0.0, 0.25, 0.5, spread])
            rows.append((k, at, at + rng.choice([0.0, 0.25, 1.5]), float(rng.randrange(100))))
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame(rows, "speaker string, start double, end double, energy double")
    got = sorted((str(r["speaker"]), r["island"], r["start"], r["end"], r["energy"], r["n"]) for r in sequence.merge_segments(df, shard_rows=size).collect())
    want = sorted(islands(rows))
    assert [(*g[:4], g[5]) for g in got] == [(*w[:4], w[5]) for w in want]
    assert all(g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-9) for g, w in zip(got, want, strict=True))


def test_island_with_unknown_energy_and_empty_table(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, None), ("a", 1.5, 2.0, 3.0), ("a", 9.0, 9.5, 4.0)], "speaker string, start double, end double, energy double")
    assert [(r["n"], r["energy"]) for r in sequence.merge_segments(df).orderBy("island").collect()] == [(2, None), (1, 4.0)]
    assert sequence.merge_segments(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [9, 10**6])
def test_sums_and_neighbours_by_shards(spark, size):
    rng = random.Random(3)
    rows = [(k, i, float(rng.randrange(50)) / 4) for k, n in (("a", 130), ("b", 40), (None, 20), ("c", 1)) for i in rng.sample(range(10**6), n)]
    df = spark.createDataFrame(rows, "key string, i long, dur double")
    made = {r["i"]: r["offset"] for r in sequence.assemble_timeline(df, "key", "i", 0.5, size).collect()}
    cut = scan.shards(df, "key", ["i"], size)
    before = {r["i"]: r["x"] for r in scan.neighbour(cut, "key", ["i"], "dur", "x").collect()}
    after = {r["i"]: r["x"] for r in scan.neighbour(cut, "key", ["i"], "dur", "x", 1, False).collect()}
    for k in ("a", "b", None, "c"):
        own = sorted(r[1:] for r in rows if r[0] == k)
        total = 0.0
        for n, (i, dur) in enumerate(own):
            assert made[i] == total
            total += dur + 0.5
            assert (before[i].v if before[i] else None) == (own[n - 1][1] if n else None)
            assert (after[i].v if after[i] else None) == (own[n + 1][1] if n + 1 < len(own) else None)


@pytest.mark.parametrize("size", [4, 10**6])
def test_previews_and_signals_by_shards(spark, size):
    rng = random.Random(4)
    seg = [(k, float(i), float(i) + rng.choice([0.5, 1.25, 12.0, 2.0])) for k in ("a", "b") for i in range(30)]
    df = spark.createDataFrame(seg, "speaker string, start double, end double")
    got = sorted((r["speaker"], r["start"], r["taken"]) for r in sequence.select_preview(df, shard_rows=size).collect())
    want = []
    for k in ("a", "b"):
        left = 10.0
        for n, (_, s, e) in enumerate(x for x in sorted(seg) if x[0] == k):
            if e - s <= left:
                want.append((k, s, e - s))
                left -= e - s
                continue
            if left > 0 and (left > 1.0 or n == 0):
                want.append((k, s, left))
            break
    assert got == want
    series = spark.createDataFrame([(s, i, float(rng.randrange(-9, 10))) for s, n in ((1, 70), (2, 9), (3, 1)) for i in range(n)], "series_id long, idx long, value double")
    whole = sorted(map(tuple, signal.window_features(series, 8, 3).collect()))
    assert sorted(map(tuple, signal.window_features(series, 8, 3, size).collect())) == whole and len(whole) > 10
    x = {s: [r["value"] for r in series.filter(F.col("series_id") == s).orderBy("idx").collect()] for s in (1, 2, 3)}
    for p in (-12, 3):
        made = sorted(map(tuple, signal.resample_linear(series, p, size).collect()))
        want = []
        for s, values in x.items():
            n, m = len(values), int(len(values) * 2 ** (-p / 12))
            for o in range(m):
                at = o * ((n - 1) / (m - 1)) if m > 1 else 0.0
                i = min(int(at), n - 1)
                want.append((s, o, values[i] + (values[min(i + 1, n - 1)] - values[i]) * (at - i)))
        assert [m[:2] for m in made] == [w[:2] for w in want]
        assert all(m[2] == pytest.approx(w[2], abs=1e-9) for m, w in zip(made, want, strict=True))


def test_a_million_segments_of_one_speaker(spark):
    """The speaker is dealt by range, no shard holds much more than its share, and the islands are all there."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("s").alias("speaker"), (F.col("id") * 1.0 + F.floor(F.col("id") / 1000) * 5).alias("start"), F.lit(1.0).alias("energy"))
    df = df.withColumn("end", F.col("start") + 0.5)
    sizes = [r["count"] for r in scan.shards(df, "speaker", ["start"], 50_000).groupBy("_shard").count().collect()]
    assert sum(sizes) == n and len(sizes) == 20 and max(sizes) < 100_000
    got = sequence.merge_segments(df, shard_rows=50_000).agg(F.count("*"), F.sum("n"), F.min("energy"), F.max("energy")).first()
    assert tuple(got) == (1000, n, 1.0, 1.0)


def test_deep_pages(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, None if i % 9 == 0 else rng.randrange(60)) for i in range(500)]
    spark.createDataFrame([*rows, (None, 3)], "id long, at long").repartitionByRange(6, "at").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=True)
    for ranges in (1, 7, 200):
        index = sequence.PageIndex(df, "at", "id", ranges)
        for no in (1, 2, 13, 35, 36, 40):
            assert [tuple(r) for r in index.page(no, 13).select("id", "at").collect()] == want[(no - 1) * 13 : no * 13]
    cursor, seen = None, []
    while True:
        part = [tuple(r) for r in sequence.page_after(df, "at", "id", 61, cursor).select("id", "at").collect()]
        if not part:
            break
        seen += part
        cursor = (part[-1][1], part[-1][0])
    assert seen == want
    assert sequence.PageIndex(df.limit(0), "at", "id").page(1, 5).count() == 0
