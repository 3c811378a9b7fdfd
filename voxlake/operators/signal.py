"""Signals as long tables (series_id, idx, value), and vectors of speakers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .sequence import merge_segments, select_budget


def window_features(df: DataFrame, w: int, s: int, shard_rows: int = scan.ROWS) -> DataFrame:
    """RMS and zero-crossing rate of windows of `w` samples every `s`; as in `range(0, n - w, s)` the last exact fit is left out.

    Each sample goes to the windows that hold it (w / s of them), so a long series is spread by window; the sign before a sample comes by shards.
    """
    n = df.groupBy("series_id").agg((F.max("idx") + 1).alias("n"))
    sign = F.when(F.col("value") > 0, 1).when(F.col("value") < 0, -1).otherwise(0)
    df = scan.shards(df.withColumn("sign", sign), "series_id", ["idx"], shard_rows)
    df = scan.neighbour(df, "series_id", ["idx"], "sign", "_last").withColumn("turn", F.abs(F.col("sign") - F.col("_last.v"))).drop("_shard", "_last")
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - w + 1) / F.lit(s))).cast("long")
    df = df.withColumn("k", F.explode(F.sequence(first, F.floor(F.col("idx") / s).cast("long")))).withColumn("start", F.col("k") * s)
    df = df.join(n, "series_id").filter(F.col("start") < F.col("n") - w)
    turn = F.when(F.col("idx") > F.col("start"), F.col("turn")).otherwise(0)
    return df.groupBy("series_id", "start").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), (F.sum(turn) / (2 * w)).alias("zcr"))


def gate(df: DataFrame, rms: float = 0.005, zcr: float = 0.3) -> DataFrame:
    return df.filter((F.col("rms") >= rms) & (F.col("zcr") <= zcr))


def trim_tail(df: DataFrame, frame: int, keep: int) -> DataFrame:
    """Samples up to `keep` after the last frame of at least 5 % of the mean of the loudest quarter; under 3 frames unchanged."""
    count = df.groupBy("series_id").agg(F.floor((F.max("idx") + 1) / frame).cast("long").alias("frames"))
    f = df.withColumn("f", F.floor(F.col("idx") / frame).cast("long")).join(count, "series_id").filter("f < frames")
    f = f.groupBy("series_id", "frames", "f").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("e"))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("e"), "f"))
    top = f.withColumn("r", rank).filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("frames") / 4)))
    limit = top.groupBy("series_id").agg((F.avg("e") * 0.05).alias("limit"))
    last = f.join(limit, "series_id").filter("e >= limit").groupBy("series_id", "frames").agg(F.max("f").alias("last"))
    stop = last.select("series_id", F.when(F.col("frames") >= 3, (F.col("last") + 1) * frame + keep).alias("stop"))
    return df.join(stop, "series_id", "left").filter(F.col("stop").isNull() | (F.col("idx") < F.col("stop"))).drop("stop")


def normalize_peak(df: DataFrame, peak: float = 0.7) -> DataFrame:
    """Without the mean, scaled to a peak; a silent series stays at zero."""
    m = df.groupBy("series_id").agg(F.avg("value").alias("mean"), F.max("value").alias("high"), F.min("value").alias("low"))
    top = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))
    return df.join(m, "series_id").select("series_id", "idx", F.when(top > 0, (F.col("value") - F.col("mean")) / top * peak).otherwise(0.0).alias("value"))


def resample_linear(df: DataFrame, semitones: float, shard_rows: int = scan.ROWS) -> DataFrame:
    """Linear interpolation to int(n * 2 ** (-p / 12)) points over the same span.

    Each sample makes the points between it and the next one, so no grid is built and joined; the next sample comes by shards.
    """
    factor = 2 ** (-semitones / 12)
    n = df.groupBy("series_id").agg((F.max("idx") + 1).alias("n")).withColumn("m", (F.col("n") * factor).cast("long")).filter("m > 0")
    n = n.withColumn("step", F.when(F.col("m") > 1, (F.col("n") - 1) / (F.col("m") - 1)).otherwise(0.0))
    df = scan.neighbour(scan.shards(df, "series_id", ["idx"], shard_rows), "series_id", ["idx"], "value", "_next", 1).join(n, "series_id")
    # some points around those of the sample, then exactly its own
    low = F.when(F.col("step") > 0, F.greatest(F.lit(0), F.floor(F.col("idx") / F.col("step")) - 1)).otherwise(0).cast("long")
    high = F.when(F.col("step") > 0, F.least(F.col("m") - 1, F.ceil((F.col("idx") + 1) / F.col("step")) + 1)).otherwise(F.col("m") - 1).cast("long")
    df = df.withColumn("out", F.explode(F.when(low <= high, F.sequence(low, high)))).withColumn("x", F.col("out") * F.col("step"))
    df = df.filter(F.least(F.floor("x"), F.col("n") - 1) == F.col("idx"))
    value, nxt = F.col("value"), F.when(F.col("_next").isNull(), F.col("value")).otherwise(F.coalesce("_next.v", "value"))
    return df.select("series_id", F.col("out").alias("idx"), (value + (nxt - value) * (F.col("x") - F.col("idx"))).alias("value"))


def _silhouette(d: np.ndarray, label: np.ndarray) -> float:
    own = label[:, None] == label[None, :]
    size = own.sum(1)
    a = (d * own).sum(1) / np.maximum(size - 1, 1)
    b = np.full(len(label), np.inf)
    for k in np.unique(label):
        other = label == k
        b = np.where(other, b, np.minimum(b, d[:, other].mean(1)))
    return float(np.where(size > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def _dendrogram(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (height, member of one cluster, member of the other) of average linkage, lowest first, by chains of nearest neighbours."""
    n = len(d)
    gap, size, active, chain, merges = d + np.diag(np.full(n, np.inf)), np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(active.argmax()))
        while True:
            i = chain[-1]
            row = np.where(active, gap[i], np.inf)
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                break
            chain.append(j)
        i, j = sorted((chain.pop(), chain.pop()))
        merges.append((float(gap[i, j]), i, j))
        merged = (gap[i] * size[i] + gap[j] * size[j]) / (size[i] + size[j])
        gap[i], gap[:, i] = merged, merged
        gap[i, i], active[j] = np.inf, False
        size[i] += size[j]
    return sorted(merges, key=lambda m: m[0])


def _cut(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of the k clusters that the lowest merges leave, in order of their first members."""
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for _, i, j in merges[: n - k]:
        i, j = sorted((find(i), find(j)))
        top[j] = i
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def cluster(df: DataFrame, group: str, key: str, vector: str, k: int | None = None) -> DataFrame:
    """Cluster label of each vector within its group by average linkage of cosine distances.

    Without k, that from 2 to min(5, n - 1) with the best silhouette, the first of equal ones; two vectors are two speakers, one is one. The
    dendrogram is made once. The cost is quadratic in a group, so groups are bounded things such as the segments of one recording; `cluster_many` serves a whole table.
    """
    kind = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = np.clip(1 - x @ x.T, 0, 2)
        np.fill_diagonal(d, 0)
        label = np.zeros(len(x), int)
        if len(x) >= 2:
            ks = [min(k, len(x))] if k else range(2, max(2, min(5, len(x) - 1)) + 1)
            merges = _dendrogram(d)
            label = max(((_silhouette(d, y), y) for y in (_cut(merges, len(x), i) for i in ks)), key=lambda t: t[0])[1]
        return pd.DataFrame({group: pdf[group], key: pdf[key], "label": [f"speaker {i + 1}" for i in label]})

    return df.select(group, key, vector).groupBy(group).applyInPandas(one, f"{group} {kind[group]}, {key} {kind[key]}, label string")


def cluster_many(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Clusters of a table of any size by k-means on the sphere: an approximation of `cluster`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=1, distanceMeasure="cosine").fit(x)
    return model.transform(x).select(key, F.col("prediction").alias("label"))


def speaker_report(segments: DataFrame, recording: str | None = None) -> DataFrame:
    """One row a speaker: its number among those of its recording (or of all), merged segments by start, those within the budget longest first, totals and quality.

    `segment_count` counts the segments within the budget; a cut segment's end has three decimals.
    """
    names = segments.select(*([recording] if recording else []), "speaker").distinct()
    place = F.row_number().over(Window.partitionBy(recording).orderBy("speaker")) if recording else None
    names = names.withColumn("_i", place) if recording else _ranked(names)
    merged = merge_segments(segments)
    chosen = select_budget(merged)
    every = merged.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("all_segments"), F.round(F.sum(F.col("end") - F.col("start")), 2).alias("total_duration"))
    end = F.when(F.col("taken") < F.col("end") - F.col("start"), F.round(F.col("start") + F.col("taken"), 3)).otherwise(F.col("end"))
    used = chosen.select("speaker", "taken", F.struct((F.col("start") - F.col("end")).alias("short"), "start", end.alias("end")).alias("s"))
    used = used.groupBy("speaker").agg(F.array_sort(F.collect_list("s")).alias("s"), F.sum("taken").alias("taken"), F.count("*").alias("segment_count"))
    used = used.select("speaker", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("segments"), "taken", "segment_count")
    df = every.join(used, "speaker", "left").join(names, "speaker")
    none = F.array().cast("array<struct<start:double,end:double>>")
    return df.select(
        *([recording] if recording else []), "speaker", F.concat(F.lit("speaker "), F.col("_i").cast("string")).alias("label"), F.coalesce("segments", none).alias("segments"), "all_segments", "total_duration",
        F.round(F.coalesce("taken", F.lit(0.0)), 2).alias("tts_duration"), F.coalesce("segment_count", F.lit(0)).alias("segment_count"), F.when(F.col("taken") >= 30, "good").otherwise("short").alias("quality"),
    )


def _ranked(names: DataFrame) -> DataFrame:
    """Names numbered in order, without one task for all: by range partitions and the counts before them."""
    rows = names.repartitionByRange("speaker").sortWithinPartitions("speaker").withColumn("_m", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_m", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("_part", before.alias("_before")), "_part").select("speaker", (F.col("_before") + (F.col("_m") - F.shiftleft("_part", 33)) + 1).alias("_i"))


def diarized_report(segments: DataFrame, recording: str, key: str, vector: str) -> DataFrame:
    """The report of speakers that are told apart by clustering the segments' vectors within each recording."""
    labels = cluster(segments, recording, key, vector)
    named = segments.join(labels, [recording, key]).withColumn("speaker", F.concat_ws(" ", F.col(recording).cast("string"), "label"))
    return speaker_report(named.select(recording, "speaker", "start", "end", "energy"), recording)
