"""Ordered scans within keys of which one may hold any share of the rows.

A key of at most `rows` rows is one window group. The others are dealt by range into shards of about `rows` rows (never more than
`SHARDS` of them in all, so the limit is on tasks, not on data): each shard is scanned for itself, hands one value on to the next shard
of its key, and a second pass adds what it was handed. Only the first (or last) key of a shard goes on in another one, so
what is handed on is at most a row a shard. Shards are a written table, so that every pass sees the same bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.sources.tables import new_folder

ROWS = 1_000_000
SHARDS = 10_000


def _ranges(df: DataFrame, n: int, rows: int, *order: str | Column) -> DataFrame:
    """`df` written in about n / rows ranges, with the range of each row as `_shard`."""
    path = new_folder(df.sparkSession, "shards")
    parts = df.repartitionByRange(max(1, min(SHARDS, -(-n // rows))), *order)
    parts.withColumn("_shard", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shards(df: DataFrame, key: str, order: list[str], rows: int = ROWS) -> DataFrame:
    """`df` with `_shard`: -1 where the key is whole, else the place of the row's range. A null key is a key; rows alike in `order` stay together."""
    sizes = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    n = sizes.agg(F.sum("_n")).first()[0]
    if not n:
        return df.withColumn("_shard", F.lit(-1))
    flagged = df.join(sizes.select("_k", F.lit(True).alias("_hot")), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    hot = _ranges(flagged.filter("_hot").drop("_hot"), n, rows, key, *order)
    return flagged.filter("_hot is null").drop("_hot").withColumn("_shard", F.lit(-1)).unionByName(hot)


def _handed(df: DataFrame, key: str, summary: Column, carry, small: bool) -> DataFrame:
    """`df` with `_c`: what the other shards of a key hand to this one, null if nothing."""
    parts = df.filter("_shard >= 0").groupBy(key, "_shard").agg(summary.alias("_s"))
    got = parts.select(F.col(key).alias("_ck"), F.col("_shard").alias("_cs"), carry(F.col("_s"), Window.partitionBy(key).orderBy("_shard")).alias("_c"))
    got = got.filter("_c is not null")
    on = F.col(key).eqNullSafe(F.col("_ck")) & (F.col("_shard") == F.col("_cs"))
    return df.join(F.broadcast(got) if small else got, on, "left").drop("_ck", "_cs")


def prior_sum(df: DataFrame, key: str, order: list[str | Column], value: Column, out: str) -> DataFrame:
    """Sharded `df` with the sum of `value` (never null) over the rows of the key before this one; null at its first row."""
    own = F.sum(value).over(Window.partitionBy(key, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    before = lambda s, w: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = _handed(df.withColumn(out, own), key, F.sum(value), before, True)
    return df.withColumn(out, F.when(F.col(out).isNull(), F.col("_c")).otherwise(F.col(out) + F.coalesce("_c", F.lit(0)))).drop("_c")


def neighbour(df: DataFrame, key: str, order: list[str], value: str, out: str, step: int = -1, small: bool = True) -> DataFrame:
    """Sharded `df` with struct(v: `value`) of the row before (`step` -1) or after it (1) in ascending order as `out`; null where there is none.

    `small` tells that `value` has a fixed size, so that a value a shard may be broadcast.
    """
    look = F.lag if step < 0 else F.lead
    place, box = F.struct(*order), F.struct(F.col(value).alias("v"))
    edge = F.max_by(box, place) if step < 0 else F.min_by(box, place)
    own = look(box).over(Window.partitionBy(key, "_shard").orderBy(*order))
    df = _handed(df.withColumn(out, own), key, edge, lambda s, w: look(s).over(w), small)
    return df.withColumn(out, F.coalesce(out, "_c")).drop("_c")


def numbered(df: DataFrame, order: list[str | Column], out: str, rows: int = ROWS) -> DataFrame:
    """`df` numbered from 1 in `order`: each range alone, moved by the rows of the ranges before it."""
    n = df.count()
    parts = _ranges(df, n, rows, *order) if n > rows else df.withColumn("_shard", F.lit(0))
    counts = parts.groupBy("_shard").agg(F.count("*").alias("_n"))  # a row a range
    before = F.sum("_n").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_shard", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_shard").orderBy(*order))
    return parts.withColumn(out, own).join(F.broadcast(counts), "_shard").withColumn(out, F.col(out) + F.col("_before")).drop("_shard", "_before")
