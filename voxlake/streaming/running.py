"""Running statistics as Structured Streaming queries; the semantics are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from voxlake.operators.maintenance import upsert


def running_feedback(feedback: DataFrame) -> DataFrame:
    """Mean and count per checkpoint, kept as state; write it in update or complete mode."""
    return feedback.filter("checkpoint_id <> 0").groupBy("checkpoint_id").agg(F.avg("score").alias("avg_score"), F.count("*").alias("n"))


def running_days(records: DataFrame, late: str = "2 days") -> DataFrame:
    """Statistics of each user and day at +09:00 as attempts arrive; a day is final when the watermark has passed it."""
    w = F.window("created_at", "1 day", startTime="15 hours")
    df = records.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    df = df.groupBy("user_id", w).agg(F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("avg_score"), F.max("score").alias("max_score"))
    return df.select("user_id", F.to_date(F.col("window.start") + F.expr("INTERVAL 9 HOURS")).alias("day"), "n", "avg_score", "max_score")


def late_attempts(records: DataFrame, days: DataFrame) -> DataFrame:
    """`days` as an append sink holds them, with `late`: the attempts of `records` on that day that came after the watermark and are not in it."""
    day = F.to_date(F.col("created_at").cast("timestamp") + F.expr("INTERVAL 9 HOURS"))
    seen = records.groupBy("user_id", day.alias("day")).agg(F.count("*").alias("_seen"))
    return days.join(seen, ["user_id", "day"]).withColumn("late", F.col("_seen") - F.col("n")).drop("_seen")


def upsert_sink(changes: DataFrame, path: str, keys: list[str], order: str, buckets: int = 32) -> DataStreamWriter:
    """Keeps the last change of each key in a table under `path`; a batch that is played again changes nothing.

    Rows are dealt to `buckets` by their key. A batch writes the buckets that it touches, as a version named by the batch; the
    others stay as they are. Spark marks a version as done when all of it is written, and only such are read.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
        if touched:
            old = read_versions(batch.sparkSession, path, number, touched)
            base = batch.limit(0) if old is None else old
            cols = [c for c in batch.columns if c not in keys]
            new = upsert(base.select(*batch.columns), batch, keys, cols, order)
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
            _drop_old(batch.sparkSession, path, number)
        batch.unpersist()

    return changes.writeStream.foreachBatch(put)


def _folders(spark: SparkSession, path: str, prefix: str):
    """The Hadoop file system, and the folders `prefix=number` under a path by number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(folder) if fs.exists(folder) else []
    paths = {s.getPath().getName(): s.getPath() for s in found}
    return fs, {int(n.split("=")[1]): p for n, p in paths.items() if n.startswith(f"{prefix}=")}


def _versions(spark: SparkSession, path: str, before: int | None) -> dict[int, list[int]]:
    """For each bucket the finished versions that hold it, newest first."""
    fs, versions = _folders(spark, path, "version")
    out: dict[int, list[int]] = {}
    for v in sorted(versions, reverse=True):
        if (before is None or v < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(versions[v], "_SUCCESS")):
            for b in _folders(spark, versions[v].toString(), "bucket")[1]:
                out.setdefault(b, []).append(v)
    return out


def _drop_old(spark: SparkSession, path: str, number: int) -> None:
    """Deletes buckets that two newer versions replace: the one before the last serves a batch that is played again."""
    for b, versions in _versions(spark, path, number + 1).items():
        for v in versions[2:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/bucket={b}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_versions(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest finished version of each bucket (before a batch; of some buckets), with its column `bucket`, or None."""
    newest = {b: v[0] for b, v in _versions(spark, path, before).items() if buckets is None or b in buckets}
    if not newest:
        return None
    parts = [f"{path}/version={v}/bucket={b}" for b, v in sorted(newest.items())]
    return spark.read.option("basePath", path).parquet(*parts).drop("version")
