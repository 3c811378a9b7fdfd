"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a single machine where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and still there when an executor is lost."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in one folder of the shared ones, deleted together when what was made from them is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_folder(spark, name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Shuffles of jobs that are done leave the disks when the driver's JVM collects what refers to them, which may be late."""
        for _ in range(2):  # the driver's Python lets go of the JVM's objects in a thread of its own
            gc.collect()
            time.sleep(0.5)
            self.spark._jvm.System.gc()

    def clear(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, rows: int, share: int = 1000) -> DataFrame:
    """Inner join on `key` for a `right` with one row a key, whose column `n` counts the key's rows in `left` (`rows` in all).

    Keys that hold over 1 / `share` of the rows, fewer than `share` of them, are broadcast, so that their rows stay where they
    are; the rest is joined by a shuffle in which no key is large. `left` is read twice: a written table.
    """
    hot = right.filter(F.col(n) * share > rows)
    some = left.join(F.broadcast(hot), key)
    return some.unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(n) * share <= rows), key))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def hashed(key: str) -> Column:
    """63 bits of a hash of a column."""
    return F.shiftrightunsigned(F.xxhash64(key), 1)


def sampled(key: str, share: float | Column) -> Column:
    """Whether a row is in a sample of that share of all rows, by 63 bits of a hash: any share of any table can be told."""
    return hashed(key) <= (F.least(F.lit(1.0), share) * float(2**63) if isinstance(share, Column) else F.lit(min(2**63 - 1, int(share * 2**63))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
