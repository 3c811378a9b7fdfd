"""Table scans, sinks and files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION = "pdf string, subject string, week bigint, class_num bigint, title string, start_page bigint, end_page bigint"


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The schema's columns in order, missing ones with their default, then the columns it does not name."""
    own = [(F.col(f.name) if f.name in df.columns else F.lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*own, *(c for c in df.columns if c not in schema.fieldNames()))


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every `*_model/meta.json` under `root` with its folder, newest first."""
    schema = "voice_name string, model_path string, config_path string, vocab_path string, speaker_ref string, total_duration double, num_epochs int, created_at string"
    df = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*_model/meta.json")
    return df.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/meta\.json$", 1)).orderBy(F.desc("created_at"), "folder")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """The section index; an absent file is an empty one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SECTION)
    return spark.read.schema(SECTION).option("multiLine", True).json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """part, term and gloss of a JSON object {term: gloss} (part is '') or {part: {term: gloss}}."""
    text = spark.read.text(path, wholetext=True)
    flat = F.from_json("value", "map<string,string>")
    df = text.select(F.explode(flat).alias("key", "raw"))
    nested = F.from_json("raw", "map<string,string>")
    plain = df.filter(~F.col("raw").startswith("{")).select(F.lit("").alias("part"), F.col("key").alias("term"), F.col("raw").alias("gloss"))
    return plain.unionByName(df.filter(F.col("raw").startswith("{")).select(F.col("key").alias("part"), F.explode(nested).alias("term", "gloss")))


def write_by_day(df: DataFrame, path: str, ts: str) -> None:
    """A folder for each day; rows of a day go to few tasks first, large days to several, so that there are few files."""
    df.withColumn("day", F.date_format(ts, "yyyyMMdd")).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def with_split(df: DataFrame, key: str, eval_frac: float = 0.15) -> DataFrame:
    """Adds `part` (train or eval), the same on every run."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(key), F.lit(10000)) < int(eval_frac * 10000), "eval").otherwise("train"))


def train_eval_split(df: DataFrame, key: str, duration: str, eval_frac: float = 0.15) -> tuple[DataFrame, DataFrame, float]:
    df = with_split(df, key, eval_frac)
    total = df.agg(F.round(F.coalesce(F.sum(duration), F.lit(0.0)), 2).alias("s")).first()["s"]
    return df.filter("part = 'train'").drop("part"), df.filter("part = 'eval'").drop("part"), total


def write_manifest(df: DataFrame, path: str, key: str, duration: str, eval_frac: float = 0.15) -> dict:
    """Writes the two parts as CSV with a head; their folders, and the total duration."""
    train, test, total = train_eval_split(df, key, duration, eval_frac)
    out = {"train_csv": f"{path}/train", "eval_csv": f"{path}/eval", "total_duration": total}
    train.write.csv(out["train_csv"], header=True)
    test.write.csv(out["eval_csv"], header=True)
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all machines share (spark.checkpoint.dir); on a single machine where that is unset, in one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def render_srt(cues: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One subtitle text a document from cues (doc, i, start_code, end_code, text): number, times, text, blank line."""
    cue = F.concat_ws("\n", (F.col("i") + 1).cast("string"), F.concat_ws(" --> ", "start_code", "end_code"), "text", F.lit(""))
    return cues.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", cue.alias("c")))), lambda x: x["c"]), "\n").alias("srt"))


def local_day(ts: Column) -> Column:
    """The date at +09:00 of a UTC timestamp without zone."""
    return F.to_date(ts + F.expr("INTERVAL 9 HOURS"))
