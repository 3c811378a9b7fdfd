"""Table maintenance as DataFrame to DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import numbered


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key, by a partial aggregate."""
    rest = [c for c in changes.columns if c not in keys]
    got = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return got.select(*keys, "_r.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], update_cols: list[str], order: str) -> DataFrame:
    """Rows of `base` with the update columns of the last change of their key; new keys are added."""
    new = latest(changes, keys, order)
    new = new.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in base.columns if c not in keys and c in new.columns))
    df = base.withColumn("_old", F.lit(True)).join(new, keys, "full")
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("_new").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        elif f"_{c}" in new.columns:
            out.append(F.when(F.col("_old").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def backfill(df: DataFrame, rules: dict[str, list[tuple[Column, Column]]]) -> DataFrame:
    """For each column, the value of the first rule whose condition holds."""
    for name, cases in rules.items():
        value = F.col(name)
        for when, then in reversed(cases):
            value = F.when(when, then).otherwise(value)
        df = df.withColumn(name, value)
    return df


def apply_decisions(voices: DataFrame, reviews: DataFrame, decisions: DataFrame, requests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Voices and reviews after requests (id, voice_id, shared_folder_id, requested_by, at) and decisions (review_id, approve, reviewer, note, at); unknown reviews change nothing.

    A voice's events are folded in order of time, then review: a request puts it under review, an approval publishes it and lets it
    generate, a rejection makes it active again but takes nothing back. The last event gives the status, any approval the rest, so
    the fold is a partial aggregate. A review is pending from its request on, and then as last decided.
    """
    if requests is not None:
        asked = requests.withColumnRenamed("at", "created_at").withColumn("status", F.lit("pending"))
        reviews = reviews.unionByName(asked.select(*(c for c in asked.columns if c in reviews.columns)), allowMissingColumns=True)
    d = latest(decisions, ["review_id"], "at").withColumnRenamed("review_id", "_id")
    made = reviews.join(d, reviews["id"] == d["_id"], "left")
    status = F.when(F.col("approve"), "approved").when(~F.col("approve"), "rejected").otherwise(F.col("status"))
    out = made.withColumns({"status": status, "reviewed_by": F.coalesce("reviewer", "reviewed_by"), "review_note": F.coalesce("note", "review_note"), "reviewed_at": F.coalesce("at", "reviewed_at")})
    of = reviews.select(F.col("id").alias("review_id"), "voice_id")
    events = decisions.join(of, "review_id").select("voice_id", "at", F.col("review_id").alias("by"), F.when(F.col("approve"), "published").otherwise("active").alias("to"))
    if requests is not None:
        events = events.unionByName(requests.select("voice_id", "at", F.col("id").alias("by"), F.lit("review").alias("to")))
    state = events.groupBy("voice_id").agg(F.max_by("to", F.struct("at", "by", "to")).alias("_to"), F.bool_or(F.col("to") == "published").alias("_approved"))
    v = voices.join(state.withColumnRenamed("voice_id", "_voice"), F.col("_voice") == voices["id"], "left")
    v = v.withColumns({"status": F.coalesce("_to", "status"), "can_generate": F.when(F.col("_approved"), 1).otherwise(F.col("can_generate")), "folder_type": F.when(F.col("_approved"), "published").otherwise(F.col("folder_type"))})
    return v.select(*voices.columns), out.select(*reviews.columns)


def bump_version(df: DataFrame, keys: DataFrame, key: str, col: str, status: str = "status") -> DataFrame:
    """The next version of the rows with a key, which are published."""
    k = keys.select(F.col(key).alias("_k")).distinct()
    hit = F.col("_k").isNotNull()
    df2 = df.join(k, df[key] == k["_k"], "left")
    return df2.withColumns({col: F.when(hit, F.coalesce(col, F.lit(1)) + 1).otherwise(F.col(col)), status: F.when(hit, "published").otherwise(F.col(status))}).select(*df.columns)


def copy_rows(df: DataFrame, requests: DataFrame, suffix: str = " (copy)") -> DataFrame:
    """`df` and a copy for each request (source_id, kind, user_id, folder_id, at) of a row that exists.

    New ids follow the largest in order of source, then kind. The copy belongs to who asked, since then; one of kind "shared" stands in
    the folder, a personal one in none and gets the suffix.
    """
    asked = requests.select(F.col("source_id").alias("source_voice_id"), F.col("kind").alias("_kind"), F.col("user_id").alias("_user"), F.col("folder_id").alias("_folder"), F.col("at").alias("_at"))
    src = df.withColumnRenamed("id", "source_voice_id").join(asked, "source_voice_id")
    top = df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    new = numbered(src, "source_voice_id", "_kind", "_n").join(F.broadcast(top), F.lit(True)).withColumn("id", F.col("_top") + F.col("_n"))
    personal = F.col("_kind") == "personal"
    new = new.withColumns({"name": F.when(personal, F.concat("name", F.lit(suffix))).otherwise(F.col("name")), "folder_type": F.col("_kind"), "status": F.lit("active"), "user_id": F.col("_user"), "shared_folder_id": F.when(~personal, F.col("_folder")), "created_at": F.col("_at")})
    return df.withColumn("source_voice_id", F.lit(None).cast("long")).unionByName(new.select(*df.columns, "source_voice_id"))


def toggle(df: DataFrame, keys: DataFrame, key: str, col: str) -> DataFrame:
    """Flips a 0/1 flag once for each row of `keys` with the key."""
    n = keys.groupBy(F.col(key).alias("_k")).agg((F.count("*") % 2).alias("_odd"))
    out = df.join(n, df[key] == n["_k"], "left")
    return out.withColumn(col, ((F.col(col) + F.coalesce("_odd", F.lit(0))) % 2).cast("int")).select(*df.columns)


def replace_slice(df: DataFrame, new: DataFrame, pred: Column) -> DataFrame:
    return df.filter(~F.coalesce(pred, F.lit(False))).unionByName(new)


def explode_scores(df: DataFrame, key: str, col: str) -> DataFrame:
    """A row for each element of a JSON array of scores; score defaults to 0."""
    got = F.explode(F.from_json(col, "array<struct<text:string,score:int,index:int>>")).alias("s")
    return df.select(key, got).select(key, "s.text", F.coalesce("s.score", F.lit(0)).alias("score"), "s.index")


def create_folders(folders: DataFrame, members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New folders, and their owners as members with all rights."""
    owners = new.select(F.col("id").alias("folder_id"), F.col("owner_id").cast("long").alias("user_id"), F.lit("admin").alias("permission"))
    return folders.unionByName(new), members.unionByName(owners)
