"""Merkle manifest of a table: a digest of each row, a tree over the rows of each group, a tree over the groups, a proof for each row.

Eight neighbours make a parent. The nodes of a level stand at every 8 ** level-th row, so that siblings are lag and lead columns
at fixed offsets, masked by a node's slot in its run and by the length of that run; the rows of first children hash the parents.
Three levels share one window over blocks of 512 rows, so a tree of any size is a few rounds, each over a 512th of the rows of
the one before. Positions come from a range sort and the counts of its partitions: a hot group is spread over as many tasks as
it has ranges, and no window or join holds more than a block.

Defined cases: rows of a group ascend by doc_id, null first, then by digest; rows that are equal in all columns are interchangeable
leaves; null values have the digest input `-`; an empty table has no rows and no root; other columns of the table don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FAN = 8
#: Levels that one window serves, and the rows of its blocks.
DEEP = 3
BLOCK = FAN**DEEP
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(columns: list[Column]) -> Column:
    """SHA-256 of the values, each `-` if null, else its UTF-8 byte count, `:` and itself."""

    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s), F.lit(":"), s))

    return F.sha2(F.concat(*map(one, columns)), 256)


def positions(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """`rows` with `pos`, a row's number in its group `g` from 0 in that order, and `n`, the rows of the group."""
    sort = ["g", *order, "_row"]
    rows = scratch.table(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ranged = scratch.table(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33)), "ranged")
    counts = ranged.groupBy("_part", "g").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", "g", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("g")).alias("n"))
    return ranged.join(counts, ["_part", "g"]).withColumn("pos", F.col("_m") + F.col("_shift")).drop("_part", "_m", "_shift", "_row")


def climbed(nodes: DataFrame) -> DataFrame:
    """Nodes (g, pos, n, digest) with `up`, the digest of the ancestor three levels above at the rows of first children, and `path`, the siblings left and right on these levels."""
    by = "OVER (PARTITION BY g, _block ORDER BY pos)"
    df = nodes.withColumn("_block", F.floor(F.col("pos") / BLOCK)).withColumn("_d0", F.col("digest"))
    levels = range(DEEP)
    slot = [f"(pos div {FAN**k}) % {FAN}" for k in levels]
    for k in levels:
        step = FAN**k
        run = f"least({FAN}, (n + {step - 1}) div {step} - (pos div {step * FAN}) * {FAN})"
        left = [f"CASE WHEN {slot[k]} >= {d} THEN lag(_d{k}, {d * step}) {by} ELSE '' END" for d in range(FAN - 1, 0, -1)]
        right = [f"CASE WHEN {slot[k]} + {d} < {run} THEN lead(_d{k}, {d * step}) {by} ELSE '' END" for d in range(1, FAN)]
        siblings = f"CASE WHEN pos % {step} = 0 AND n > {step} THEN struct(concat({', '.join(left)}) AS left, concat({', '.join(right)}) AS right) END"
        parent = f"CASE WHEN pos % {step * FAN} <> 0 THEN NULL WHEN n > {step} THEN sha2(concat(_d{k}, _s{k}.right), 256) ELSE _d{k} END"
        df = df.withColumn(f"_s{k}", F.expr(siblings)).withColumn(f"_d{k + 1}", F.expr(parent))
    # downwards: a node takes what its run's first child knows of the levels above
    df = df.withColumn(f"_p{DEEP - 1}", F.array(f"_s{DEEP - 1}"))
    for k in reversed(range(DEEP - 1)):
        of_first = ", ".join(f"CASE WHEN {slot[k]} = {d} THEN lag(_p{k + 1}, {d * FAN**k}) {by} END" for d in range(1, FAN))
        df = df.withColumn(f"_p{k}", F.expr(f"CASE WHEN pos % {FAN**k} = 0 THEN concat(array(_s{k}), coalesce(CASE WHEN {slot[k]} = 0 THEN _p{k + 1} END, {of_first})) END"))
    return df.withColumn("path", F.array_compact("_p0")).withColumnRenamed(f"_d{DEEP}", "up").drop(*(f"_{x}{k}" for x in "dsp" for k in levels))


def tree(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The nodes that every third level starts from, up to the one where each group has a single node: its root."""
    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        top = climbed(rounds[-1]).filter(F.col("pos") % BLOCK == 0)
        rounds.append(scratch.table(top.select("g", F.col("_block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("up").alias("digest")), "nodes"))
        most = -(-most // BLOCK)
    return rounds


def proven(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first of `rounds` with `path` up to the root of its group and on along the path of `top` (g, path, more columns), which come along."""
    above, more = top.withColumn("pos", F.lit(0).cast("long")), [c for c in top.columns if c not in ("g", "path")]
    for nodes in reversed(rounds[:-1]):
        df = climbed(nodes).drop("up").withColumnRenamed("path", "_low")
        above = above.select("g", F.col("pos").alias("_block"), "path", *more)
        above = df.join(above, ["g", "_block"]).withColumn("path", F.concat("_low", "path")).drop("_low", "_block")
    return above if len(rounds) > 1 else rounds[0].join(above, ["g", "pos"])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def proof(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, scratch: Scratch, also: dict[str, Column] | None = None) -> DataFrame:
    """For each row doc_id, lang, leaf, `path` (array of left, right: the siblings up to the root), subroot of its lang, root; and what `also` names, taken from the row.

    Tables on the way lie in `scratch`, which the caller clears when the manifest is written.
    """
    also = also or {}
    group = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    rows = docs.select("doc_id", "lang", group.alias("g"), digest([F.col(c) for c in FIELDS]).alias("digest"), *(c.alias(k) for k, c in also.items()))
    rounds = tree(scratch.table(positions(rows, ["doc_id", "digest"], scratch), "leaves"), scratch)
    # `rounds[-1]` has one node a group: they are the leaves of a second tree
    groups = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
    upper = tree(scratch.table(positions(groups, ["of"], scratch), "groups"), scratch)
    end = upper[-1].first()
    root = F.lit(end["digest"] if end else None).cast("string")
    start = upper[-1].select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    top = proven(upper, start).select(F.col("of").alias("g"), "path", F.col("digest").alias("subroot"))
    return proven(rounds, top).select("doc_id", "lang", F.col("digest").alias("leaf"), "path", "subroot", root.alias("root"), *also)
