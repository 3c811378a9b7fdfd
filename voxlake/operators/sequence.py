"""Ordering, ranking and running totals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def page(df: DataFrame, order: str, tie: str, page_no: int, per: int) -> DataFrame:
    """A page, newest first, by its number: for pages near the start, since all rows before it are sorted. `page_after` and `PageIndex` serve deep ones."""
    return df.orderBy(F.desc(order), F.desc(tie)).offset((page_no - 1) * per).limit(per)


def page_after(df: DataFrame, order: str, tie: str, per: int, cursor: tuple | None = None) -> DataFrame:
    """The page that follows the row (order, tie) of a cursor, newest first; the first one without a cursor. Rows without an order value come last, those without a tie are in no page.

    The cursor is a filter that the scan can prune by, so the cost is that of the rows from it on and of a heap of `per` rows.
    """
    df = df.filter(F.col(tie).isNotNull())
    if cursor:
        at, key = map(F.lit, cursor)
        lower = F.col(order).isNull() & (F.col(tie) < key) if cursor[0] is None else F.col(order).isNull() | ((F.col(order) <= at) & ((F.col(order) < at) | (F.col(tie) < key)))
        df = df.filter(lower)
    return df.orderBy(F.desc(order), F.desc(tie)).limit(per)


class PageIndex:
    """Where the pages of a listing lie: a row (high, low, rows, before) for each value range of its order column, at most `ranges` of them.

    A page reads only the rows between the bounds of the ranges that it lies in, and sorts only those. The index is of the state that it was made from.
    """

    def __init__(self, df: DataFrame, order: str, tie: str, ranges: int = 1000):
        self.df, self.order, self.tie = df.filter(F.col(tie).isNotNull()), order, tie
        kept = self.df.select(order).filter(F.col(order).isNotNull()).repartitionByRange(ranges, F.desc(order)).withColumn("_r", F.spark_partition_id())
        found = kept.groupBy("_r").agg(F.max(order).alias("high"), F.min(order).alias("low"), F.count("*").alias("n")).orderBy("_r").collect()  # at most `ranges` rows
        self.bounds, self.rows = [], 0
        for r in found:
            self.bounds.append((r["high"], r["low"], r["n"], self.rows))
            self.rows += r["n"]

    def page(self, page_no: int, per: int) -> DataFrame:
        first = (page_no - 1) * per
        held = [b for b in self.bounds if b[3] < first + per and first < b[3] + b[2]]
        in_range = (F.col(self.order) <= F.lit(held[0][0])) & (F.col(self.order) >= F.lit(held[-1][1])) if held else F.lit(False)
        # rows without an order value follow all others
        if first + per > self.rows:
            in_range |= F.col(self.order).isNull()
        skip = first - (held[0][3] if held else min(first, self.rows))
        return self.df.filter(in_range).orderBy(F.desc(self.order), F.desc(self.tie)).offset(skip).limit(per)


def rank_checkpoints(cp: DataFrame) -> DataFrame:
    w = Window.partitionBy("voice_id").orderBy(F.desc("avg_score"), F.desc("created_at"), "id")
    return cp.withColumn("rank", F.row_number().over(w))


def activate(cp: DataFrame, choices: DataFrame) -> DataFrame:
    """All checkpoints of a chosen voice go to 0 and the chosen one, wherever it belongs, to 1."""
    voices = choices.select("voice_id", F.lit(1).alias("_v")).distinct()
    ids = choices.select(F.col("checkpoint_id").alias("id"), F.lit(1).alias("_c")).distinct()
    df = cp.join(voices, "voice_id", "left").join(ids, "id", "left")
    return df.withColumn("is_active", F.when(F.col("_c") == 1, 1).when(F.col("_v") == 1, 0).otherwise(F.col("is_active"))).select(*cp.columns)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order, by a partial aggregate (a hot key is no task of its own)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    got = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return got.select(*(F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns))


def merge_segments(df: DataFrame, gap: float = 1.0, shard_rows: int = scan.ROWS) -> DataFrame:
    """Segments of a speaker joined while the next starts less than `gap` after the last one's end; its end counts.

    `energy` is folded in order, (so far + next) / 2; null if one is null. Such steps are affine maps, which compose in any grouping: of an island's
    n segments the i-th counts 2 ** -(n - i + 1), the first twice that. So an island is a sum, and a part of it in a shard is n and its own
    sum. A speaker of any number of segments is scanned by shards of about `shard_rows`.
    """
    order = ["start", "end", "energy"]
    df = scan.shards(df.select("speaker", *order), "speaker", order, shard_rows)
    df = scan.neighbour(df, "speaker", order, "end", "_last")
    df = df.withColumn("_new", F.coalesce(F.col("start") - F.col("_last.v") >= gap, F.lit(True)).cast("int"))
    df = scan.prior_sum(df, "speaker", order, F.col("_new"), "_before")
    df = df.withColumn("island", F.coalesce("_before", F.lit(0)) + F.col("_new"))
    to_end = F.row_number().over(Window.partitionBy("speaker", "_shard", "island").orderBy(*map(F.desc, order)))
    parts = df.withColumn("_w", F.col("energy") * F.pow(F.lit(2.0), -to_end)).groupBy("speaker", "_shard", "island")
    parts = parts.agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"), F.sum("_w").alias("w"), F.count("*").alias("n"), F.count("energy").alias("known"))
    after = F.sum("n").over(Window.partitionBy("speaker", "island").orderBy("_shard").rowsBetween(1, Window.unboundedFollowing))
    parts = parts.withColumn("w", F.col("w") * F.pow(F.lit(2.0), -F.coalesce(after, F.lit(0))))
    df = parts.groupBy("speaker", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.sum("known").alias("known"))
    energy = F.when(F.col("known") == F.col("n"), F.col("w") + F.col("first.energy") * F.pow(F.lit(2.0), -F.col("n")))
    return df.select("speaker", "island", F.col("first.start").alias("start"), F.col("last.end").alias("end"), energy.alias("energy"), F.col("n").cast("int").alias("n"))


def _fill(df: DataFrame, prior: Column, budget: float, tail_ok: Column, first: bool) -> DataFrame:
    """Items while the running total fits (`prior` is what went before, null at the first); the first that overflows is cut if `tail_ok`."""
    df = df.withColumn("_sum", F.coalesce(prior, F.lit(0.0)) + F.col("dur")).withColumn("_first", prior.isNull())
    df = df.withColumn("_left", budget - (F.col("_sum") - F.col("dur")))
    fits = F.col("_sum") <= budget
    over = ~fits & (F.col("_left") > 0) & (tail_ok | (F.col("_first") if first else F.lit(False)))
    return df.withColumn("taken", F.when(fits, F.col("dur")).when(over, F.col("_left"))).filter("taken is not null").drop("_sum", "_left", "_first")


def select_budget(df: DataFrame, key: str = "speaker", min_len: float = 4.0, budget: float = 90.0, min_tail: float = 3.0) -> DataFrame:
    """Longest first until the budget is full; `taken` is what is used of each. `min_len` is over zero.

    No more than budget / min_len items fit, so only that many and one more of a key go on: Spark keeps the longest of each task
    before the shuffle, and a hot key is small after it.
    """
    w = Window.partitionBy(key).orderBy(F.desc("dur"), "start", "end")
    df = df.withColumn("dur", F.col("end") - F.col("start")).filter(F.col("dur") >= min_len)
    df = df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= math.floor(budget / min_len) + 1)
    prior = F.sum("dur").over(Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    return _fill(df.withColumn("_prior", prior), F.col("_prior"), budget, F.col("_left") >= min_tail, False).drop("_i", "_prior")


def budget_report(selected: DataFrame, key: str = "speaker", good: float = 30.0) -> DataFrame:
    df = selected.groupBy(key).agg(F.round(F.sum("taken"), 2).alias("total"), F.count("*").alias("n"))
    return df.withColumn("quality", F.when(F.col("total") >= good, "good").otherwise("short"))


def select_preview(df: DataFrame, key: str = "speaker", budget: float = 10.0, shard_rows: int = scan.ROWS) -> DataFrame:
    """The same in the given order; a cut tail must be longer than a second, and the first item is always used. A key of any size goes by shards."""
    df = scan.shards(df.withColumn("dur", F.col("end") - F.col("start")), key, ["start", "end"], shard_rows)
    df = scan.prior_sum(df, key, ["start", "end"], F.col("dur"), "_prior")
    return _fill(df, F.col("_prior"), budget, F.col("_left") > 1.0, True).drop("_prior", "_shard")


def pick_artifact(df: DataFrame, key: str, best: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.struct(best.cast("int").alias("b"), F.col(name).alias("n"))).alias("m")).select(key, F.col("m.n").alias(name))


def assemble_timeline(df: DataFrame, key: str, order: str, gap: float, shard_rows: int = scan.ROWS) -> DataFrame:
    """Offset of each part when parts follow each other with a gap, in order; a timeline of any length goes by shards."""
    df = scan.prior_sum(scan.shards(df, key, [order], shard_rows), key, [order], F.col("dur") + gap, "offset")
    return df.withColumn("offset", F.coalesce("offset", F.lit(0.0))).drop("_shard")


def timeline_totals(df: DataFrame, key: str, gap: float, trailing: bool = False) -> DataFrame:
    """Length of each assembled timeline; with `trailing` a gap follows the last part too."""
    return df.groupBy(key).agg((F.sum("dur") + gap * (F.count("*") - (0 if trailing else 1))).alias("total"))


def numbered(df: DataFrame, order: str, tie: str, out: str, shard_rows: int = scan.ROWS) -> DataFrame:
    """`df` numbered from 1 in order of a column, then `tie`, by ranges."""
    return scan.numbered(df, [order, tie], out, shard_rows)


def split_item(df: DataFrame, cuts: DataFrame, key: str, order: str) -> DataFrame:
    """Items cut in two at a point inside them; a point outside changes nothing; items are numbered anew from 0."""
    df = df.join(cuts, [key, order], "left")
    inside = (F.col("cut") > F.col("start")) & (F.col("cut") < F.col("end"))
    one = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    parts = F.when(inside, F.array(one(F.col("start"), F.col("cut")), one(F.col("cut"), F.col("end")))).otherwise(F.array(one(F.col("start"), F.col("end"))))
    df = df.select(key, order, F.posexplode(parts).alias("half", "p"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order, "half")) - 1
    return df.select(key, n.alias("index"), "p.start", "p.end")


def clip_item(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Items within [low, high] clamped to the item; high <= 0 is the end; empty ones go."""
    stop = F.when(high <= 0, F.col("end")).otherwise(F.least(high, F.col("end")))
    start = F.greatest(F.col("start"), low)
    return df.withColumn("_s", start).withColumn("end", stop).withColumn("start", F.col("_s")).drop("_s").filter("end > start")


def bound_length(df: DataFrame, low: float = 6.0, high: float = 30.0) -> DataFrame:
    return df.filter(F.col("dur") >= low).withColumn("dur", F.least("dur", F.lit(high)))


def voice_choices(v: DataFrame, favorites_first: bool = False) -> DataFrame:
    return v.orderBy(*([F.desc("is_favorite")] if favorites_first else []), F.desc("created_at"), F.desc("id"))


def siblings(df: DataFrame, key: str, name: str, derived: Column, n: int = 5) -> DataFrame:
    """Each item with up to n - 1 others of one name (the smallest keys), without derived ones."""
    base = df.filter(~derived).select(key, name)
    near = base.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(key))).filter(F.col("_r") <= n)
    other = near.select(F.col(key).alias("sibling"), F.col(name).alias("_n"))
    pairs = base.join(other, F.col(name) == F.col("_n")).filter(F.col(key) != F.col("sibling")).drop("_n")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("sibling"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") < n)


def following(df: DataFrame, group: str, order: str, value: str, shard_rows: int = 4096) -> DataFrame:
    """`df` with `next`: `value` of the row that follows within the group, in order of a numeric column; last rows go.

    As lead over a window by group, but a group is dealt by ranges of `order` into shards of about `shard_rows` rows. The
    last row of a shard takes the first value of the group's next shard. The bounds are collected, so all uses of them agree.
    """
    most = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    k = max(1, -(-most // shard_rows))
    cuts = F.array(*(F.lit(i / k) for i in range(1, k))) if k > 1 else F.array(F.lit(0.0))
    found = df.groupBy(group).agg(F.percentile_approx(order, cuts, max(10000, 20 * k)).alias("b")).collect()
    kind = df.schema[group].dataType.simpleString()
    bounds = df.sparkSession.createDataFrame([(r[0], i, sorted({*(r["b"] or [])})) for i, r in enumerate(found)], f"_of {kind}, _g int, _bounds array<{df.schema[order].dataType.simpleString()}>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(k.bit_length()))))
    shard = F.aggregate(steps, F.lit(0), lambda at, n: F.when((at + n <= F.size("_bounds")) & (F.get("_bounds", at + n - 1) <= F.col(order)), at + n).otherwise(at))
    rows = df.join(F.broadcast(bounds), F.col(group).eqNullSafe(F.col("_of"))).withColumn("_shard", shard).drop("_of", "_bounds")
    firsts = rows.groupBy("_g", "_shard").agg(F.min(order).alias("_first"))
    firsts = firsts.select("_g", "_shard", F.lead("_first").over(Window.partitionBy("_g").orderBy("_shard")).alias("_after")).filter("_after is not null")
    heads = rows.select(F.col("_g").alias("_hg"), F.col(order).alias("_ho"), F.struct(F.col(value).alias("v")).alias("_head"))
    heads = F.broadcast(firsts).join(heads, (F.col("_g") == F.col("_hg")) & (F.col("_after") == F.col("_ho"))).groupBy("_g", "_shard").agg(F.first("_head").alias("_head"))
    own = F.lead(F.struct(F.col(value).alias("v"))).over(Window.partitionBy("_g", "_shard").orderBy(order))
    out = rows.withColumn("_own", own).join(heads, ["_g", "_shard"], "left").withColumn("_next", F.coalesce("_own", "_head"))
    return out.filter("_next is not null").select(*df.columns, F.col("_next.v").alias("next"))
