"""Packing into length buckets whose boundaries minimise padding.

One aggregate gives the global length histogram, a row for each length that occurs. Those lengths add up to no more than
all tokens, so there are at most sqrt(2 * tokens) of them. Dynamic programming over them chooses at most `buckets`
boundaries with the least padding, exactly: a bucket that ends later never begins earlier, so each round halves its ranges
instead of trying all pairs. Every document is padded to its bucket's boundary, and a batch takes as many documents as fit
its token budget.

Positions within a bucket need no global sort: a bucket is dealt by hash into shards of about `shard_rows` rows, each
numbers its own rows, and prefix sums of the shard counts make the numbers continue. So a bucket that holds a third of
all rows is no task of its own, and only the last batch of a bucket is not full. The hash takes in the row's place in its
partition, so equal rows are dealt out too: boundaries, buckets and batch sizes depend on the rows alone, which rows share a
batch also on how the input is dealt to partitions.

Defined cases: null or empty texts have 0 tokens and go to the first bucket; a null or negative length counts as 0; a
document over the budget is a batch of its own; very long texts are counted whole; repeated rows and null ids are packed
each; of boundaries with equal padding those that end earlier are taken; an empty table gives an empty table; other columns
of the input, whatever their names, are not looked at (but for those that `length` names).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def histogram(lengths: DataFrame) -> list[tuple[int, int]]:
    """(length, rows) of every length that occurs, in order."""
    rows = lengths.groupBy("n_tokens").agg(F.count("*").alias("n"))
    return sorted((r["n_tokens"], r["n"]) for r in rows.collect())


def best_boundaries(bins: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least padding; of equal ones those that end earlier."""
    if not bins:
        return []
    top, n = (np.array(x, np.int64) for x in zip(*bins, strict=True))
    rows, tokens = (np.concatenate([[0], x.cumsum()]) for x in (n, n * top))
    size = len(bins)
    cost, back = np.full(size + 1, 2**61), []
    cost[0] = 0
    for _ in range(min(buckets, size)):
        new, begin = _with_one_more(cost, top, rows, tokens)
        begin = np.where(new < cost, begin, -1)
        back.append(begin)
        cost = np.minimum(new, cost)
    ends, j = [], size
    for begin in reversed(back):
        if j and begin[j] >= 0:
            ends.append(int(top[j - 1]))
            j = int(begin[j])
    return ends[::-1]


def _with_one_more(cost: np.ndarray, top: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least padding up to each length if a bucket ends there, and the length after which that bucket begins.

    The middle length of each range is solved among the begins left to it, all ranges of a round side by side; its begin
    bounds those of the lengths before and after it.
    """
    new, begin = np.full(len(cost), 2**61), np.zeros(len(cost), np.int64)
    low, high, first, last = (np.array([x]) for x in (1, len(top), 0, len(top) - 1))
    while len(low):
        mid = (low + high) // 2
        count = np.minimum(last, mid - 1) - first + 1
        start = count.cumsum() - count
        i, j = np.arange(count.sum()) + np.repeat(first - start, count), np.repeat(mid, count)
        padded = cost[i] + top[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
        new[mid] = np.minimum.reduceat(padded, start)
        hits = np.flatnonzero(padded == np.repeat(new[mid], count))
        begin[mid] = i[hits[np.searchsorted(hits, start)]]
        low, high, first, last = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (first, begin[mid]), (begin[mid], last)))
        low, high, first, last = (x[low <= high] for x in (low, high, first, last))
    return new, begin


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65536, shard_rows: int = 20000) -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, batch (within the bucket) and slot (within the batch) of every row of `docs`.

    `length` is a column of token counts (by default the words of `text`).
    """
    tokens = word_count(F.col("text")) if length is None else F.greatest(length.cast("long"), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("h"))
    rows = written(rows, "lengths")
    bins = histogram(rows)
    ends = best_boundaries(bins, buckets) or [0]
    held = [sum(n for top, n in bins if top <= e and (not k or top > ends[k - 1])) for k, e in enumerate(ends)]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
    nth = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    rows = rows.withColumn("shard", F.pmod("h", nth([max(1, -(-n // shard_rows)) for n in held])))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    counts = counts.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc_id", "h")) - 1
    rows = rows.withColumn("i", within).join(counts, ["bucket", "shard"])
    at, fits = F.col("i") + F.col("offset"), nth([max(1, budget // max(1, e)) for e in ends])
    return rows.select(
        "doc_id", "n_tokens", "bucket", nth(ends).alias("boundary"), F.floor(at / fits).cast("long").alias("batch"), (at % fits).cast("long").alias("slot")
    )
