"""Longest-match segmentation of texts with dictionaries (term, gloss) of any size.

A dictionary of up to `BOUND` characters, which are counted first, goes to each worker once; a walk over a text
looks a run of several units up only if the table of hashes has it. Beyond that bound the distinct runs of `TOGETHER` texts at a time that a bit table of all terms doesn't rule out are joined
with the terms by hash partitions, and the same walk over these texts takes what they hold as its dictionary. A term is at most a row for each such group, and no text is part of a join key.
Of several glosses of a term the smallest counts; null terms and glosses count as absent; a null text stays null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxlake.sources.tables import new_folder

from .text import HAN, TONE_VOWELS, has_script

#: Characters of all terms and glosses that go to every worker.
BOUND = 12_000_000
#: White space as the text expressions have it.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: Texts that are looked up together in a large dictionary, and the length from which on a text is looked up alone.
TOGETHER, ALONE = 512, 1 << 16
#: Units that are walked together.
CHUNK = 1 << 20
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word its polynomial hash, and the power by which a hash is moved when the word is put behind another."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = sizes.cumsum()
    powers = np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()), BASE)]).cumprod(dtype=np.uint64)
    behind = np.repeat(ends, sizes) - 1 - np.arange(len(codes))
    return np.add.reduceat(codes * powers[behind], ends - sizes), powers[sizes]


class Terms:
    """Terms with their glosses, and a table of their hashes, by which nearly all runs are ruled out before their string is made."""

    def __init__(self, terms: Sequence[str], glosses: Sequence[str]):
        self.terms, self.glosses = terms, glosses

    def __reduce__(self) -> tuple:
        return Terms, (self.terms, self.glosses)

    @cached_property
    def gloss(self) -> dict[str, str]:
        return dict(zip(self.terms, self.glosses, strict=True))

    @cached_property
    def shift(self) -> np.uint64:
        return np.uint64(64 - min(26, max(10, (32 * len(self.terms)).bit_length())))

    @cached_property
    def table(self) -> np.ndarray:
        table = np.zeros(1 << (64 - int(self.shift)), bool)
        if len(self.terms):
            table[self._slots(_hashes(self.terms)[0])] = True
        return table

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * MIX) >> self.shift

    def walk(self, texts: list[list[str]], window: int, other: Callable[[str], str]) -> list[list[str]]:
        """For each text the glosses of the longest terms of up to `window` units, from left to right; `other` reads a unit that begins none."""
        flat = [u for t in texts for u in t]
        n, sizes = len(flat), np.array([len(t) for t in texts], np.int64)
        if not n:
            return [[] for _ in texts]
        ids, units = pd.factorize(np.array(flat, dtype=object))
        value, power = (x[ids] for x in _hashes(list(units)))
        ends, run, gloss, longest = sizes.cumsum(), value, self.gloss.get, {}
        left = np.repeat(ends, sizes) - np.arange(n)
        for k in range(2, min(window, n) + 1):
            run = run[: n - k + 1] * power[k - 1 :] + value[k - 1 :]
            for i in np.flatnonzero(self.table[self._slots(run)] & (left[: n - k + 1] >= k)).tolist():
                if (found := gloss("".join(flat[i : i + k]))) is not None:
                    longest[i] = k, found
        out, kept, free = np.array([other(u) if (w := gloss(u)) is None else w for u in units], dtype=object)[ids], np.ones(n, bool), 0
        for i in sorted(longest):
            if i >= free:
                k, out[i] = longest[i]
                free = i + k
                kept[i + 1 : free] = False
        return [out[a:b][kept[a:b]].tolist() for a, b in zip(ends - sizes, ends, strict=True)]

    def read(self, texts: Iterable[str | None], units: Callable[[str], list[str]], window: int, joined: str, other: Callable[[str], str]) -> list[str | None]:
        """Texts as `walk` gives them, a chunk of units at a time; a null text stays null."""
        out: list[str | None] = []
        held: list[list[str] | None] = []
        size = 0

        def close() -> None:
            done = iter(self.walk([t for t in held if t is not None], window, other))
            out.extend(None if t is None else joined.join(next(done)) for t in held)
            held.clear()

        for text in texts:
            held.append(None if text is None else units(text))
            size += len(held[-1] or ())
            if size >= CHUNK:
                close()
                size = 0
        close()
        return out


def _units(by: str) -> Callable[[str], list[str]]:
    return list if by == "characters" else lambda t: [x for x in SPACE.split(t.strip(" ")) if x]


def _clean(dictionary: DataFrame) -> DataFrame:
    # the filter on the gloss comes last, so that glosses that are computed are not computed for it on every row
    return dictionary.filter("term is not null and term <> ''").groupBy("term").agg(F.min("gloss").alias("gloss")).filter("gloss is not null")


def _marked(words: DataFrame) -> tuple[np.ndarray, np.uint64]:
    """A bit for each slot that the hash of a term falls in, at most 2 ** 28 of them (32 MB), gathered by Spark in blocks of 32,768; and the shift of the slots."""
    shift = np.uint64(64 - min(28, max(16, (32 * words.count()).bit_length())))

    @F.pandas_udf("long")
    def slot(term: pd.Series) -> pd.Series:
        return pd.Series(((_hashes(list(term))[0] * MIX) >> shift).astype(np.int64) + 1 if len(term) else [], dtype=np.int64)

    slots = words.select(slot("term").alias("slot"))
    blocks = slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = np.zeros((1 << (64 - int(shift))) // 8, np.uint8)
    for block, bits in blocks.collect():  # at most 8,192 rows
        table[(block - 1) * 4096 : block * 4096] = np.frombuffer(bits, np.uint8)
    return table, shift


def _unruled(texts: list[list[str]], window: int, table: np.ndarray, shift: np.uint64) -> set[str]:
    """The distinct runs of up to `window` units of some texts that the bits don't rule out."""
    flat = [u for t in texts for u in t]
    n, ends = len(flat), np.array([len(t) for t in texts], np.int64).cumsum()
    if not n:
        return set()

    def marked(runs: np.ndarray) -> np.ndarray:
        slots = (runs * MIX) >> shift
        return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0

    ids, units = pd.factorize(np.array(flat, dtype=object))
    value, power = _hashes(list(units))
    out = set(units[marked(value)])
    value, power = value[ids], power[ids]
    left, run = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n), value
    for k in range(2, min(window, n) + 1):
        run = run[:-1] * power[k - 1 :] + value[k - 1 :]
        out.update("".join(flat[i : i + k]) for i in np.flatnonzero(marked(run) & (left[: n - k + 1] >= k)).tolist())
    return out


def _looked_up(df: DataFrame, col: str, words: DataFrame, out: str, units: Callable, window: int, joined: str, other: dict[str, str], only: Column) -> DataFrame:
    """`segmented` for a dictionary of any size: texts are looked up `TOGETHER`, so a frequent term is one row for as many texts, and copies of a text are no key."""
    spark, marks = df.sparkSession, _marked(words)
    table, shift = spark.sparkContext.broadcast(marks[0]), marks[1]
    path = new_folder(spark, "segmented")  # written, since numbers of rows must stay the same
    df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_on", F.coalesce(only, F.lit(False))).write.parquet(path)
    held = spark.read.parquet(path)
    held = held.withColumn("_at", F.when(F.length(col) > ALONE, -1 - F.col("_id")).otherwise(F.floor(F.col("_id") / TOGETHER))).drop("_id")
    texts, rest = held.filter("_on").drop("_on"), held.filter("not _on").drop("_on", "_at")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                found = list(_unruled([units(t) for t in batch.column(1)[a:b].to_pylist()], window, table.value, shift)) if b > a else []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), at[a] if b > a else 0)), pa.array(found, pa.string())], ["_at", "term"])

    def walk(rows: pa.Table, terms: pa.Table) -> pa.Table:
        own = Terms(terms["term"].to_pylist(), terms["gloss"].to_pylist()) if len(terms) else Terms((), ())
        said = own.read(rows[col].to_pylist(), units, window, joined, lambda u: other.get(u, u))
        return rows.drop_columns(["_at"]).append_column(out, pa.array(said, pa.string()))

    found = texts.select("_at", col).mapInArrow(runs, "_at long, term string").join(words, "term").select("_at", "term", "gloss")
    schema = StructType(rest.schema.fields).add(out, "string")
    walked = texts.groupBy("_at").cogroup(found.groupBy("_at")).applyInArrow(walk, schema)
    return walked.unionByName(rest.withColumn(out, F.col(col)))


def segmented(df: DataFrame, col: str, words: DataFrame, out: str, by: str = "characters", window: int = 6, joined: str = "; ", syllables: dict[str, str] | None = None, bound: int = BOUND, only: Column | None = None) -> DataFrame:
    """Adds `out`: the text's units ("characters" or "tokens") replaced by the glosses of the longest known runs, the others by `syllables` or as they are; texts for which `only` is not true stay."""
    words, other, units = _clean(words).persist(), syllables or {}, _units(by)
    size = words.agg(F.sum(F.length("term") + F.length("gloss"))).first()[0] or 0
    if size <= bound:
        rows = words.toArrow()  # bounded
        words.unpersist()
        shared = df.sparkSession.sparkContext.broadcast(Terms(rows["term"].to_pylist(), rows["gloss"].to_pylist()))

        @F.pandas_udf("string")
        def walk(text: pd.Series) -> pd.Series:
            return pd.Series(shared.value.read(text, units, window, joined, lambda u: other.get(u, u)), dtype=object)

        return df.withColumn(out, walk(F.col(col)) if only is None else F.coalesce(walk(F.when(only, F.col(col))), F.col(col)))

    return _looked_up(df, col, words, out, units, window, joined, other, F.col(col).isNotNull() if only is None else only & F.col(col).isNotNull())


def toned(col: Column) -> Column:
    """Whether a text is in toned syllables."""
    return (F.octet_length(col) > F.length(col)) & ~has_script(col, HAN) & col.rlike(f"[{TONE_VOWELS}]")  # most texts without are ASCII


def words_of_syllables(df: DataFrame, col: str, words: DataFrame, out: str, syllables: dict[str, str] | None = None, bound: int = BOUND) -> DataFrame:
    """Adds `out`: toned syllables replaced by the longest known word of up to four, else syllable by syllable; other texts stay."""
    return segmented(df, col, words, out, "tokens", 4, "", syllables, bound, toned(F.col(col)))
