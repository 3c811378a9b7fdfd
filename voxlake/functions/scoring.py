"""Scores of an attempt against its target, as expressions over arrays and strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import characters, let

STATUS = ["perfect", "tone_wrong", "wrong", "missing", "extra"]


def align_status(base: Column, full: Column, heard_base: Column, heard_full: Column) -> Column:
    """Status of each position: perfect, tone_wrong, wrong, missing or extra, from arrays of plain and full readings."""
    a = F.zip_with(base, full, lambda b, f: F.struct(b.alias("b"), f.alias("f")))
    h = F.zip_with(heard_base, heard_full, lambda b, f: F.struct(b.alias("b"), f.alias("f")))
    state = lambda x, y: F.when(y.isNull(), "missing").when(x.isNull(), "extra").when(x["f"] == y["f"], "perfect").when(x["b"] == y["b"], "tone_wrong").otherwise("wrong")
    return F.zip_with(a, h, state)


def attempt_score(status: Column, n: Column, heard_n: Column) -> Column:
    """Struct (pron, tone, score) of an array of statuses."""
    count = lambda *which: F.size(F.filter(status, lambda s: s.isin(*which)))
    return score_counts(count("perfect"), count("tone_wrong"), n, heard_n)


def score_counts(perfect: Column, tone_wrong: Column, n: Column, heard_n: Column) -> Column:
    """Struct (pron, tone, score) of the numbers of statuses; the order count / n * 100 is kept, it decides what is cut off."""
    share = lambda c: F.when(n > 0, (c / n * 100).cast("int")).otherwise(0)
    pron, tone = share(perfect + tone_wrong), share(perfect)
    raw = (pron * F.lit(0.5) + tone * F.lit(0.5)).cast("int") - F.least(F.lit(20), 5 * F.abs(n - heard_n))
    return F.struct(pron.alias("pron"), tone.alias("tone"), F.when(heard_n == 0, 0).otherwise(F.greatest(F.lit(0), raw)).alias("score"))


def feedback(score: Column, status: Column, chars: Column) -> Column:
    """A band and the first three characters with a wrong tone, and wrong or missing."""
    pick = lambda *which: F.array_join(F.slice(F.array_compact(F.zip_with(status, chars, lambda s, c: F.when(s.isin(*which), c))), 1, 3), "")
    return feedback_text(score, pick("tone_wrong"), pick("wrong", "missing"))


def feedback_text(score: Column, tones: Column, wrong: Column) -> Column:
    band = F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "practise").otherwise("again")
    return F.concat_ws(" ", band, F.when(tones != "", F.concat(F.lit("tone: "), tones)), F.when(wrong != "", F.concat(F.lit("wrong: "), wrong)))


def _codes(target: str, heard: str, base: np.ndarray) -> np.ndarray:
    """Positions of STATUS for each character of the longer text."""
    a, b = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (target, heard))
    n = min(len(a), len(b))
    out = np.full(max(len(a), len(b)), 3 if len(a) > n else 4, np.int8)
    out[:n] = np.where(a[:n] == b[:n], 0, np.where(base[a[:n]] == base[b[:n]], 1, 2))
    return out


def _base(toned: dict[str, str]) -> np.ndarray:
    base = np.arange(0x110000, dtype=np.uint32)
    base[[ord(c) for c in toned]] = [ord(c) for c in toned.values()]
    return base


def align_texts(target: Column, heard: Column, toned: dict[str, str]) -> Column:
    """`align_status` of whole texts by character, joined by commas; `toned` takes the tones off. Null if either is null.

    Python gives a digit for each character, since the words would make a batch some eight times its texts.
    """

    @F.arrow_udf("string")
    def digits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        base = _base(toned)
        for pairs in batches:
            out, ends, none = bytearray(), [0], []
            for a, b in zip(*pairs, strict=True):  # a text at a time becomes a string of Python
                a, b = a.as_py(), b.as_py()
                none.append(a is None or b is None)
                out += b"" if none[-1] else (_codes(a, b, base) + ord("0")).astype(np.uint8).tobytes()
                ends.append(len(out))
            absent = pa.array(np.packbits(~np.array(none, bool), bitorder="little")).buffers()[1]
            yield pa.StringArray.from_buffers(len(none), pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(out), absent)

    words = digits(target, heard)
    for i, name in enumerate(STATUS):
        words = F.replace(words, F.lit(str(i)), F.lit(name + ","))
    return F.rtrim(words, F.lit(","))


def compare_texts(target: Column, heard: Column, toned: dict[str, str]) -> Column:
    """Struct (perfect, tone_wrong, tones, wrong) of `align_texts`: two numbers, and the first three characters of each kind."""

    kind = pa.struct([("perfect", pa.int64()), ("tone_wrong", pa.int64()), ("tones", pa.string()), ("wrong", pa.string())])

    @F.arrow_udf("perfect long, tone_wrong long, tones string, wrong string")
    def compared(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        base = _base(toned)

        def one(a: str | None, b: str | None) -> tuple:
            if a is None or b is None:
                return None, None, None, None
            codes = _codes(a, b, base)
            first = lambda at: "".join(a[i] for i in np.flatnonzero(at)[:3])
            return int((codes == 0).sum()), int((codes == 1).sum()), first(codes == 1), first((codes == 2) | (codes == 3))

        for pairs in batches:  # a text at a time becomes a string of Python
            rows = [one(a, b) for a, b in zip(*map(_each, pairs), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))

    return compared(target, heard)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each character of `a`, cleared where the length grows; one step a character of `b`, with carries over any length."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if hit := row & at.get(x, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings of any length; null if one is null. Arrow batches."""

    def lengths(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array((None if s is None or t is None else _common(s, t) for s, t in zip(_each(x), _each(y), strict=True)), pa.int32(), size=len(x))

    return F.arrow_udf(lengths, "int")(a, b)


def _each(values: pa.Array) -> Iterator:
    return (v.as_py() for v in values)


def common_lengths(a: Column, b: Column) -> Column:
    """The same for the strings at equal places of two arrays: an array as long as the shorter one; null where a string is null."""

    def lengths(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pair = lambda s, t: None if s is None or t is None else _common(s, t)
        for x, y in batches:
            yield pa.array((None if s is None or t is None else [*map(pair, s, t)] for s, t in zip(_each(x), _each(y), strict=True)), pa.list_(pa.int32()), size=len(x))

    return F.arrow_udf(lengths, "array<int>")(a, b)


def edit_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (both lengths), 1 for two empty strings, null if one is null."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2 * common_length(a, b) / both)


def blend_score(kana: Column, latin: Column, word: Column, gap: Column) -> Column:
    """Weighted sum of three scores (integers up to 100), less for a length gap above 2."""
    raw = (kana * F.lit(0.6) + latin * F.lit(0.25) + word * F.lit(0.15)).cast("int")
    return F.when(gap > 2, F.greatest(F.lit(0), raw - F.least(F.lit(15), 2 * gap))).otherwise(raw)


def word_status(target: Column, heard: Column) -> Column:
    """Statuses of two word arrays by position: perfect, similar (edit ratio 0.6 or more), wrong, missing or extra."""
    words = F.arrays_zip(target.alias("a"), heard.alias("b"), common_lengths(target, heard).alias("n"))

    def status(x: Column) -> Column:
        ratio = 2 * x["n"] / (F.length(x["a"]) + F.length(x["b"]))
        return F.when(x["b"].isNull(), "missing").when(x["a"].isNull(), "extra").when(x["a"] == x["b"], "perfect").when(ratio >= 0.6, "similar").otherwise("wrong")

    return F.transform(words, status)


def word_band(score: Column) -> Column:
    return F.when(score >= 95, "perfect").when(score >= 80, "good").when(score >= 60, "close").otherwise("again")


def split_repeats(target: Column, heard: Column) -> Column:
    """Pieces of a heard text of the target's length, if it was said several times; else an empty array."""
    n = F.length(target)
    pieces = F.filter(F.transform(F.sequence(F.lit(0), F.ceil(F.length(heard) / n).cast("int") - 1), lambda i: F.substring(heard, i * n + 1, n)), lambda p: F.length(p) >= F.greatest(F.lit(2), n - 1))
    got = F.when((n >= 2) & (F.length(heard) >= n * 1.5), let(pieces, lambda p: F.when(F.size(p) > 1, p)))
    return F.coalesce(got, F.array().cast("array<string>"))


def score_repeats(target: Column, heard: Column, base: Callable[[Column], Column]) -> Column:
    """Array of (index, text, pron, tone, score) of a text said several times, each piece against the target; `base` takes the tones off."""

    def one(p: Column, i: Column) -> Column:
        status = align_status(characters(base(target)), characters(target), characters(base(p)), characters(p))
        r = let(status, lambda s: attempt_score(s, F.length(target), F.length(p)))
        return let(r, lambda x: F.struct((i + 1).alias("index"), p.alias("text"), x["pron"].alias("pron"), x["tone"].alias("tone"), x["score"].alias("score")))

    return F.transform(split_repeats(target, heard), one)
