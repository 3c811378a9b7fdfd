"""Periodic runs of words, found online by catchers of squares.

A text of n words has, for each level b = 8, 16, 32 ..., its completed blocks of b words, aligned to multiples of b. The catcher
of a block waits for the block to come again b to 2b - 1 words later (at the lowest level from 1 word later on). A run of period
q has at least 2q words, and 16, that equal the word q later, so it holds a whole block of the level of q, whose catcher sees it. For each
appended word each level compares one pair of hashes: of the block and of the suffix. A hit is compared word by word to both
sides; squares with the same period and the same stretch of words are one run. The work is n log n, and batches of any size,
single words included, give the same runs (tested).

Defined cases: a null text has no words and no runs, its collapsed text is empty; repeated rows each have their runs; an
empty table gives an empty one; columns of the table stay as they are, but those that are added take the place of namesakes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOWEST = 8
#: A run has `TIMES` periods and `SHORTEST` words at least. The lowest level needs SHORTEST - LOWEST >= 2 * LOWEST - 1.
TIMES, SHORTEST = 3, 24
RATIO = np.uint64(0x9E3779B97F4A7C15)
WORD = r"[^\x20\x09-\x0D]+"
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def mixed(ids: np.ndarray) -> np.ndarray:
    """64 well spread bits of each number."""
    z = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(27))


class Catchers:
    """Runs of a growing sequence of word numbers."""

    def __init__(self) -> None:
        self.n = 0
        self.x = np.empty(0, np.int64)
        self.sums = np.zeros(1, np.uint64)  # of word hashes times RATIO ** position
        self.powers = np.ones(1, np.uint64)
        self.until, self.period = np.empty(0, np.int64), np.empty(0, np.int64)  # of a known run over each word
        self.done: dict[int, int] = {}  # starts of suffixes that a level has compared
        self.open: list[list[int]] = []  # stretches [start, period, end of equality] that reach the end of the text
        self.closed: list[tuple[int, int, int]] = []

    def _grown(self, old: np.ndarray, n: int) -> np.ndarray:
        if n <= len(old):
            return old
        new = np.zeros(max(n, 2 * len(old)), old.dtype)
        new[: len(old)] = old
        return new

    def append(self, ids: np.ndarray) -> None:
        n0, self.n = self.n, self.n + len(ids)
        n = self.n
        for name in ("x", "until", "period"):
            setattr(self, name, self._grown(getattr(self, name), n))
        self.sums, self.powers = self._grown(self.sums, n + 1), self._grown(self.powers, n + 1)
        self.x[n0:n] = ids
        with np.errstate(over="ignore"):
            self.powers[n0 + 1 : n + 1] = self.powers[n0] * np.cumprod(np.full(n - n0, RATIO))
            self.sums[n0 + 1 : n + 1] = self.sums[n0] + np.cumsum(mixed(self.x[n0:n]) * self.powers[n0:n])
        waiting, self.open = self.open, []
        for start, q, end in waiting:
            self._keep(start, q, self._forward(end, q))
        b = LOWEST
        while TIMES * b <= n:
            self._level(b)
            b *= 2

    def _level(self, b: int) -> None:
        first, last = self.done.get(b, 0), self.n - b + 1
        self.done[b] = last
        u = np.arange(first, last)
        if b == LOWEST:  # shorter periods first: their runs hold those of their multiples
            self._hits(u, u // b * b, b)
        self._hits(u, (u // b - 1) * b, b)

    def _hits(self, u: np.ndarray, block: np.ndarray, b: int) -> None:
        """Of suffixes that start at `u` with the blocks whose catchers wait for them."""
        fits = (block >= 0) & (block < u)
        u, block = u[fits], block[fits]
        with np.errstate(over="ignore"):
            same = self.sums[u + b] - self.sums[u] == (self.sums[block + b] - self.sums[block]) * self.powers[u - block]
        u, block = u[same], block[same]
        q = u - block
        new = ~self._known(block, u + b, q)
        order = np.lexsort((u[new], q[new]))
        seen = (0, 0, 0)  # period and ends of the last stretch
        for i, p in zip(block[new][order].tolist(), q[new][order].tolist(), strict=True):
            if p == seen[0] and seen[1] <= i and i + b <= seen[2] or self._known(i, i + p + b, p):
                continue
            if not np.array_equal(self.x[i : i + b], self.x[i + p : i + p + b]):
                continue  # equal hashes of unequal words
            start, end = self._backward(i, p), self._forward(i + b, p)
            seen = (p, start, end)
            self._keep(start, p, end)

    def _known(self, start: np.ndarray | int, end: np.ndarray | int, q: np.ndarray | int) -> np.ndarray | bool:
        """Whether a run is known that holds these words and whose period divides q."""
        return (self.until[start] >= end) & (q % np.maximum(self.period[start], 1) == 0)

    def _forward(self, i: int, q: int) -> int:
        """The first place from i on that differs from the one q later, or has none."""
        size = 64
        while (m := min(size, self.n - q - i)) > 0:
            unequal = self.x[i : i + m] != self.x[i + q : i + q + m]
            at = int(unequal.argmax())
            if unequal[at]:
                return i + at
            i, size = i + m, 2 * size
        return i

    def _backward(self, i: int, q: int) -> int:
        """The first of the places before i that, up to i, equal those q later."""
        size = 64
        while (m := min(size, i)) > 0:
            unequal = self.x[i - m : i] != self.x[i - m + q : i + q]
            if unequal.any():
                return i - int(unequal[::-1].argmax())
            i, size = i - m, 2 * size
        return i

    def _keep(self, start: int, q: int, end: int) -> None:
        """Files a stretch whose words before `end` equal those q later."""
        stop = end + q
        if stop - start >= max(SHORTEST, TIMES * q):
            until, period = self.until[start:stop], self.period[start:stop]
            better = (until < stop) | (until == stop) & (period > q)
            until[better], period[better] = stop, q
            if stop < self.n:
                self.closed.append((start, stop, q))
        if stop == self.n and [start, q, end] not in self.open:
            self.open.append([start, q, end])

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run so far; of the periods of the same words the smallest."""
        least: dict[tuple[int, int], int] = {}
        ended = [(s, e + q, q) for s, q, e in self.open if e + q - s >= max(SHORTEST, TIMES * q)]
        for start, stop, q in [*self.closed, *ended]:
            least[start, stop] = min(q, least.get((start, stop), q))
        return sorted((start, stop - start, q) for (start, stop), q in least.items())


def found(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of one text."""
    if len(words) < SHORTEST:
        return []
    numbers: dict[bytes, int] = {}
    catchers = Catchers()
    catchers.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    return catchers.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text with one period of each run, its words joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


def with_runs(df: DataFrame, text: Column) -> DataFrame:
    """Adds n_words, `runs` (array of start, length, period by start, then period), the one with the greatest exact exponent (ties: smallest start, then period) and the collapsed text."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("longest", RUN), T.StructField("collapsed", T.StringType())]
    rest = [c for c in df.columns if c not in {f.name for f in added}]
    name = max([*rest, "_text"], key=len) + "_"  # no column has it
    kinds = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            n, runs, best, out = [], [], [], []
            for t in batch.column(len(rest)).cast(pa.binary()):
                words = (t.as_py() or b"").split()
                got = found(words)
                n.append(len(words))
                runs.append([dict(zip(RUN.names, r, strict=True)) for r in got])
                best.append(dict(zip(RUN.names, min(got, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])), strict=True)) if got else None)
                out.append(collapsed(words, got).decode())
            made = [pa.array(n, pa.int64()), pa.array(runs, kinds), pa.array(best, kinds.value_type), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *made], [*rest, *(f.name for f in added)])

    schema = T.StructType([df.schema[c] for c in rest] + added)
    return df.select(*rest, text.alias(name)).mapInArrow(batches, schema)
