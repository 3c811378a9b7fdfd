"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the lattice of pieces, and decoding.

A piece of rank r weighs (1 + r) ** -alpha (a Zipf law over the model's own order, since a BPE model has ranks and no
probabilities). The model is a file that the driver has; Spark ships it to the executors. The forward pass sums the weights of all segmentations up to each position; the backward pass draws, from
the end, each last piece with its share of that sum, so segmentations are exact samples. Every draw is a hash of the seed,
the row key and the position, and shares are rounded to integers (steps of 2 ** -31, at least one), whose sums are exact: a
row's segmentation is the same on every run, partitioning, batch size and retry.

No piece has a blank after another character, so the lattice falls into units (blanks and the word after them). A task
builds the lattice of each distinct unit once, for all of them side by side, and samples all occurrences together. Texts
go through in slices of about 260,000 characters, long ones cut between units.

Characters without a piece become byte pieces, as does a literal U+2581; so decoding gives the text back exactly.

Defined cases: a null text has null pieces and decodes to null; an empty text has none and decodes to an empty one; rows
with one key and one text get one segmentation; a null key counts as a key of its own; other columns are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK, LITERAL = 0x2581, 0x120000
SLICE, SOME = 1 << 18, 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
    return up, np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 2**64), np.uint64))])


class Pieces:
    """The pieces of a model by hash and length (after a mark for each start of a hash that some piece has), their log weights, and what each decodes to."""

    def __init__(self, model: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        self.text, plain, self.byte_ids = [b""] * len(ids), [], {}
        for i in ids:
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
                self.text[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((sp.id_to_piece(i), i))
                self.text[i] = sp.id_to_piece(i).replace("▁", " ").encode()
        if any("▁" in p.lstrip("▁") for p, _ in plain):
            raise ValueError("the model has pieces with a blank after another character")
        self.log = -alpha * np.log1p(np.arange(len(ids)))
        self.tables, hashes = {}, set()
        for size in sorted({len(p) for p, _ in plain}):
            own = [(p, i) for p, i in plain if len(p) == size]
            c = np.array([[ord(x) for x in p] for p, _ in own], np.uint64)
            h = (_mix(c) * _powers(size)[0][:size]).sum(1, dtype=np.uint64)
            order = np.argsort(h)
            some = np.zeros(1 << SOME, bool)
            some[h >> _U(64 - SOME)] = True
            self.tables[size] = (some, h[order], np.array([i for _, i in own])[order])
            hashes |= {(size, int(x)) for x in h}
        if len(hashes) != len(plain):
            raise ValueError("two pieces share a hash")

    def fallback(self, code: int) -> list[int]:
        return [self.byte_ids[b] for b in chr(BLANK if code == LITERAL else code).encode("utf-8", "surrogatepass")]


@cache
def pieces(model: str, alpha: float) -> Pieces:
    return Pieces(model, alpha)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(c == BLANK, LITERAL, c)
    return np.concatenate([[BLANK], np.where(c == 32, BLANK, c)])


def _sample(p: Pieces, c: np.ndarray, first: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the codes `c` and the code each begins at; `first` marks where a unit must begin, `draw` has 31 random bits for each code's end."""
    n = len(c)
    begin = np.flatnonzero(first | (np.concatenate([[False], c[:-1] != BLANK]) & (c == BLANK)))
    end = np.append(begin[1:], n)
    up, down = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), (_mix(c.astype(np.uint64)) * up[:n]).cumsum(dtype=np.uint64)])
    of_unit = _mix((total[end] - total[begin]) * down[begin]) ^ (end - begin).astype(np.uint64)
    _, one, kind = np.unique(of_unit, return_index=True, return_inverse=True)
    # distinct units side by side: local codes, and a node before each code and at the end
    size = (end - begin)[one]
    node0 = np.concatenate([[0], (size + 1).cumsum()[:-1]])
    unit = np.repeat(np.arange(len(one)), size)
    local = np.arange(len(unit)) - np.repeat(size.cumsum() - size, size)
    at, node, left = begin[one][unit] + local, node0[unit] + local, size[unit] - local
    tails, heads, ids = [], [], []
    single = np.zeros(len(at), bool)
    for length, (some, hashes, names) in p.tables.items():
        k = np.flatnonzero(left >= length)
        h = (total[at[k] + length] - total[at[k]]) * down[at[k]]
        maybe = np.flatnonzero(some[h >> _U(64 - SOME)])
        k, h = k[maybe], h[maybe]
        slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        ok = hashes[slot] == h
        tails.append(node[k[ok]])
        heads.append(node[k[ok]] + length)
        ids.append(names[slot[ok]])
        if length == 1:
            single[k[ok]] = True
    k = np.flatnonzero(~single)
    tails.append(node[k])
    heads.append(node[k] + 1)
    ids.append(-1 - c[at[k]])
    tail, head, piece = map(np.concatenate, (tails, heads, ids))
    log = np.empty(len(piece))
    log[piece >= 0] = p.log[piece[piece >= 0]]
    for code in np.unique(piece[piece < 0]):
        log[piece == code] = p.log[p.fallback(-1 - int(code))].sum()
    order = np.lexsort((tail, head))
    tail, head, piece, log = tail[order], head[order], piece[order], log[order]
    # forward: positions within the units, all units at once
    nodes = int(node0[-1] + size[-1] + 1)
    forward = np.full(nodes, -np.inf)
    forward[node0] = 0
    where = np.zeros(nodes, np.int64)
    where[node] = local
    where[node0 + size] = size
    step = where[head]
    by = np.argsort(step, kind="stable")
    bounds = np.searchsorted(step[by], np.arange(1, int(size.max()) + 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        e = by[a:b]
        if len(e):
            new = np.flatnonzero(np.concatenate([[True], head[e][1:] != head[e][:-1]]))
            forward[head[e[new]]] = np.logaddexp.reduceat(forward[tail[e]] + log[e], new)
    # shares as integers: sums of them are exact, so what stands elsewhere in the batch moves no draw
    share = np.maximum(np.rint(np.exp(forward[tail] + log - forward[head]) * 2**31).astype(np.int64), 1)
    run = np.concatenate([[0], share.cumsum()])
    edge0 = np.searchsorted(head, np.arange(nodes + 1))
    before = run[edge0]  # of all pieces of earlier nodes
    total = np.diff(before)
    # backward: all occurrences at once
    here, base, put = (node0 + size)[kind], node0[kind], begin - node0[kind]
    alive, got, got_at = np.arange(len(kind)), [], []
    while len(alive):
        at_ = here[alive]
        # a 31-bit draw picks a point below the node's total, which is a little over 2 ** 31 at most
        point, e = before[at_] + (draw[at_ + put[alive] - 1] * total[at_] >> 31), edge0[at_]
        on = np.flatnonzero(run[e + 1] <= point)
        while len(on):  # as often as a position has pieces at most
            e[on] += 1
            on = on[run[e[on] + 1] <= point[on]]
        here[alive] = tail[e]
        got.append(piece[e])
        got_at.append(tail[e] + put[alive])
        alive = alive[here[alive] > base[alive]]
    ids_at = np.full(n, np.iinfo(np.int64).min)  # a code begins one piece at most
    for where_, ids_ in zip(got_at, got, strict=True):
        ids_at[where_] = ids_
    got_at = np.flatnonzero(ids_at != np.iinfo(np.int64).min)
    got = ids_at[got_at]
    if (odd := np.flatnonzero(got < 0)).size:
        spelled = [p.fallback(-1 - int(x)) for x in got[odd]]
        times = np.ones(len(got), np.int64)
        times[odd] = [len(x) for x in spelled]
        hole = np.repeat(got < 0, times)
        got, got_at = np.repeat(got, times), np.repeat(got_at, times)
        got[hole] = np.concatenate(spelled)
    return got, got_at


def shipped(model: str) -> str:
    """The model's name among the files that Spark sends to the executors."""
    SparkSession.active().sparkContext.addFile(model)
    return os.path.basename(model)


def _uniform(seed: np.uint64, low: int, high: int) -> np.ndarray:
    """31 random bits for each position, from seed and position alone."""
    x = _mix(_mix(np.arange(low, high, dtype=np.uint64) + _U(_BASE)) ^ seed)
    return (x >> _U(33)).astype(np.int64)


def _encoded(p: Pieces, keys: list[int], texts: list[str | None], seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) in row order; a long row comes in several parts."""
    held, first, draws, owner, size = [], [], [], [], 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        sizes = np.array([len(x) for x in held])
        mark = np.zeros(sizes.sum(), bool)
        mark[np.concatenate([[0], sizes.cumsum()[:-1]])] = True
        ids, at = _sample(p, np.concatenate(held), mark, np.concatenate(draws))
        cuts = np.searchsorted(at, sizes.cumsum())
        yield from zip(owner, np.split(ids, cuts[:-1]), strict=True)

    for row, text in enumerate(texts):
        if not text:
            continue
        c = _codes(text)
        own = _mix(np.array([keys[row] % 2**64], np.uint64) + _U(seed % 2**32) * _U(_BASE))[0]
        cut = np.flatnonzero((c[1:] == BLANK) & (c[:-1] != BLANK)) + 1
        low = 0
        while low < len(c):
            k = np.searchsorted(cut, low + SLICE)
            high = int(cut[k]) if k < len(cut) else len(c)
            held.append(c[low:high])
            draws.append(_uniform(own, low, high))
            owner.append(row)
            size += high - low
            low = high
            if size >= SLICE:
                yield from flush()
                held, draws, owner, size = [], [], [], 0
    if held:
        yield from flush()


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """`key`, `text` and `pieces` (array of piece ids) of every row of `docs`."""
    kind, name = docs.schema[key].dataType.simpleString(), shipped(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(SparkFiles.get(name), alpha)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                texts = batch.column(1).to_pylist()
                parts: list[list[np.ndarray]] = [[] for _ in texts]
                for row, ids in _encoded(p, batch.column(2).to_pylist(), texts, seed):
                    parts[row].append(ids.astype(np.int32))
                sizes = [sum(map(len, x)) for x in parts]
                flat = np.concatenate([y for x in parts for y in x] or [np.zeros(0, np.int32)])
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                column = pa.ListArray.from_arrays(ends, pa.array(flat), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], names=["key", "text", "pieces"])

    df = docs.select(key, text, F.xxhash64(F.col(key).cast("string")).alias("_hash"))
    return df.mapInArrow(task, f"key {kind}, text string, pieces array<int>").withColumnsRenamed({"key": key, "text": text})


def decode(column: Column, model: str) -> Column:
    """The text of an array of piece ids."""
    name = shipped(model)

    @F.arrow_udf("string")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelled = pa.array(pieces(SparkFiles.get(name), 1.0).text, pa.large_binary())
        for batch in batches:
            texts = []
            for low in range(0, len(batch), 500):
                rows = batch.slice(low, 500)
                flat = spelled.take(rows.flatten())
                _, starts, data = flat.buffers()
                sizes = rows.value_lengths().fill_null(0).to_numpy()
                at = np.frombuffer(starts, np.int64)[np.concatenate([[0], sizes.cumsum()])]
                data = memoryview(data or b"")
                texts.append(pa.array([str(data[a + 1 : b], "utf-8", "replace") if r else None for a, b, r in zip(at[:-1], at[1:], rows.is_valid().to_pylist(), strict=True)], pa.string()))
            yield pa.concat_arrays(texts) if texts else pa.array([], pa.string())

    return udf(column)
