"""Exact removal of long byte strings that came before, by suffix arrays over shards.

Each string of `LENGTH` bytes (a window) goes to the shard of its least hash of `ANCHOR` bytes, so equal windows meet. Windows in
a row with the same least hash, the anchor, are a piece; pieces whose anchor comes once in the corpus hold nothing repeated and stay out. Of equal
pieces the first stands for all, and one that no other piece shares its anchor with isn't sorted; each batch of documents sends a piece once, and an anchor that it knows as repeated goes by
piece, so no anchor gathers more rows than there are batches. Anchors of very many different pieces are dealt by single windows; a window whose hash comes
once in the corpus is not repeated and stays out, and of equal ones that are hashed together one goes on. A shard's pieces are one text, in the order of documents, whose suffix array (`induced.py`: of the windows alone in memory, or of a larger text by external induced sorting) tells
what neighbours share: windows that share all bytes are equal, and all but the first of them are repeated.

Defined cases: matches end at documents; a null text is empty; documents count by doc_id, null first, and rows that share a
doc_id in the order of the table; an empty table gives an empty one. `docs` is read four times and must give the same rows in the same
partitions each time, as a written table does. Other columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import induced
from .common import Scratch

LENGTH, ANCHOR = 100, 32
WIDE = LENGTH - ANCHOR + 1
#: Different pieces of one anchor beyond which they are dealt by window.
MANY = 2000
#: Bytes that are hashed at once: what is made of them should stay in a core's cache.
SLICE = 1 << 16
#: Bytes of pieces in a batch for the shards.
SENT = 1 << 20
#: Bytes of a shard, on average: their suffix array takes some 60 times as much memory.
SHARD = 1 << 21
#: Bytes of a shard whose windows are sorted in memory.
IN_MEMORY = 1 << 22
ODD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(ODD), -1, 2**64))
BYTES = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """least over values[i : i + width] for each i that has as many."""
    have = 1
    while 2 * have <= width:
        values = least(values[:-have], values[have:])
        have *= 2
    return least(values[: have - width], values[width - have :]) if have < width else values


def cut(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces of slices that stand one after another: (start, windows, anchor, digest, whether the anchor comes twice in the piece)."""
    n = len(buffer)
    if n < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, bool))
    with np.errstate(over="ignore"):
        powers, back = np.cumprod(np.full(n, ODD)), np.cumprod(np.append(np.uint64(1), np.full(n, BACK)))
        sums = np.append(np.uint64(0), np.cumsum(BYTES[buffer] * powers))
        anchor = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * back[: n - ANCHOR + 1])
        least = sliding(anchor, WIDE, np.minimum)
        within = np.ones(n - LENGTH + 1, bool)
        for e in ends[:-1].tolist():
            within[max(0, e - LENGTH + 1) : e] = False
        new = within & np.append(True, (least[1:] != least[:-1]) | ~within[:-1])
        start = np.flatnonzero(new)
        without = np.append(np.flatnonzero(~within), len(within))
        stop = np.minimum(np.append(start[1:], len(within)), without[np.searchsorted(without, start)])
        # no piece has more than WIDE windows
        parts = -(-(stop - start) // WIDE)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * WIDE
        count = np.minimum(np.repeat(stop, parts) - start, WIDE)
        end = start + count + LENGTH - 1
        digest = mixed(mixed((sums[end] - sums[start]) * back[start]) + count.astype(np.uint64))
        # places that are the least of some window; two in a row with the same hash stand in one piece
        bounded = np.concatenate([np.zeros(WIDE - 1, np.uint64), least, np.zeros(WIDE - 1, np.uint64)])
        places = np.flatnonzero(anchor == sliding(bounded, WIDE, np.maximum))
        pair = np.flatnonzero(anchor[places[1:]] == anchor[places[:-1]])
        first, second = np.append(places[pair], n), np.append(places[pair + 1], n)
        twice = second[np.searchsorted(first, start)] <= start + count + WIDE - 2
    return start, count, least[start], digest, twice


def _pieces(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, anchor, digest, doc_id, rid, at, n): kind 0 is repeated, 1 a piece that may be, 2 one whose anchor is repeated, 3 says so to those of the anchor."""
    for batch in stream:
        texts, ids, rids = batch.column("text"), batch.column("doc_id"), batch.column("rid").to_numpy(zero_copy_only=False)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        found, held, of, offset, size = [], [], [], [], 0

        def hashed() -> None:
            if held:
                start, *more = cut(np.concatenate(held), np.cumsum([len(x) for x in held]))
                base = np.cumsum([0, *(len(x) for x in held)])
                which = np.searchsorted(base, start, "right") - 1
                found.append((np.array(of)[which], start - base[which] + np.array(offset)[which], *more))
                held.clear(), of.clear(), offset.clear()

        # in the order of documents, so that pieces are found in theirs
        for i in np.lexsort((rids, ids, known)).tolist():
            if (t := texts[i].as_py()) is None or len(t) < LENGTH:
                continue
            data = np.frombuffer(t, np.uint8)
            for a in range(0, len(data) - LENGTH + 1, SLICE):
                part = data[a : a + SLICE + LENGTH - 1]
                held.append(part), of.append(i), offset.append(a)
                size += len(part)
                if size >= SLICE:
                    hashed()
                    size = 0
        hashed()
        if not found:
            continue
        doc, at, n, anchor, digest, twice = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(anchor)
        new_anchor = np.append(True, anchor[order[1:]] != anchor[order[:-1]])
        some = np.flatnonzero(~(new_anchor & np.append(new_anchor[1:], True)))
        order[some] = order[some][np.lexsort((order[some], digest[order[some]], np.cumsum(new_anchor)[some]))]
        doc, at, n, anchor, digest, twice = (x[order] for x in (doc, at, n, anchor, digest, twice))
        first = new_anchor | np.append(True, digest[1:] != digest[:-1])
        group = np.cumsum(new_anchor) - 1
        sure = (np.bincount(group) > 1)[group] | (np.bincount(group, twice) > 0)[group]
        # repeated pieces that follow each other are one row
        again = np.flatnonzero(~first)
        again = again[np.lexsort((at[again], doc[again]))]
        joined = np.append(True, (doc[again][1:] != doc[again][:-1]) | (at[again][1:] != at[again][:-1] + n[again][:-1]))[: len(again)]
        heads = again[joined]
        lengths = np.add.reduceat(n[again], np.flatnonzero(joined)) if len(heads) else np.empty(0, np.int64)
        says = np.flatnonzero(new_anchor & sure)
        one = np.flatnonzero(first)
        rows = np.concatenate([heads, one, says])
        kind = np.concatenate([np.zeros(len(heads), np.int8), np.where(sure[one], 2, 1).astype(np.int8), np.full(len(says), 3, np.int8)])
        with np.errstate(over="ignore"):
            key = np.where(kind == 0, mixed(rids[doc[rows]].astype(np.uint64)), np.where(kind == 2, mixed(anchor[rows] + digest[rows]), anchor[rows]))
        length = n[rows]
        length[: len(heads)] = lengths
        id_array = pa.array(ids[doc[rows]], pa.int64(), mask=~known[doc[rows]])
        columns = [pa.array(x) for x in (key.view(np.int64), kind, anchor[rows].view(np.int64), digest[rows].view(np.int64))]
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([c.slice(i, 100_000) for c in (*columns, id_array, pa.array(rids[doc[rows]]), pa.array(at[rows]), pa.array(length.astype(np.int32)), pa.array(twice[rows]))], NAMES)


NAMES = ["key", "kind", "anchor", "digest", "doc_id", "rid", "at", "n", "twice"]
PIECE = "key long, kind byte, anchor long, digest long, doc_id long, rid long, at long, n int, twice boolean"


def _windows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the pieces of each document by 128 bits of a hash, `again` if an equal one that is hashed with them comes earlier."""
    for batch in stream:
        row, _, at, n = _flat(batch.column("pieces"))
        texts, ids, rids = [t.as_py() for t in batch.column("text")], batch.column("doc_id"), batch.column("rid").to_numpy(zero_copy_only=False)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for i, j in _cuts(n, SENT // 8):
            of, start = np.repeat(row[i:j], n[i:j]), np.repeat(at[i:j] - np.cumsum(n[i:j]) + n[i:j], n[i:j]) + np.arange(n[i:j].sum())
            digests = b"".join([hashlib.blake2b(texts[r][a : a + LENGTH], digest_size=16).digest() for r, a in zip(of.tolist(), start.tolist(), strict=True)])
            key, digest = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            order = np.lexsort((start, rids[of], ids[of], known[of], digest, key))
            key, digest = key[order], digest[order]
            again = np.append(False, (key[1:] == key[:-1]) & (digest[1:] == digest[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, digest, rids[of[order]], start[order], again)], ["key", "digest", "rid", "at", "again"])


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` in all."""
    cuts = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1)), len(sizes)).tolist()
    return zip(cuts[:-1], cuts[1:], strict=True)


def _flat(pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, at, n) of the pieces of a batch's rows."""
    row = np.repeat(np.arange(len(pieces)), pieces.value_lengths().to_numpy(zero_copy_only=False))
    return row, *(x.to_numpy(zero_copy_only=False) for x in pieces.flatten().flatten())


def _sliced(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the pieces of each document."""
    for batch in stream:
        row, key, at, n = _flat(batch.column("pieces"))
        texts = [t.as_py() for t in batch.column("text")]
        for i, j in _cuts(n + (LENGTH - 1), SENT):
            data = [texts[r][a : a + m + LENGTH - 1] for r, a, m in zip(row[i:j].tolist(), at[i:j].tolist(), n[i:j].tolist(), strict=True)]
            ids, rids = (batch.column(c).take(pa.array(row[i:j])) for c in ("doc_id", "rid"))
            yield pa.RecordBatch.from_arrays([pa.array(key[i:j]), pa.array(data, pa.binary()), ids, rids, pa.array(at[i:j]), pa.array(n[i:j])], ["key", "data", "doc_id", "rid", "at", "n"])


def repeated_starts(text: np.ndarray, n: int, starts: np.ndarray, counts: np.ndarray, memory: int = 1 << 25) -> np.ndarray:
    """Which windows equal one further left: of a text of pieces, each of bytes plus 1 and a 0, that begin at `starts` with `counts` windows."""
    marked = induced.disk_array(bool, n)
    if n <= IN_MEMORY:
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        pos, same = induced.sparse(text, np.repeat(starts, counts) + nth, LENGTH)
        twice = same | np.append(same[1:], False)
        _mark(marked, pos[twice], same[twice], starts, counts)
        return marked
    rest = np.empty(0, np.int64)  # of a group that may go on
    for pos, lcp, _ in induced.suffixes(text, n, 256, LENGTH, memory):
        same = lcp >= LENGTH
        pos, same = np.append(rest, pos), np.append(np.arange(len(rest)) > 0, same)
        heads = np.flatnonzero(~same)
        last = heads[-1]
        rest, pos, same = pos[last:], pos[:last], same[:last]
        twice = same | np.append(same[1:], False)
        _mark(marked, pos[twice], same[twice], starts, counts)
    if len(rest) > 1:
        _mark(marked, rest, np.arange(len(rest)) > 0, starts, counts)
    return marked


def _mark(marked: np.ndarray, pos: np.ndarray, same: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
    if len(pos):
        begin = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(pos, begin), np.diff(np.append(begin, len(pos))))
        later = pos[pos != least]
        piece = np.searchsorted(starts, later, "right") - 1
        marked[later[later - starts[piece] < counts[piece]]] = True


def _sorted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of a shard, whose pieces come in the order of documents, as rows (rid, at, n)."""
    import tempfile

    rids, ats, counts, sizes = [], [], [], []
    with tempfile.TemporaryFile() as f:
        for batch in stream:
            if not len(batch):
                continue
            data = batch.column("data")
            ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset)
            size = np.diff(ends)
            part = np.zeros(int(size.sum()) + len(size), np.uint8)
            part[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]] + np.uint8(1)
            f.write(part)
            sizes.append(size + 1)
            for to, c in ((rids, "rid"), (ats, "at"), (counts, "n")):
                to.append(batch.column(c).to_numpy(zero_copy_only=False))
        if not rids:
            return
        f.flush()
        rids, ats, counts, sizes = (np.concatenate(x) for x in (rids, ats, counts, sizes))
        starts = np.cumsum(np.append(0, sizes[:-1]))
        n = int(sizes.sum())
        text = np.memmap(f, np.uint8, "r", shape=(n,))
        marked = repeated_starts(text, n, starts, counts)
        for i in range(0, len(starts), 10_000):
            a, b = starts[i], starts[i] + sizes[i] if i == len(starts) - 1 else (starts[i + 10_000] if i + 10_000 < len(starts) else n)
            on = np.diff(np.concatenate([[0], marked[a:b].astype(np.int8), [0]]))
            begin, end = np.flatnonzero(on == 1), np.flatnonzero(on == -1)
            piece = np.searchsorted(starts, a + begin, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(rids[piece]), pa.array(ats[piece] + a + begin - starts[piece]), pa.array((end - begin).astype(np.int32))], ["rid", "at", "n"])


def _removed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        spans = batch.column("spans")
        row = np.repeat(np.arange(len(batch)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at, n = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        # ends in the order of rows, so that the furthest so far is of the same row or before its start
        far = np.maximum.accumulate(row * 2**40 + at + n[order] + (LENGTH - 1))
        new = np.append(True, row[1:] * 2**40 + at[1:] > far[:-1])[: len(row)]
        start, end, row = at[new], far[np.append(new[1:], True)[: len(new)]], row[new]
        end = end - row * 2**40
        cuts = np.searchsorted(row, np.arange(len(batch) + 1))
        kept, sizes, starts, ends = [], [], start.tolist(), end.tolist()
        for t, i, j in zip(batch.column("text"), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            t = t.as_py() or b""
            sizes.append(len(t))
            kept.append(b"".join(t[a:b] for a, b in zip([0, *ends[i:j]], [*starts[i:j], len(t)], strict=True)) if i < j else t)
        spans = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_bytes, `spans` (array of start, end: bytes that are repeated) and `kept`, the other bytes, for each row of `docs`.

    Tables on the way lie in `scratch`, which the caller clears when the result is written.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("binary").alias("text"))
    found = scratch.table(_candidates(docs), "found")
    scratch.free()
    # a piece may have a first among those sent by anchor and one among those sent by piece
    order = Window.partitionBy("anchor", "digest").orderBy(F.col("doc_id").asc_nulls_first(), "rid", "at")
    first = scratch.table(found.filter("not again").withColumn("again", F.row_number().over(order) > 1), "first")
    scratch.free()
    by_suffix = scratch.table(_by_suffix(docs, first, scratch), "by_suffix")
    scratch.free()
    spans = found.filter("again").unionByName(first.filter("again")).select("rid", "at", "n").unionByName(by_suffix)
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return docs.join(spans, "rid", "left").mapInArrow(_removed, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _candidates(docs: DataFrame) -> DataFrame:
    """Pieces whose anchor is repeated, `again` if an equal piece comes earlier."""
    pieces = docs.mapInArrow(_pieces, PIECE).repartition(F.col("key"))
    order = Window.partitionBy("key").orderBy("digest", F.col("doc_id").asc_nulls_first(), "rid", "at")
    piece = F.col("kind").isin(1, 2)
    before = F.lag(F.when(piece, F.col("digest"))).over(order)
    alone = F.lag("kind").over(order).isNull() & F.lead("kind").over(order).isNull()
    pieces = pieces.withColumn("_again", F.coalesce(before == F.col("digest"), F.lit(False)) & piece).withColumn("_alone", alone)
    pieces = pieces.filter((F.col("kind") == 0) | (F.col("kind") == 2) | (F.col("kind") == 1) & ~F.col("_alone"))
    return pieces.select("anchor", "digest", "doc_id", "rid", "at", "n", "twice", ((F.col("kind") == 0) | F.col("_again")).alias("again"))


def _by_suffix(docs: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """Windows (rid, at, n) of first pieces that come earlier, by the suffix arrays of the shards."""
    # an anchor of one piece that holds it once has no more to compare
    anchors = first.filter("not again").groupBy("anchor").agg(F.count("*").alias("_n"), F.max("twice").alias("_twice")).filter("_n > 1 or _twice")
    sent = first.filter("not again").join(anchors.select("anchor", (F.col("_n") > MANY).alias("many")), "anchor")
    sent = scratch.table(sent.select("rid", F.col("anchor").alias("key"), "at", "n", "many"), "sent")
    # of an anchor with many, windows that equal none stay out: what they share is shorter
    windows = scratch.table(_with_pieces(docs, sent.filter("many")).mapInArrow(_windows, "key long, digest long, rid long, at long, again boolean"), "windows")
    alike = windows.filter("not again").withColumn("_n", F.count("*").over(Window.partitionBy("key", "digest"))).filter("_n > 1")
    alike = scratch.table(alike.select("rid", "key", "at", F.lit(1).alias("n")), "alike")
    sent = sent.filter("not many").drop("many").unionByName(alike)
    size = sent.agg(F.sum(F.col("n") + (LENGTH - 1))).first()[0] or 0
    shards = _with_pieces(docs, sent).mapInArrow(_sliced, "key long, data binary, doc_id long, rid long, at long, n int")
    shards = shards.repartition(max(1, -(-size // SHARD)), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "rid", "at")
    return windows.filter("again").select("rid", "at", F.lit(1).alias("n")).unionByName(shards.mapInArrow(_sorted, "rid long, at long, n int"))


def _with_pieces(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    return docs.join(pieces.groupBy("rid").agg(F.collect_list(F.struct("key", "at", "n")).alias("pieces")), "rid")
