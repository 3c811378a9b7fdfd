"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

1. A shingle weighs tf * idf with idf = 1 + ln(N / df) / ln(COMMON), the last part between 0 and 1 and in `STEPS` steps: shingles in
   less than a hundredth of the texts weigh 2, those in all texts 1. (Plain idf, without the 1, would make the shingles that a
   large group of near copies shares worthless by the group's own size, and the group would fall apart.) So only the
   frequencies of common shingles matter. They are counted exactly over all texts, in two passes: a count-min sketch of fixed
   size, which never counts too little and whose noise is a fixed share of N (the mean shingles of a text over `WIDTH`)
   whatever N is, tells which shingles may be common; their texts are then counted. Fewer than about 80 times the mean
   shingles of a text can be common, so what reaches the driver does not grow with the corpus.
2. ICWS draws `BANDS * ROWS` samples from each text's weighted set: the k-th samples of two texts agree with the
   probability of their weighted Jaccard similarity. Random numbers come from tables of `TABLE` rows, chosen by shingle hash;
   shingles of one row and weight are told apart by their hashes, of which the smallest counts, so in texts of many more
   shingles than rows a sample is a min-hash among those of its best row, and two samples depend on each other only if they
   have the same best row.
3. Equal texts collapse to the one with the smallest id. Texts that share a band bucket with another get a sketch of `WIDE`
   further samples. In blocks of at most `BLOCK` texts of its largest bucket, every text is paired with the earlier one that its
   sketch agrees with most; what is verified joins groups, and texts that are left over are paired so in all their buckets. Then every pair of a bucket whose texts are in different groups
   and whose sketches agree as those of a link do (to `SIGMAS` standard deviations) is verified as well. Pairs within a
   group change no class, so a bucket of copies is not expanded into all its pairs.
4. Candidates are verified by exact weighted Jaccard similarity on whole texts; links give classes by large-star/small-star.

Joins on digests, buckets and hubs broadcast the keys that hold over a thousandth of the rows (fewer than a thousand), so
no task gets one whole. Tables on the way are deleted when the classes are written.

Words are lower-cased and split at ASCII white space; a text of fewer words than a shingle is one shingle.

Defined cases: texts that are null or have no word are alone in their class (class_id is their doc_id); rows that share a
doc_id are one document, equal or not, of which `keep_one` keeps the row with the smallest digest of its text; a null doc_id
has a null class; ties in samples go to the smaller hash; very long texts are taken whole; an empty table gives an empty
one; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_hot, written

SHINGLE, BANDS, ROWS, TABLE = 5, 20, 5, 2048
SAMPLES = BANDS * ROWS
WIDTH, DEPTH, STEPS, COMMON, FEW = 1 << 19, 2, 16, 100, 128
SOME = 18  # bits of a hash by which most shingles are told not to be common
PIECE, CACHED = 1 << 13, 1 << 18
WIDE, BLOCK, SIGMAS = 512, 512, 4
CHUNK = 1024  # shingles whose samples are drawn at once; a power of two
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_FACTOR = 1 + np.arange(STEPS + 1) / STEPS
_MUL = _rng.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) | _U(1)
assert ROWS <= SHINGLE  # the multipliers serve both


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1 to n of a fixed odd number, and those of its inverse from 0."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.cumprod(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 2**64)))
    return up, np.concatenate([[_U(1)], down])


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text and their counts."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~_SPACE[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a word's hash is a difference of running sums, moved to power 1
    up, down = _powers(CACHED) if len(b) <= CACHED else _powers.__wrapped__(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    words = _mix((total[ends] - total[starts]) * down[starts])
    n = len(words)
    if n < SHINGLE:
        h = (words * _MUL[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n) * _MUL[SHINGLE]
    else:
        h = sum(words[k : n - SHINGLE + 1 + k] * _MUL[k] for k in range(SHINGLE))
    h = np.sort(_mix(h))
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.diff(np.append(at, len(h)))


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> _U(24 * d)) % _U(WIDTH)).astype(np.int64) for d in range(DEPTH)]


def sketch(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The count-min sketch of document frequencies (DEPTH x WIDTH counters, whatever the input), and the number of texts with a word.

    Tasks emit pieces of their counters; these are added by piece and salt first, so no group grows with the tasks.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros((DEPTH, WIDTH), np.int64), 0
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                found = [shingles(t)[0] for t in pdf["text"].iloc[a : a + 500]]
                n += sum(len(h) > 0 for h in found)
                for d, at in enumerate(_slots(np.concatenate(found))):
                    sums[d] += np.bincount(at, minlength=WIDTH)
        if n:
            flat = sums.reshape(-1, PIECE)
            salt = int(flat.sum()) % 64
            small = np.int32 if sums.max() < 2**31 else np.int64
            yield pd.DataFrame({"piece": range(len(flat)), "salt": salt, "n": n, "counts": [x.astype(small).tobytes() for x in flat]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.int64 if len(x) == 8 * PIECE else np.int32)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "salt": [pdf["salt"].iloc[0]], "n": [pdf["n"].sum()], "counts": [total.tobytes()]})

    kind = "piece int, salt int, n long, counts binary"
    got = docs.select("text").mapInPandas(count, kind)
    got = got.groupBy("piece", "salt").applyInPandas(add, kind).groupBy("piece").applyInPandas(add, kind)
    rows = got.collect()  # DEPTH * WIDTH / PIECE of them
    sums = np.zeros((DEPTH * WIDTH // PIECE, PIECE), np.int64)
    for r in rows:
        sums[r["piece"]] = np.frombuffer(r["counts"], np.int64)
    return sums.reshape(DEPTH, WIDTH), int(rows[0]["n"]) if rows else 0


def rarity(df: np.ndarray, texts: int) -> np.ndarray:
    """Steps (0 to STEPS) of document frequencies; of few texts a shingle in one of them is rare all the same."""
    share = np.log(max(texts, FEW) / np.maximum(df, 1)) / np.log(COMMON)
    return np.clip(np.round(share * STEPS), 0, STEPS).astype(np.uint8)


def document_frequencies(docs: DataFrame) -> Corpus:
    """The steps of all shingles below the last step, from exact counts over all texts."""
    counts, texts = sketch(docs)
    maybe = docs.sparkSession.sparkContext.broadcast(rarity(counts, texts) < STEPS)  # DEPTH x WIDTH bytes

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may, all_h, all_n = maybe.value, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                h = np.concatenate([shingles(t)[0] for t in pdf["text"].iloc[a : a + 500]])
                for m, slots in zip(may, range(DEPTH), strict=True):
                    h = h[m[_slots(h)[slots]]]
                all_h, where = np.unique(np.concatenate([all_h, h]), return_inverse=True)
                all_n = np.bincount(where, np.concatenate([all_n, np.ones(len(h), np.int64)]), len(all_h)).astype(np.int64)
        yield pd.DataFrame({"h": all_h.view(np.int64), "n": all_n})

    got = docs.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # a share of the texts that the last step no longer rounds to, with some room; exact steps are taken below
    got = got.filter(F.col("n") >= int(max(texts, FEW) / COMMON)).collect()
    h, n = np.array([r["h"] for r in got], np.int64).view(np.uint64), np.array([r["n"] for r in got], np.int64)
    return Corpus(h, rarity(n, texts))


class Corpus:
    """The steps of common shingles; all others have the last step."""

    def __init__(self, h: np.ndarray, steps: np.ndarray):
        order = np.argsort(h[steps < STEPS])
        self.h, self.steps = h[steps < STEPS][order], steps[steps < STEPS][order]
        self.some = np.zeros(1 << SOME, bool)
        self.some[self.h >> _U(64 - SOME)] = True

    def step(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), STEPS, np.int64)
        at = np.flatnonzero(self.some[h >> _U(64 - SOME)])
        if len(at):
            k = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
            hit = self.h[k] == h[at]
            out[at[hit]] = self.steps[k[hit]]
        return out


def weights(h: np.ndarray, tf: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the shingles, and their idf steps."""
    step = corpus.step(h)
    return tf * _FACTOR[step], step


class Sampler:
    """`n` consistent samples of weighted sets; random numbers come from fixed tables."""

    def __init__(self, n: int):
        rng = np.random.Generator(np.random.PCG64([20240229, n]))
        self.n = n
        self.r = rng.gamma(2, 1, (TABLE, n)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (TABLE, n))).astype(np.float32)
        self.beta = rng.random((TABLE, n)).astype(np.float32)
        # the order of ln a for every idf step and table row at tf = 1, so that most shingles need one look-up
        every = np.arange(TABLE)
        self.usual = np.empty(((STEPS + 1) * TABLE, n), np.int32)  # filled in place: 71 MB for a sketch
        for s in range(STEPS + 1):
            self.usual[s * TABLE : (s + 1) * TABLE] = self._draw(_log_weight(np.ones(1), np.full((TABLE, 1), s)), every)

    def _draw(self, log_w: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The samples' order, a row for each shingle, as integers whose last bits are free; log_w is a column."""
        t = np.floor(log_w / self.r[j] + self.beta[j])
        bits = (self.log_c[j] - self.r[j] * (t - self.beta[j] + 1)).astype(np.float32).view(np.int32)
        return (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))) & np.int32(~(CHUNK - 1))

    def samples(self, found: list[tuple[np.ndarray, np.ndarray]], corpus: Corpus) -> np.ndarray:
        """Hashes of the samples (shingle, t) of texts' weighted shingles, a row for each text; none is empty."""
        h, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.cumsum([len(x) for x, _ in found])
        step = weights(h, tf, corpus)[1]
        j = ((h ^ (h >> _U(32))) % _U(TABLE)).astype(np.int64)
        row, often, local = step * TABLE + j, np.flatnonzero(tf > 1), np.arange(CHUNK, dtype=np.int32)[:, None]
        who, a = np.empty((len(found), self.n), np.int64), 0
        for k, end in enumerate(ends):
            low = None
            for c in range(a, end, CHUNK):
                d = min(c + CHUNK, end)
                value = self.usual.take(row[c:d], axis=0)
                if (more := often[slice(*np.searchsorted(often, (c, d)))]).size:
                    value[more - c] = self._draw(_log_weight(tf[more], step[more])[:, None], j[more])
                value |= local[: d - c]  # the least value has its row in the last bits
                best = value.min(0)
                at, best = (best & (CHUNK - 1)) + c, best & ~(CHUNK - 1)
                if low is None:
                    low, who[k] = best, at
                else:
                    less = best < low
                    low, who[k] = np.where(less, best, low), np.where(less, at, who[k])
            a = end
        every = np.arange(self.n)
        t = np.floor(_log_weight(tf[who], step[who]) / self.r[j[who], every] + self.beta[j[who], every]).astype(np.int64)
        return _mix(h[who] + t.astype(np.uint64) * _MUL[0])


def _log_weight(tf: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.log(tf * _FACTOR[step]).astype(np.float32)


sampler = cache(Sampler)


def signatures(found: list[tuple[np.ndarray, np.ndarray]], corpus: Corpus) -> np.ndarray:
    """A key for each band, from SAMPLES samples, of each text."""
    sample = sampler(SAMPLES).samples(found, corpus).reshape(-1, BANDS, ROWS)
    return _mix((sample * _MUL[:ROWS]).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1).astype(np.uint64) * _MUL[SHINGLE]).view(np.int64)


def signature(h: np.ndarray, tf: np.ndarray, corpus: Corpus) -> np.ndarray:
    return signatures([(h, tf)], corpus)[0]


def sketches(found: list[tuple[np.ndarray, np.ndarray]], corpus: Corpus) -> np.ndarray:
    """A byte of each of WIDE samples of each text."""
    return sampler(WIDE).samples(found, corpus).astype(np.uint8)


def _in_groups(texts: pd.Series) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The shingles of the texts, some texts at a time."""
    for a in range(0, len(texts), 64):
        yield [shingles(t) for t in texts.iloc[a : a + 64]]


def similarity(a: tuple, b: tuple, corpus: Corpus) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    wa, wb = weights(*a, corpus)[0], weights(*b, corpus)[0]
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(wa[ia], wb[ib]).sum()
    return float(both / (wa.sum() + wb.sum() - both)) if both else 0.0


def signed(docs: DataFrame, shared, scratch: Scratch) -> DataFrame:
    """doc_id, digest of the text and band keys of every document with an id and a word."""

    @F.pandas_udf("array<long>")
    def bands(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        corpus = shared.value
        for s in texts:
            keys = []
            for found in _in_groups(s):
                full = [x for x in found if len(x[0])]
                some = iter(signatures(full, corpus) if full else ())
                keys += [next(some) if len(x[0]) else None for x in found]
            yield pd.Series(keys, dtype=object)

    df = docs.filter("doc_id is not null and text is not null").select("doc_id", F.md5("text").alias("digest"), bands("text").alias("bands"))
    return scratch.table(df, "signed").filter(F.col("bands").isNotNull())  # a filter before the writing would run the function twice


def verified(pairs: DataFrame, texts: DataFrame, shared, scratch: Scratch) -> DataFrame:
    """a, b and the weighted Jaccard similarity of the candidate pairs; `texts` has id and text."""
    df = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    df = df.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    @F.pandas_udf("double")
    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        corpus = shared.value
        kept = lru_cache(64)(shingles)  # pairs of a text come one after the other
        for left, right in batches:
            yield pd.Series([similarity(shingles(x), kept(y), corpus) for x, y in zip(left, right, strict=True)], dtype=float)

    df = df.select("a", "b", compare("text_a", "text_b").alias("sim"))
    return scratch.table(df.groupBy("a", "b").agg(F.max("sim").alias("sim")), "verified")


def sketched(buckets: DataFrame, docs: DataFrame, shared, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The members of buckets of two texts or more: key, id, n (of the bucket), lead (its smallest id), own (whether it is the text's largest bucket), marks (band keys, then the sketch); their texts."""
    buckets = scratch.table(buckets, "buckets")
    first = scratch.table(buckets.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1"), "leads")
    pool = scratch.table(join_hot(buckets, first, "key", "n", buckets.count()), "pool")

    @F.pandas_udf("binary")
    def marks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        corpus = shared.value
        for s in texts:
            yield pd.Series([a.tobytes() + b.tobytes() for found in _in_groups(s) for a, b in zip(signatures(found, corpus), sketches(found, corpus), strict=True)], dtype=object)

    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), "text")
    texts = texts.join(pool.select("id", "digest").distinct(), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    texts = scratch.table(texts.withColumn("marks", marks("text")), "sketches")
    largest = Window.partitionBy("id", "digest").orderBy(F.desc("n"), "key")
    pool = pool.withColumn("own", F.row_number().over(largest) == 1)
    return pool.join(texts.drop("text"), ["id", "digest"]).select("key", "id", "n", "lead", "own", "marks"), texts


def _agreeing(group: pd.DataFrame, need: int, pick: str) -> list[tuple[int, int]]:
    """Pairs of a block whose sketches agree in `need` samples.

    "own": for each text, in its own bucket, the best earlier one; "rest": for each text of another root than the lead's the
    best one of another root; "all": all of different roots and sides.
    """
    raw = np.frombuffer(b"".join(group["marks"]), np.uint8).reshape(len(group), -1)
    bands, wide = np.ascontiguousarray(raw[:, : 8 * BANDS]).view(np.int64), np.ascontiguousarray(raw[:, 8 * BANDS :])
    ids, roots, sides, key = group["id"].to_numpy(), group["root"].to_numpy(), group["side"].to_numpy(), group["key"].iloc[0]
    every, found = pick == "all", []
    mine = group["own"].to_numpy() if pick == "own" else roots != roots[0] if pick == "rest" else np.ones(len(group), bool)
    for i in np.flatnonzero(mine).tolist():
        to = len(group) if pick == "rest" else i
        other = roots[:to] != roots[i]
        if every:
            other &= (sides[:i] != sides[i]) | (sides[i] == 2)
        if not other.any():
            continue
        same = np.where(other, (wide[:to] == wide[i]).sum(1), -1)
        if not every:
            if same[j := int(same.argmax())] >= need:
                found.append((ids[i], ids[j]))
            continue
        for j in np.flatnonzero(same >= need):
            shared = bands[j] == bands[i]
            if bands[i][shared.argmax()] == key:  # a pair of several buckets counts in its first
                found.append((ids[i], ids[j]))
    return found


def agreeing(blocks: DataFrame, least: float, pick: str) -> DataFrame:
    """Pairs (a, b) of texts of a block (key, left, right), a > b; blocks are of bounded size, and read one after the other."""
    need = int(WIDE * least - SIGMAS * (WIDE * least * (1 - least)) ** 0.5)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            at = pdf[["key", "left", "right"]].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1])
            rest = pdf.iloc[cuts[-1] :]
            yield frame([x for a, b in zip(cuts, cuts[1:]) for x in _agreeing(pdf.iloc[a:b], need, pick)])
        if rest is not None and len(rest):
            yield frame(_agreeing(rest, need, pick))

    def frame(found: list) -> pd.DataFrame:
        x = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": x.max(1, initial=-(2**63)), "b": x.min(1, initial=2**63 - 1)})

    at = ["key", "left", "right"]
    return blocks.repartition(*at).sortWithinPartitions(*at, "id").mapInPandas(pairs, "a long, b long")


def links(buckets: DataFrame, docs: DataFrame, shared, least: float, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that join all texts which links of similarity `least` or more among bucket members join; `buckets` has key, id and digest."""
    pool, texts = sketched(buckets, docs, shared, scratch)
    pool = scratch.table(pool, "marked")
    of = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")

    # a block of every text, the lead in each of its bucket's blocks
    home = F.when(F.col("id") == F.col("lead"), F.sequence(F.lit(0), of(F.col("n")) - 1)).otherwise(F.array(part(of(F.col("n")))))

    def joined(members: DataFrame, pick: str) -> DataFrame:
        blocks = members.select("key", "id", "root", F.lit(0).alias("side"), "own", "marks", F.explode(home).alias("left")).withColumn("right", F.col("left"))
        return verified(agreeing(blocks, least, pick).distinct(), texts, shared, scratch).filter(F.col("sim") >= least).select("a", "b")

    def apart(groups: DataFrame) -> DataFrame:
        """The members of buckets whose texts are in several groups: `root`, the bucket's smallest one (`main`), and how many texts it has and the others have."""
        roots = pool.select("key", "id").distinct().join(groups.withColumnRenamed("root", "group"), "id", "left")
        roots = scratch.table(roots.select("key", "id", F.coalesce("group", "id").alias("root")), "roots")
        several = scratch.table(roots.groupBy("key").agg(F.min("root").alias("main"), F.max("root").alias("most")).filter("main < most").drop("most"), "several")
        roots = scratch.table(roots.join(several, "key"), "apart")
        sizes = roots.groupBy("key").agg(F.count_if(F.col("root") == F.col("main")).alias("mains"), F.count_if(F.col("root") != F.col("main")).alias("others"))
        return pool.join(roots.join(scratch.table(sizes, "sizes"), "key"), ["key", "id"])

    # each text in its own bucket alone, so no group gives more pairs than it has texts; then those that are left over in all of theirs
    found = joined(pool.withColumn("root", F.col("id")), "own")
    found = found.unionByName(joined(apart(components(found, scratch)), "rest"))

    # the rest: between the group of a bucket's smallest root and the others (side 0 against 1), and among the others (side 2, or blocks of them)
    groups = components(found, scratch)
    rest = apart(groups)
    mains, others = of(F.col("mains")), of(F.col("others"))
    mine = part(others)
    main_blocks = F.transform(F.sequence(F.lit(0), others - 1), lambda k: F.struct((-1 - part(mains)).alias("left"), k.alias("right"), F.lit(0).alias("side")))
    to_mains = F.transform(F.sequence(F.lit(0), mains - 1), lambda k: F.struct((-1 - k).alias("left"), mine.alias("right"), F.lit(1).alias("side")))
    to_others = F.transform(F.sequence(F.lit(0), others - 1), lambda k: F.struct(F.least(k, mine).alias("left"), F.greatest(k, mine).alias("right"), F.when(k == mine, 2).when(mine < k, 0).otherwise(1).alias("side")))
    at = F.explode(F.when(F.col("root") == F.col("main"), main_blocks).otherwise(F.concat(to_mains, to_others))).alias("at")
    blocks = rest.select("key", "id", "root", "marks", at).select("key", "id", "root", "at.side", "marks", "at.left", "at.right")
    more = verified(agreeing(blocks, least, "all").distinct(), texts, shared, scratch).filter(F.col("sim") >= least).select("a", "b")
    return groups.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and the smallest id of its component, for every id in the edges (a, b), by large-star and small-star rounds until all are stars."""
    edges = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))).groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, paths = ends.agg(F.sum("up"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()
        if not paths:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # a hub's neighbours stay where they are
        large = join_hot(both.filter("v > u"), low, "u", "n", 2 * n).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        edges = scratch.table(small, "edges")


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "near-dups")
    shared = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs))  # the common shingles
    rows = signed(docs, shared, scratch)
    reps = rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    reps = scratch.table(reps, "texts")
    buckets = reps.select(F.explode("bands").alias("key"), F.col("rep").alias("id"), "digest")
    # rows that share a doc_id are linked through it
    copies = join_hot(rows.select("doc_id", "digest"), reps.filter("n > 1").select("digest", "rep", "n"), "digest", "n", rows.count())
    copies = copies.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = links(buckets, docs, shared, least, scratch).unionByName(copies)
    roots = written(components(edges, scratch), "classes")
    scratch.clear()
    df = docs.select("doc_id").join(roots, docs["doc_id"] == roots["id"], "left")
    return df.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of `docs` with one document of each class: that with the smallest doc_id; rows without an id stay.

    Of rows that share that id the one with the smallest digest of its text, then of the whole row, stays.
    """
    first = classes(docs, least).filter("doc_id = class_id").groupBy(F.col("doc_id").alias("_n_id")).agg(F.count("*").alias("_n"))
    first = written(first, "kept")
    row = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_n_id"), F.md5("text").alias("_md5"))
    # rows meet the kept ids by a shuffle at every size: a broadcast of these would grow with the table
    kept = row.select("_row", "_n_id").join(first.filter("_n = 1").hint("merge"), "_n_id").select("_row.*").unionByName(docs.filter("doc_id is null"))
    if (again := first.filter("_n > 1")).isEmpty():
        return kept
    more = row.join(again, "_n_id").groupBy("_n_id").agg(F.min_by("_row", F.struct("_md5", F.to_json("_row"))).alias("_row")).select("_row.*")
    return kept.unionByName(more)
