"""Exact top-k by inner product with two cover trees, one over queries and one over data.

A tree is a simplified cover tree. Every node is a point with the radius that covers all points below it. Its children are
chosen farthest first until they cover its points within half that radius, so they lie more than half of it apart, and the
first child is the node's own point; points that are equal hang below one node. For a query node (q, rq, norms up to Mq) and
a data node (p, rp, norms up to Mp) no pair below them scores more than q.p + rq |p| + rp |q| + rq rp, nor more than
(Mq^2 + Mp^2 - max(0, |q - p| - rq - rp)^2) / 2. Where the smaller of both is under the worst k-th score of the query group, the
pair of nodes is left out. That worst score is known before all queries of the group are scored: the node's own point has
k + 1 data points of score s or more, so any query of the group has k others of s - rq Mp or more. Equal bounds are visited,
so ties are exact. The inner products of the node points are scores too, so no pair of points is taken twice.

Data are dealt by hash into blocks of about `block` vectors and queries into groups of `group`, each indexed by one tree
in one task; the query trees meet every data block (the stated query set against all rows, in blocks) and a window keeps
the best k of each query. Trees are packed rows of bounded size, and both sides' sizes depend on the parameters alone.
Vectors that lie far from each other, as random ones of many dimensions, have no bound under any k-th score: of such
blocks all pairs are scored, by matrix products; of clustered ones most are pruned (figures in the README).

Components are integers; sums are exact while they stay under 2^53. Blocks whose sums may not are scored pair by pair in
Python integers, without trees; a score beyond a long is the nearest long.

Defined cases: null vectors and those that hold null, NaN or infinite components, empty vectors and null ids take no part;
vectors of another length never meet; an id that occurs more than once takes part once, with its smallest vector; ties
go to the smaller id; with no queries or no data the result is empty; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

class Tree:
    """Nodes as arrays, parents before children, the children of a node in a row; leaves are single points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points[o := np.argsort(ids, kind="stable")], ids[o]
        self.largest = float(np.abs(points.astype(np.float64)).max(initial=0))
        self.dim = points.shape[1]
        if self.largest**2 * self.dim >= 2**50:
            return  # squared distances are not exact: no tree
        x = self.points.astype(np.float64)
        norm2 = (x**2).sum(1)
        far2 = x @ x.T  # of a block of bounded size
        far2 *= -2
        far2 += norm2
        far2 += norm2[:, None]
        centers, radii, tops, first, last, new = [0], [], [], [], [], [True]
        below = [np.arange(len(x))]
        at = 0
        while at < len(centers):  # breadth first
            c, own = centers[at], below[at]
            near2 = far2[c, own]
            most = near2.max()
            radii.append(most**0.5)
            tops.append(norm2[own].max() ** 0.5)
            first.append(len(centers))
            if len(own) > 1:
                if not most:
                    chosen, parts = own[np.argsort(own != c, kind="stable")], None
                else:
                    picked, label = [int(np.flatnonzero(own == c)[0])], np.zeros(len(own), np.int64)
                    while near2[j := int(near2.argmax())] > most / 4:
                        d = far2[own[j], own]
                        label[d < near2] = len(picked)
                        picked.append(j)
                        near2 = np.minimum(near2, d)
                    by = np.argsort(label, kind="stable")
                    chosen, parts = own[picked], np.split(own[by], np.searchsorted(label[by], np.arange(1, len(picked))))
                centers += chosen.tolist()
                below += parts or [np.array([i]) for i in chosen]
                new += [False] + [True] * (len(chosen) - 1)
            last.append(len(centers))
            below[at] = None
            at += 1
        slack = 1 + 1e-9
        self.center, self.new = np.array(centers), np.array(new)
        self.radius, self.top, self.norm = np.array(radii) * slack, np.array(tops) * slack, np.sqrt(norm2)[self.center]
        self.first, self.last = np.array(first), np.array(last)


class Best:
    """The `k` best (score, id) so far of every query; rows are kept in order, score down, id up."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), 2**63 - 1)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in a matrix of scores, a row for each of `rows` (all different) and a column for each of `ids`."""
        k = self.score.shape[1]
        worst = self.score[rows, -1]
        if scores.shape[1] > k:
            worst = np.maximum(worst, np.partition(scores, -k, axis=1)[:, -k])  # ties with it stay
        i, j = np.nonzero((scores >= worst[:, None]) & (scores > -np.inf))
        if not len(i):
            return
        hit = np.unique(i)
        i = np.concatenate([i, np.repeat(hit, k)])
        score = np.concatenate([scores[i[: len(j)], j], self.score[rows[hit]].ravel()])
        id_ = np.concatenate([ids[j], self.id[rows[hit]].ravel()])
        order = np.lexsort((id_, -score, i))
        i, score, id_ = i[order], score[order], id_[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        ok = nth < k
        self.score[rows[i[ok]], nth[ok]], self.id[rows[i[ok]], nth[ok]] = score[ok], id_[ok]


def search(q: Tree, r: Tree, k: int, scored: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query id, data id, score) of the k best of each query among the data of one tree; adds the pairs scored to `scored[0]`."""
    if not (hasattr(q, "center") and hasattr(r, "center") and q.largest * r.largest * q.dim < 2**52):
        return _plain(q, r, k)
    qx, rx = q.points.astype(np.float64), r.points.astype(np.float64)
    best, most = Best(len(q.ids), k + 1), r.top[0]
    _, own_q, own_r = np.intersect1d(q.ids, r.ids, assume_unique=True, return_indices=True)
    own = np.full(len(q.ids), -1)  # where a query's own row is among the data
    own[own_q] = own_r

    def meet(a: np.ndarray, b: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Scores the points of query nodes against those of the data nodes `b` that are `new`; tells which pairs of nodes to look into."""
        at, to = q.center[a], r.center[b]
        product = qx[at] @ rx[to].T
        points = np.where(own[at][:, None] == to[new], -np.inf, product[:, new])
        best.add(at, points, r.ids[to[new]])
        if scored is not None:
            scored[0] += points.size
        ra, rb, norm = q.radius[a][:, None], r.radius[b], q.norm[a][:, None]
        bound = product + ra * r.norm[b] + rb * norm + ra * rb
        apart = np.maximum(0, np.sqrt(np.maximum(0, norm**2 + r.norm[b] ** 2 - 2 * product)) - ra - rb)
        bound = np.minimum(bound, (q.top[a][:, None] ** 2 + r.top[b] ** 2 - apart**2) / 2)
        single = q.last[a] == q.first[a]
        worst = np.where(single, best.score[at, k - 1], best.score[at, k] - q.radius[a] * most)
        open_ = bound + (1e-6 + 1e-9 * q.top[a] * most)[:, None] >= worst[:, None]
        return open_ & ~(single[:, None] & (r.last[b] == r.first[b]))  # two points are done

    root = np.zeros(1, np.int64)
    todo = [(0, root)] if meet(root, root, np.ones(1, bool))[0, 0] else []
    while todo:
        a, b = todo.pop()  # their points are scored
        single = q.last[a] == q.first[a]
        wide = (r.last[b] > r.first[b]) & (single | (r.radius[b] >= q.radius[a]))
        if wide.any():
            first, count = r.first[b[wide]], (r.last - r.first)[b[wide]]
            inner = np.repeat(first - (count.cumsum() - count), count) + np.arange(count.sum())
            rest = b[~wide]
            both = np.concatenate([rest, inner])
            new = np.concatenate([np.zeros(len(rest), bool), r.new[inner]])
            both = both[meet(np.array([a]), both, new)[0]]
            if len(both):
                todo.append((a, both))
            continue
        for low in range(q.first[a], q.last[a], 256):
            part = np.arange(low, min(low + 256, q.last[a]))
            for some, new in ((part[~q.new[part]], False), (part[q.new[part]], True)):
                if len(some):
                    inside = meet(some, b, np.full(len(b), new))
                    todo += [(x, b[m]) for x, m in zip(some.tolist(), inside, strict=True) if m.any()]
    found = zip(q.ids.tolist(), best.score[:, :k].tolist(), best.id[:, :k].tolist(), strict=True)
    return [(i, v, int(s)) for i, ss, vs in found for s, v in zip(ss, vs, strict=True) if s > -np.inf]


def _plain(q: Tree, r: Tree, k: int) -> list[tuple[int, int, int]]:
    """The same by all pairs in Python integers, for sums that floating point does not hold."""
    out, top = [], 2**63 - 1
    data = r.points.astype(object)
    for i, v in zip(q.ids.tolist(), q.points.astype(object), strict=True):
        rows = heapq.nsmallest(k, ((-max(-top - 1, min(top, s)), j) for s, j in zip((data @ v).tolist(), r.ids.tolist(), strict=True) if j != i))
        out += [(i, j, -s) for s, j in rows]
    return out


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = Tree(np.array(pdf["v"].tolist(), np.int64), pdf["vec_id"].to_numpy(np.int64))
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "part": [pdf["part"].iloc[0]], "tree": [pickle.dumps(tree, protocol=5)]})


def quantised(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v (longs) and dim of the vectors that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    df = embeddings.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
    df = df.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    return df.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def top_k(vectors: DataFrame, is_query, k: int = 5, block: int = 4096, group: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for every row of `vectors` (see `quantised`) with `is_query`."""
    vectors = written(vectors.withColumn("is_query", is_query), "vectors")
    sizes = vectors.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, groups = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // group))
    dealt = lambda df, n: df.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("dim", "part")
    packed = "dim int, part int, tree binary"
    data = dealt(vectors.select("vec_id", "v", "dim"), blocks).applyInPandas(_packed, packed)
    asked = dealt(vectors.filter("is_query").select("vec_id", "v", "dim"), groups).applyInPandas(_packed, packed)
    asked = asked.select("dim", F.col("tree").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    pairs = data.join(asked.hint("shuffle_merge"), ["dim", "part"]).select("tree", "asked")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree, queries in zip(pdf["tree"], pdf["asked"], strict=True):
                rows = search(pickle.loads(queries), pickle.loads(tree), k)
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = pairs.mapInPandas(task, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
