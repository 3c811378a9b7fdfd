"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (`PASSAGE_WORDS` words each, over the whole text). Every passage is described by shares of
character classes, word shapes and repetition, and encoded by a dense layer; gated attention (tanh gate times sigmoid
gate) weighs the passages; the weighted mean representation is scored by a logistic output. Only document labels are
needed: what makes a document bad may be one passage of it.

The model is fitted on the driver, in `STEPS` steps whatever the input, from about `sample` labelled documents at most, chosen
by hash of the id, and `most` passages of each at most, evenly spread over its whole text: documented bounds, for the
classifier only (together some 80 MB). Every document is scored over its whole text and all its passages, in Spark tasks.

Defined cases: a null or empty text is one passage without words and is scored like any other; null labels are not learned
from, and of several labels of an id the lowest counts; without labels of both kinds all scores are the share of label 1
(0.5 without any label); repeated rows are scored each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled

PASSAGE_WORDS = 80
HIDDEN, GATE, STEPS, BATCH, RATE, DECAY = 16, 8, 800, 256, 0.01, 1e-4
_KINDS = 12
_U = np.uint64
_MIX = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 10, np.int64)
    for k, chars in enumerate([" \t\x0b\x0c", "\n\r", ".", ",;:", "!?", "#*$%&", "|<>", "0123456789"]):
        kind[list(chars.encode())] = k
    kind[ord("a") : ord("z") + 1] = 8
    kind[ord("A") : ord("Z") + 1] = 9
    kind[128:] = 11
    return kind


_KIND = _byte_kinds()
FEATURES = _KINDS + 7


def passages(text: str | None) -> np.ndarray:
    """A row of FEATURES figures for each passage; a text without words has one row of zeros."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kinds = _KIND[b]
    inside = kinds > 1
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    count = -(-n // PASSAGE_WORDS)
    sizes = ends - starts
    of_word = np.arange(n) // PASSAGE_WORDS
    first = starts[::PASSAGE_WORDS]
    of_byte = np.repeat(np.arange(count), np.diff(np.concatenate([[0], first[1:], [len(b)]])))
    shares = np.bincount(of_byte * _KINDS + kinds, minlength=count * _KINDS).reshape(count, _KINDS).astype(np.float64)
    words = np.bincount(of_word, minlength=count)
    at = np.flatnonzero(inside)
    power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat(_MIX[b[at]] * power[at - np.repeat(starts, sizes)], np.concatenate([[0], sizes.cumsum()[:-1]]))
    same = np.zeros(n)
    same[1:] = h[1:] == h[:-1]
    by = np.lexsort((h, of_word))
    new = np.ones(n)
    new[1:] = (h[by][1:] != h[by][:-1]) | (of_word[by][1:] != of_word[by][:-1])
    seen = np.ones(n)  # first time in the document
    order = np.argsort(h, kind="stable")
    seen[order[1:]] = h[order[1:]] != h[order[:-1]]
    mean = lambda x: np.bincount(of_word, x, minlength=count) / words
    capital, symbol_end = kinds[starts] == 9, np.isin(kinds[ends - 1], (4, 5, 6))
    extra = [mean(sizes) / 10, mean(same), mean(new[np.argsort(by, kind="stable")]), mean(seen), mean(capital), mean(symbol_end), np.log1p(words) / 5]
    return np.column_stack([shares / shares.sum(1, keepdims=True), *extra]).astype(np.float32)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def _forward(m: dict, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
    h = np.tanh(((x - m["mean"]) / m["std"]) @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["G"])))
    e = (t * s) @ m["w"]
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= _sums(a, starts)[bag]
    z = _sums(a[:, None] * h, starts)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))}


def gradients(p: dict, fixed: dict, bags: list[np.ndarray], labels: np.ndarray) -> tuple[float, dict]:
    """Mean log loss of bags, and its gradient for each parameter."""
    x, sizes = np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags])
    starts, bag = np.concatenate([[0], sizes.cumsum()[:-1]]), np.repeat(np.arange(len(bags)), sizes)
    f = _forward(p | fixed, x, starts, bag)
    ds = (f["p"] - labels) / len(bags)
    dz = (ds[:, None] * p["c"])[bag]
    da = (dz * f["h"]).sum(1)
    de = f["a"] * (da - _sums(f["a"] * da, starts)[bag])
    du = de[:, None] * p["w"]
    dt, dg = du * f["s"] * (1 - f["t"] ** 2), du * f["t"] * f["s"] * (1 - f["s"])
    dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["G"].T) * (1 - f["h"] ** 2)
    xs = (x - fixed["mean"]) / fixed["std"]
    loss = -float(np.mean(labels * np.log(f["p"]) + (1 - labels) * np.log(1 - f["p"])))
    return loss, {"W": xs.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "G": f["h"].T @ dg, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> dict:
    """Parameters of encoder, gated attention and output, by `STEPS` steps of Adam on the log loss of `BATCH` bags each."""
    if len(set(labels.tolist())) < 2:
        return {"constant": float(labels.mean()) if len(labels) else 0.5}
    rng, every = np.random.default_rng(seed), np.concatenate(bags).astype(np.float64)
    norm = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"W": norm(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": norm(HIDDEN, GATE), "G": norm(HIDDEN, GATE), "w": norm(GATE), "c": norm(HIDDEN), "d": np.zeros(1)}
    fixed = {"mean": every.mean(0), "std": every.std(0) + 1e-2}
    m1, m2, order = {k: 0.0 for k in p}, {k: 0.0 for k in p}, np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < min(BATCH, len(bags)):
            order = rng.permutation(len(bags))
        rows, order = order[:BATCH], order[BATCH:]
        _, grad = gradients(p, fixed, [bags[i] for i in rows], labels[rows])
        for k in p:
            g = grad[k] + DECAY * p[k]
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def scores(model: dict, bags: list[np.ndarray]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(bags), model["constant"])
    out = []
    for a in range(0, len(bags), 512):
        part = bags[a : a + 512]
        sizes = np.array([len(x) for x in part])
        out.append(_forward(model, np.concatenate(part), np.concatenate([[0], sizes.cumsum()[:-1]]), np.repeat(np.arange(len(part)), sizes))["p"])
    return np.concatenate(out) if out else np.zeros(0)


def fit(labelled: DataFrame, sample: int = 4000, most: int = 256) -> dict:
    """The model from `labelled` (doc_id, text, label): about `sample` rows and `most` passages of each at most are used."""
    n = labelled.select("doc_id").count()
    chosen = labelled.filter(sampled("doc_id", sample / max(n, 1)))

    @F.pandas_udf("binary")
    def bag(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (x := passages(t))[:: -(-len(x) // most)].tobytes())

    rows = sorted(chosen.select("doc_id", F.col("label").cast("int"), bag("text").alias("bag")).collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    return train([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows], float))


def score(text: Column, model: dict) -> Column:
    """Quality from 0 to 1 of a text column."""

    @F.pandas_udf("double")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(scores(model, [passages(t) for t in s]), dtype=float)

    return udf(text)
