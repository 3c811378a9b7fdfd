"""Suffix arrays and the removal of repeated bytes against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from voxlake.llm import induced, queries, suffix_dedup
from voxlake.llm.common import Scratch

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(60))
def test_suffixes(seed):
    """Every suffix in its place and what neighbours share, with queues on disk, blocks of any size, and with or without recursion to the end."""
    rng = random.Random(seed)
    base = [rng.randrange(1, rng.choice([2, 3, 5, 250])) for _ in range(rng.choice([1, 2, 10, 40, 200]))]
    t = base + rng.choice([[], [0, *base[len(base) // 2 :]]]) + rng.choice([[], [0, *base]]) + [0]
    cap, kind = rng.choice([5, 100]), rng.choice([256, 300])
    got = list(induced.suffixes(np.array(t, np.uint8 if kind == 256 else np.int64), len(t), kind, cap, rng.choice([0, 100, 1 << 20]), rng.choice([1, 3, 16, 1 << 16]), rng.choice([0, 5, 1 << 22])))
    want = sorted(range(len(t)), key=lambda i: t[i:])
    assert np.concatenate([p for p, _, _ in got])[::-1].tolist() == want

    def shared(a, b):
        k = 0
        while k < min(cap, len(t) - max(a, b)) and t[a + k] == t[b + k]:
            k += 1
        return k

    assert np.concatenate([x for _, x, _ in got])[1:][::-1].tolist() == [shared(a, b) for a, b in zip(want, want[1:], strict=False)]


def plain(rows):
    """(doc_id, bytes, removed, spans, digest) of documents in order."""
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def result(df):
    return [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()]


@pytest.mark.parametrize("many", [0, 2000])
def test_odd_documents(spark, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, line = word(400), word(70)
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 75, "ab" * 1000, passage, "q" + passage[3:] + "z", passage[:120] + word(30) + passage[200:], word(3000), word(50) + passage + passage]
    texts += [word(40) + line + word(40) for _ in range(30)] + [passage] * 5 + ["\0" * 300, "漢字" * 80]
    rows = [(None if i == 3 else 10**10 + i // 2 if i > 40 else i, t) for i, t in enumerate(texts)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], "doc_id long, text string, rid string, at int, n int, anchor int").coalesce(1)
    assert sorted(result(suffix_dedup.without_repeats(df, Scratch(spark, "s"))), key=str) == sorted(plain(rows), key=str)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.without_repeats(df, Scratch(spark, "s")).collect() == []


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, queries.op13_suffix_dedup(spark, DATA).collect())) == plain(rows)


def test_long_texts_are_cut_alike(monkeypatch):
    """Slices of any size find the same repeated windows."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    for ends in ([5000], [1200, 5000]):
        start, n, anchor, _, _ = suffix_dedup.cut(data, np.array(ends))
        of = {s + k: a for s, c, a in zip(start.tolist(), n.tolist(), anchor.tolist(), strict=True) for k in range(c)}
        assert sorted(of) == [i for i in range(4901) if not any(i < e < i + 100 for e in ends)] and n.max() <= suffix_dedup.WIDE
        if len(ends) == 1:
            whole = of
        assert all(whole[i] == a for i, a in of.items())


def test_shards_grow_in_number(spark, monkeypatch):
    """A shard's text stays about as large when the input grows, and the spans stay the same."""
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefgh "), 400)) for _ in range(6)]
    rows = [(i, base[i % 6][: 150 + 5 * i] + str(rng.integers(10**9)) * 8 + base[(i * 5 + 1) % 6][i:]) for i in range(40)]
    got = {}
    for size in (1 << 30, 2000):
        monkeypatch.setattr(suffix_dedup, "SHARD", size)
        scratch, parts = Scratch(spark, "test"), []
        monkeypatch.setattr(suffix_dedup, "_sorted", lambda stream, run=suffix_dedup._sorted: run(stream))
        table = Scratch.table
        monkeypatch.setattr(Scratch, "table", lambda self, df, name, table=table, parts=parts: (parts.append((name, df.rdd.getNumPartitions())) if name == "by_suffix" else None, table(self, df, name))[1])
        df = table(scratch, spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "docs")
        got[size] = sorted((r.doc_id, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.without_repeats(df, scratch).collect())
        monkeypatch.undo()
        assert (dict(parts)["by_suffix"] > 4) == (size == 2000)
    assert got[1 << 30] == got[2000] and sum(len(x[1]) for x in got[2000]) > 10


@pytest.mark.parametrize("seed", range(12))
def test_windows_are_sorted_in_memory(seed, monkeypatch):
    """A shard that fits into memory sorts its windows alone, without queues of all suffixes, and marks the same ones."""
    rng = np.random.default_rng(seed)
    base = rng.integers(98, 98 + rng.choice([1, 2, 20]), 400).astype(np.uint8)
    parts = [base[a : a + 100 + rng.integers(0, 69)] for a in rng.integers(0, 232, 60)]
    parts += [np.append(base[a : a + rng.choice([8, 50, 99])], rng.integers(98, 100, 100).astype(np.uint8)) for a in rng.integers(0, 300, 20)] if seed % 2 else []
    text = np.concatenate([np.append(p, np.uint8(0)) for p in parts])
    starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    counts = np.array([len(p) - 99 for p in parts])
    at = np.concatenate([s + np.arange(c) for s, c in zip(starts, counts, strict=True)])
    pos, same = induced.sparse(text, at, 100)
    got = [text[p : p + 100].tobytes() for p in pos]
    assert sorted(pos) == at.tolist() and got == sorted(got) and same.tolist() == [i > 0 and got[i] == got[i - 1] for i in range(len(got))]
    with monkeypatch.context() as m:
        m.setattr(suffix_dedup, "IN_MEMORY", 0)
        queued = suffix_dedup.repeated_starts(text, len(text), starts, counts)
    monkeypatch.setattr(induced, "suffixes", None)
    assert (suffix_dedup.repeated_starts(text, len(text), starts, counts) == queued).all() and queued.any()


def test_no_windows_to_sort():
    assert [len(x) for x in induced.sparse(np.zeros(100, np.uint8), np.empty(0, np.int64), 100)] == [0, 0]


def test_windows_that_equal_none_stay_out(spark, monkeypatch):
    """Of an anchor with many pieces only the windows that come again go to the shards, so a common line costs no text for each of its contexts."""
    monkeypatch.setattr(suffix_dedup, "MANY", 10)
    rng = random.Random(8)
    line, word = "a line that many texts have, shorter than one hundred bytes, " + "z" * 20, lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, word(90) + line + word(90)) for i in range(60)] + [(60, word(90) + (same := word(15) + line + word(15)) + word(90)), (61, word(90) + same + word(90))]
    counts, table = {}, Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: (t := table(self, df, name), counts.update({name: t.count()}))[0])
    df = table(Scratch(spark, "s"), spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "docs")
    assert sorted(result(suffix_dedup.without_repeats(df, Scratch(spark, "s")))) == plain(rows)
    assert counts["windows"] > 1000 and counts["alike"] <= 100
