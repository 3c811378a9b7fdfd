"""The Merkle manifest and the periodic runs against plain versions, and on odd rows."""

import hashlib
import os
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import merkle, queries, runs
from voxlake.llm.common import Scratch

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, digest string, n long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root, and for each node the (left, right) of all levels."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i, below in enumerate(groups):
            run = i // 8 * 8
            for j in below:
                paths[j].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        groups = [sum(groups[i : i + 8], []) for i in range(0, len(nodes), 8)]
        nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return (nodes or [None])[0], paths


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: b"" if x is None else b"=" + x.encode())
    trees = {}
    for lang in langs:
        own = sorted(((-1, leaf(*r)) if r[0] is None else (r[0], leaf(*r))) for r in rows if r[2] == lang)
        trees[lang] = own, *climb([h for _, h in own])
    root, up = climb([trees[x][1] for x in langs])
    return root, sorted((h, trees[x][1], sha(*(a + b for a, b in p + u))) for x, u in zip(langs, up, strict=True) for (_, h), p in zip(trees[x][0], trees[x][2], strict=True))


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 9, None: 2}, {"a": 64, "b": 65, "é": 8}, {"a": 600, None: 1, "": 3} | {f"l{i}": 1 for i in range(70)}])
def test_manifest(spark, counts):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40), *range(10**12, 10**12 + 400)]), rng.choice([None, "", "Aé", "x" * 3000]), lang, rng.choice([None, "s"]), rng.choice([None, -1, 7])) for lang, n in counts.items() for _ in range(n)]
    rows += rows[:1] * 2
    df = spark.createDataFrame([(*r, "k", 1, "d", 2) for r in rows], SCHEMA)
    got = merkle.manifest(df, Scratch(spark, "m"), {"changed": F.lit("0")})
    got = got.select("leaf", "subroot", merkle.proof(F.col("path")), "root", merkle.folded(F.col("leaf"), F.col("path")), merkle.folded(F.col("changed"), F.col("path"))).collect()
    root, want = plain_manifest(rows)
    assert sorted(tuple(r)[:3] for r in got) == want
    assert {(r[3], r[4]) for r in got} == {(root, root)} and root not in {r[5] for r in got}


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), Scratch(spark, "m")).collect() == []


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        s = 0
        while s < len(words) - q:
            e = s
            while e < len(words) - q and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(24, 3 * q):
                found.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(rng, size):
    out = []
    while len(out) < size:
        p = [rng.randrange(rng.choice([1, 2, 5, 50])) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 70]))]
        out += (p * 9)[: rng.randrange(1, 5 * len(p) + 20)]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs(seed):
    rng = random.Random(seed)
    words = periodic(rng, rng.choice([30, 100, 700]))
    want = plain_runs(words)
    assert runs.found([str(w).encode() for w in words]) == want
    # single words, and batches of any size, tell the same
    for most in (1, 5, 100):
        c, i = runs.Catchers(), 0
        while i < len(words):
            m = rng.randint(1, most)
            c.append(np.array(words[i : i + m]))
            i += m
        assert c.runs() == want


def test_many_equal_words():
    assert runs.found([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert runs.found([b"a", b"b"] * 50_000 + [b"a"] * 50_000) == [(0, 100_001, 2), (100_000, 50_000, 1)]


def test_runs_of_odd_texts(spark):
    texts = [None, "", " \n", "a b " * 11 + "a", "a b " * 12, "x y z " * 24, "a\tb\vc\x1cd " * 30, "w " * 5000 + "é"]
    df = spark.createDataFrame([(i, t, "k", [1], "c") for i, t in enumerate(texts)], "doc_id long, text string, _text string, runs array<int>, collapsed string")
    df = df.unionByName(df.filter("doc_id = 4"))
    got = sorted(runs.with_runs(df, F.col("text")).collect())
    assert [r["_text"] for r in got] == ["k"] * 9 and got[4] == got[5]
    for r in got:
        words = (r["text"] or "").encode().split()
        want = plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == want and r["n_words"] == len(words)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r["longest"] and tuple(r["longest"])) == best
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert runs.with_runs(df.limit(0), F.col("text")).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle", "op12_runs"])
def test_queries_equal_their_sql(spark, name, tmp_path):
    con = duckdb.connect(config={"temp_directory": os.fspath(tmp_path)})
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df, rel = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    assert sorted(map(str, df.select(sorted(df.columns)).toPandas().itertuples(index=False))) == sorted(map(str, rel.select(*sorted(rel.columns)).df().itertuples(index=False)))
