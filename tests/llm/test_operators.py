"""The operators against plain versions on small inputs, and on odd ones."""

import base64
import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from voxlake.llm import html_text, language_id, licenses, near_dups, packing, piece_sampling, quality_model, quality_rules, queries, topk, warc
from voxlake.llm.common import Scratch, join_hot, new_folder

MODEL = queries.PIECE_MODEL
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, n long"
EN, DE = "the cat of the house and the dog is here with them ", "der hund und die katze sind nicht in einem haus von uns "


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else None, None, None, "k", "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "x", EN * 12, EN * 12, DE * 9, "word " * 3000, "¡áé! 漢字 \U0001f600 ▁ #*$", "a" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    df = docs(spark, ODD, ["en", "en", None, "en", "en", "en", "de", "en", "zz", "de"])
    return df.unionByName(df.filter("doc_id in (0, 4)")).unionByName(df.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, ["x"]).limit(0)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, chunk_no int")


def test_warc_round_trip(spark):
    big = "é<p>" * 60000
    rows = [(5, "http://a/\r\nX: y", big), (2, None, big), (9, "u", None), (8, "u", ""), (7, "u", "one"), (7, "u", "one"), (None, "u", big)]
    df = pages(spark, [(*r, "p", 1) for r in rows])
    path = new_folder(spark, "warc")
    index = warc.write(warc.with_duplicates(df), path, chunk_bytes=1000)
    chunks = warc.read_chunks(spark, path, index, chunk_bytes=700)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["digest_ok"]) for r in warc.records(chunks).collect()}
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    n = len(big.encode())
    assert got == {(2, "response", None, n, sha(big), True), (5, "revisit", 2, n, sha(big), True), (None, "revisit", 2, n, sha(big), True), (8, "response", None, 0, sha(""), True), (9, "revisit", 8, 0, sha(""), True), (7, "response", None, 3, sha("one"), True)}
    own = chunks.filter("page_id = 2 and record_type = 'response'").orderBy("chunk_no").collect()
    assert b"".join(bytes(r["chunk"]) for r in own).decode() == big and max(len(r["chunk"]) for r in own) <= 700
    assert warc.records(warc.read_chunks(spark, path, warc.write(warc.with_duplicates(df.limit(0)), new_folder(spark, "warc")))).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(900)] + [(1000 + i, [0.5] * 6) for i in range(300)] + [(2000, None), (2001, [None] * 6), (2002, [math.nan] * 6), (2003, [1.0, 2.0]), (2050, [3.0, 4.0]), (None, [1.0] * 6), (3, [9.0] * 6), (2100, [])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block=200, group=8).collect()}
    first = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and not math.isnan(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            first[i] = min(first.get(i, w), w)
    want = {}
    for q in (i for i in first if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(first[q], v, strict=True)), i) for i, v in first.items() if i != q and len(v) == len(first[q]))
        want |= {(q, k + 1): (i, -x) for k, (x, i) in enumerate(s[:5])}
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "line"])
def test_cover_tree_invariants_and_pruning(kind):
    rng = np.random.default_rng(11)
    x = {"random": rng.normal(size=(500, 16)), "equal": np.ones((300, 3)), "line": rng.random((700, 1)) * [[1, 2]]}.get(kind, rng.normal(size=(20, 8))[rng.integers(0, 20, 900)] + rng.normal(size=(900, 8)) * 0.02)
    t = topk.Tree(np.floor(256 * x).astype(np.int64), rng.permutation(len(x)))
    pts, below = t.points.astype(float), {}
    for k in reversed(range(len(t.center))):
        kids = range(t.first[k], t.last[k])
        below[k] = [t.center[k]] if not kids else [i for c in kids for i in below[c]]
        d = np.linalg.norm(pts[below[k]] - pts[t.center[k]], axis=1)
        assert d.max() <= t.radius[k] and np.linalg.norm(pts[below[k]], axis=1).max() <= t.top[k]
        if kids:
            assert t.center[kids[0]] == t.center[k] and t.new[kids].tolist() == [False] + [True] * (len(kids) - 1)
            assert max(t.radius[c] for c in kids) <= t.radius[k] / 2  # covering
            near = [np.linalg.norm(pts[t.center[a]] - pts[t.center[b]]) for a, b in itertools.combinations(kids, 2)]
            assert t.radius[k] == 0 or min(near) > t.radius[k] / (2 + 1e-6)  # separation
    assert sorted(below[0]) == list(range(len(x)))
    q, scored = topk.Tree(t.points[::20], t.ids[::20]), [0]
    got = topk.search(q, t, 5, scored)
    want = [(int(i), int(j), -s) for i, v in zip(q.ids, q.points, strict=True) for s, j in sorted((-int(v @ w), int(j)) for w, j in zip(t.points, t.ids, strict=True) if j != i)[:5]]
    assert sorted(got) == sorted(want)
    share = scored[0] / (len(q.ids) * len(t.ids))
    print(kind, "pairs scored", share)
    assert share < 0.3 if kind in ("clusters", "line") else share <= 1


def test_top_k_of_huge_scores_and_clashing_columns(spark):
    rows = [(i, [float(3e12 * (i - 3)), 1e12]) for i in range(7)] + [(50, [2.0**40, 3.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, dim int, part int, is_query string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, 5).collect()}
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows}
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = {}
    for q in (0, 50):
        best = sorted((-clamp(sum(a * b for a, b in zip(v[q], w, strict=True))), i) for i, w in v.items() if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_quality_model(spark, odd, empty):
    good, bad = [EN * (1 + i % 7) for i in range(120)], [EN * (i % 3) + "BUY!! NOW!! *** $$$ " * 9 for i in range(60)]
    df = docs(spark, good + bad).withColumn("label", (F.col("doc_id") < 120).cast("int"))
    model = quality_model.fit(df.filter("doc_id % 4 <> 2"))
    held = df.filter("doc_id % 4 = 2").select("label", quality_model.score(F.col("text"), model).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.7) == (r["label"] == 1) for r in held]) > 0.95
    scores = [r["s"] for r in odd.select(quality_model.score(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == 13 and all(0 <= s <= 1 for s in scores)
    assert quality_model.fit(empty.withColumn("label", F.lit(1))) == {"constant": 0.5}
    for x in (bytes(range(256)).decode("latin1"), "a b"):
        assert quality_model.passages(x).shape == (1, quality_model.FEATURES)


def test_quality_model_equals_plain_passes():
    """Forward pass by loops over passages, and gradients by differences."""
    rng = np.random.default_rng(8)
    bags = [rng.random((n, quality_model.FEATURES)).astype(np.float32) for n in (1, 3, 7, 2)]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    h, g = quality_model.HIDDEN, quality_model.GATE
    p = {"W": rng.normal(size=(quality_model.FEATURES, h)), "b": rng.normal(size=h), "V": rng.normal(size=(h, g)), "G": rng.normal(size=(h, g)), "w": rng.normal(size=g), "c": rng.normal(size=h), "d": rng.normal(size=1)}
    fixed = {"mean": rng.random(quality_model.FEATURES), "std": rng.random(quality_model.FEATURES) + 1}

    def plain(bag):
        codes = [np.tanh(((x - fixed["mean"]) / fixed["std"]) @ p["W"] + p["b"]) for x in bag]
        e = [sum(w * math.tanh(t) / (1 + math.exp(-s)) for w, t, s in zip(p["w"], c @ p["V"], c @ p["G"], strict=True)) for c in codes]
        a = [math.exp(x) / sum(map(math.exp, e)) for x in e]
        return 1 / (1 + math.exp(-(sum(x * c for x, c in zip(a, codes, strict=True)) @ p["c"] + p["d"][0])))

    assert np.allclose(quality_model.scores(p | fixed, bags), [plain(b) for b in bags])
    _, grad = quality_model.gradients(p, fixed, bags, labels)
    for k in p:
        for at in list(np.ndindex(p[k].shape))[:: max(1, p[k].size // 9)]:
            loss = []
            for move in (1e-6, -1e-6):
                q = {n: v.copy() for n, v in p.items()}
                q[k][at] += move
                loss.append(quality_model.gradients(q, fixed, bags, labels)[0])
            assert abs((loss[0] - loss[1]) / 2e-6 - grad[k][at]) < 1e-6


def test_quality_of_very_long_and_clashing_input(spark, empty):
    df = docs(spark, ["word " * 200_000, EN, "", None]).withColumns({"score": F.lit("x"), "label": F.col("doc_id").cast("int") % 2, "bag": F.lit(1)})
    model = quality_model.fit(df)
    assert len(df.select(quality_model.score(F.col("text"), model).alias("s")).filter("s between 0 and 1").collect()) == 4
    assert quality_model.fit(docs(spark, [EN, EN]).withColumn("label", F.lit(1))) == {"constant": 1.0}
    assert empty.select(quality_model.score(F.col("text"), model)).count() == 0


def test_language_of_slices_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice(list("abcé"), rng.integers(1, 9))) for _ in range(400))
    whole = language_id.gram_counts(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(language_id, "SLICE", size)
        got = language_id.gram_counts(text)
        assert np.array_equal(got[0], whole[0]) and np.array_equal(got[1], whole[1])
    profiles = language_id.fit(docs(spark, ["abc"] * 4, ["b", "a", "b", "a"]))
    assert language_id.predictor(profiles)("abc") == ("a", 1.0)


def test_language_equals_plain_distance(spark):
    texts = [EN * 3, DE * 2, "un gato y el perro de la casa con nosotros aquí", EN[:30] + DE[:40], "zq xj", "the"]
    profiles = language_id.fit(docs(spark, texts[:3], ["en", "de", "es"]), size=50)

    def plain_grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        found = Counter(c for w in words for c in w) + Counter(f" {w} "[i : i + 2] for w in words for i in range(len(w) + 1)) + Counter(f" {w} "[i : i + 3] for w in words for i in range(len(w)))
        code = lambda g: sum(ord(c) << (21 * i) for i, c in enumerate(g))
        return [g for _, g in sorted((-n, code(g)) for g, n in found.items())][:50]

    assert profiles == {lang: plain_grams(t) for lang, t in zip(("en", "de", "es"), texts, strict=False)}
    for t in texts:
        mine = plain_grams(t)
        far = {lang: sum(abs(p.index(g) - i) if g in p else 50 for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(far), key=lambda x: far[x])
        assert language_id.predictor(profiles, 50)(t) == (best, 1 - far[best] / (50 * len(mine)))


def test_language(spark, odd, empty):
    texts = [EN * 3, DE * 3] * 20
    profiles = language_id.fit(docs(spark, texts, ["en", "de"] * 20))
    got = [tuple(r["p"]) for r in odd.select(language_id.identify(F.col("text"), profiles).alias("p")).collect()]
    assert [g[0] for g in got[:7]] == ["und", "und", "und", got[3][0], "en", "en", "de"] and all(0 <= g[1] <= 1 for g in got)
    assert language_id.fit(empty) == {} and empty.select(language_id.identify(F.col("text"), {})).count() == 0
    kept = language_id.keep_known(odd, profiles)
    assert kept.columns == odd.columns and {4, 5, 6} <= {r["doc_id"] for r in kept.collect()} and kept.filter("text is null").isEmpty()


def test_language_distance_by_hand():
    grams, counts = language_id.gram_counts("Ab b!")
    want = Counter(["a", "b", "b", " a", "ab", "b ", " b", "b ", " ab", "ab ", " b "])
    code = lambda g: sum(ord(c) << (21 * i) for i, c in enumerate(g))
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in want.items()}


def plain_weights(texts):
    sets = [Counter(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) if len(t.split()) >= 5 else Counter([tuple(t.lower().split())] if t.split() else []) for t in texts]
    df = Counter(s for x in sets for s in x)
    n = max(128, sum(bool(x) for x in sets))
    idf = {s: 1 + round(max(0, min(1, math.log(n / k) / math.log(100))) * 16) / 16 for s, k in df.items()}
    return [{s: tf * idf[s] for s, tf in x.items()} for x in sets]


def plain_classes(texts, least=0.8):
    """The smallest index of each text's class over all pairs, and the pairs of different texts."""
    w, root, linked = plain_weights([t or "" for t in texts]), list(range(len(texts))), []
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = sum(min(w[i][s], w[j][s]) for s in w[i].keys() & w[j].keys())
        if both and both / (sum(w[i].values()) + sum(w[j].values()) - both) >= least:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
            linked += [(i, j)] * (texts[i] != texts[j])
    return root, linked


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{rng.integers(400)}" for _ in range(120)) for _ in range(12)]
    texts = [edited(rng, b, int(rng.integers(0, 5))) for b in base for _ in range(6)]
    texts += [base[0], base[0], "", "a b", "A b", None, " "]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs(spark, texts)).collect()}
    assert got == dict(enumerate(plain_classes(texts)[0]))


def test_near_duplicates_of_large_buckets(spark, monkeypatch):
    """One group far larger than a block, beside groups alike that are not near enough, and texts beyond what is cached."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    monkeypatch.setattr(near_dups, "CACHED", 500)
    rng = np.random.default_rng(12)
    base = [" ".join(f"w{rng.integers(400)}" for _ in range(150)) for _ in range(3)]
    texts = [edited(rng, base[0], int(rng.integers(0, 3))) for _ in range(120)]
    texts += [edited(rng, base[1], int(rng.integers(5, 9))) for _ in range(40)]  # alike, mostly below the threshold
    texts += [base[2]] * 30 + [edited(rng, base[2], 1) for _ in range(3)]
    root, linked = plain_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs(spark, texts)).collect()}
    assert len({*root}) > 3 and sum(got[i] == got[j] for i, j in linked) >= 0.99 * len(linked)
    assert all(root[i] == root[c] for i, c in got.items())  # no class joins what no link joins


def test_common_shingles_are_counted_exactly(spark):
    rng = np.random.default_rng(13)
    texts = [" ".join(f"w{rng.integers(10**6)}" for _ in range(20)) + (" the same six words as ever" if i % 3 == 0 else "") + (" some other words that are here" if i % 40 == 0 else "") for i in range(900)]
    corpus = near_dups.document_frequencies(docs(spark, [*texts, None, ""]))
    df = Counter(int(h) for t in texts for h in near_dups.shingles(t)[0])
    want = {h: int(near_dups.rarity(np.array([n]), 900)[0]) for h, n in df.items()}
    h = np.array([*df], np.uint64)
    assert corpus.step(h).tolist() == [want[int(x)] for x in h] and {*want.values()} == {4, 13, 16}


def test_join_hot_equals_join(spark):
    left = spark.createDataFrame([(i % 7 if i % 3 else 100, i) for i in range(900)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 2")
    got = sorted(map(tuple, join_hot(left, right, "k", "n", 900, 10).select("k", "v", "n").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "v", "n").collect()))


def test_near_duplicates_odd(spark, odd, empty):
    got = near_dups.classes(odd).collect()
    assert len(got) == 13 and {(r["doc_id"], r["class_id"]) for r in got} == {(i, 4 if i == 5 else i) for i in range(10)} | {(None, None)}
    kept = near_dups.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert near_dups.classes(empty).count() == 0
    two = spark.createDataFrame([(1, "a text of its own", "p"), (1, "another text", "q"), (2, "a text of its own", "r"), (1, "another text", "a")], "doc_id long, text string, class_id string")
    assert [tuple(r) for r in near_dups.keep_one(two.coalesce(1)).collect()] == [tuple(r) for r in near_dups.keep_one(two.repartition(4)).collect()] == [(1, *min((hashlib.md5(t.encode()).hexdigest(), t, k) for t, k in (("a text of its own", "p"), ("another text", "a")))[1:])]


def test_components_of_any_graph(spark):
    rng = random.Random(7)
    graphs = [[(i, i + 1) for i in range(40)], [(i, 0) for i in range(1, 30)] + [(i, 99) for i in range(20, 60)], [(5, 5), (7, 6), (6, 7), (7, 6)], []]
    graphs += [[(rng.randrange(120), rng.randrange(120)) for _ in range(n)] for n in (30, 70, 150)]
    edges, root = [], {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g, graph in enumerate(graphs):
        for a, b in ((a + 1000 * g, b + 1000 * g) for a, b in graph):
            edges.append((a, b))
            if a != b:
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((x, find(x)) for x in {x for e in edges if e[0] != e[1] for x in e})
    scratch = Scratch(spark, "components")
    got = near_dups.components(spark.createDataFrame(edges, "a long, b long"), scratch)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert near_dups.components(got.limit(0).toDF("a", "b"), scratch).count() == 0


@pytest.mark.parametrize("size", [240, 24_000])  # the second far over the rows of the tables
def test_consistent_sampling_follows_similarity(size):
    rng = np.random.default_rng(5)
    corpus, hits, runs = near_dups.Corpus(np.zeros(0, np.uint64), np.zeros(0, np.uint8)), 0, 60 if size < 1000 else 20
    for _ in range(runs):
        h = rng.permutation(np.unique(rng.integers(1, 2**62, size).astype(np.uint64)))
        a, b = np.sort(h[: size * 9 // 10]), np.sort(h[size // 10 :])  # Jaccard 0.8
        one = np.ones(len(a), np.int64)
        hits += (near_dups.signature(a, one, corpus) == near_dups.signature(b, np.ones(len(b), np.int64), corpus)).sum()
    assert abs(hits / runs / near_dups.BANDS - 0.8**near_dups.ROWS) < 0.08


def test_pieces_round_trip(spark, odd):
    df = piece_sampling.encode(odd, MODEL)
    back = df.withColumn("back", piece_sampling.decode(F.col("pieces"), MODEL)).collect()
    assert len(back) == 13 and all(r["back"] == r["text"] for r in back)
    again = {r["doc_id"]: r["pieces"] for r in piece_sampling.encode(odd.repartition(3), MODEL).collect()}
    assert all(again[r["doc_id"]] == r["pieces"] for r in back)
    other = {r["doc_id"]: r["pieces"] for r in piece_sampling.encode(odd, MODEL, seed=1).collect()}
    assert other[4] != again[4]


def test_piece_samples_follow_their_weights():
    p = piece_sampling.pieces(MODEL, 1.0)
    names = {i: t for i, t in enumerate(p.text) if t}

    def every(text):
        if not text:
            yield ()
        for i, t in names.items():
            if text.startswith(t) and len(t) <= len(text):
                for rest in every(text[len(t) :]):
                    yield (i, *rest)

    names = {i: t for i, t in names.items() if t in b" that" and i not in p.byte_ids.values()}
    ways = {w: math.exp(sum(p.log[i] for i in w)) for w in every(b" that")}
    total = sum(ways.values())
    n = 4000
    got = Counter(tuple(ids.tolist()) for k in range(n) for _, ids in piece_sampling._encoded(p, [k * 7919 + 1], ["that"], 0))
    assert set(got) <= set(ways)
    assert all(abs(got[w] / n - x / total) < 0.03 for w, x in ways.items())


def test_pieces_do_not_depend_on_batches_or_slices(monkeypatch):
    p = piece_sampling.pieces(MODEL, 1.0)
    rng = np.random.default_rng(9)
    words = (EN + DE + "¡áé! 漢字 ▁ unbelievable 1234").split()
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(300)]
    keys = [int(x) for x in rng.integers(-(2**63), 2**63, 300)]

    def run(size):
        out = []
        for a in range(0, len(texts), size):
            parts = [[] for _ in texts[a : a + size]]
            for row, ids in piece_sampling._encoded(p, keys[a : a + size], texts[a : a + size], 0):
                parts[row] += ids.tolist()
            out += parts
        return out

    want = run(10_000)
    assert run(1) == want and run(7) == want
    monkeypatch.setattr(piece_sampling, "SLICE", 50)  # texts longer than a slice
    assert run(10_000) == want and run(1) == want


def plain_measures(text):
    w = (text or "").split()
    where = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if where[tuple(w[i : i + 5])] > 1 for k in range(5)}
    rows = [x for x in (text or "").split("\n") if x.split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(rows) - len(set(rows)), len(hit)


def test_quality_measures(spark, odd, empty):
    texts = ODD + ["a b c d e a b c d e f a b c d e", "l1 x\nl1 x\n\n \nl1 x\nq", EN + "\n" + EN]
    df = quality_rules.measure(docs(spark, texts)).orderBy("doc_id")
    assert [tuple(r[m] for m in quality_rules.MEASURES) for r in df.collect()] == [plain_measures(t) for t in texts]
    got = quality_rules.assess(odd)
    assert got.count() == 13 and got.filter("base_failed and kept").isEmpty()
    assert quality_rules.assess(empty).count() == 0 and quality_rules.keep_good(empty).columns == empty.columns


def test_quality_thresholds_adapt(spark):
    clean = [" ".join(f"word{i * 31 + k * 7}" for k in range(40)) for i in range(80)]
    signs = [" ".join(f"#w{i * 31 + k * 7}" for k in range(40)) for i in range(80)]
    df = docs(spark, [*clean, signs[0], *signs]).withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") <= 80, "plain").otherwise("tags"))
    dropped = {r["doc_id"] for r in quality_rules.assess(df).filter("not kept").collect()}
    assert dropped == {80}  # odd in its own source only


def test_licences(spark, odd, empty, monkeypatch):
    mit = licenses.KNOWN[-2][1]
    texts = ["Copyright (c) 2020 Me\n" + mit.upper().replace(",", " ;"), mit + " extra", "Intro.\nReleased under the MIT Licence!\nlicensed under CC BY-NC 4.0", "(c) 2021 X. All", None, "", "word " * 300_000]
    own = [("own", "A licence licence, v2 sub-licence\nnon\ninfringement"), ("other", "A  license license version 2 sublicense noninfringement."), ("none", "(c) 2020 me"), (None, "x y"), ("null", None)]
    df = docs(spark, [*texts, "a LICENSE, licence: v2 sublicense non-infringement", "x y"]).withColumns({"license_id": F.lit(1), "text_digest": F.lit(2), "_row": F.lit(3)})
    got = [(r["license_id"], r["n_license_lines"], r["line_licenses"]) for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == [("MIT", 0, ""), (None, 0, ""), (None, 2, "CC-BY-NC-4.0,MIT"), *[(None, 0, "")] * 6]
    ours = spark.createDataFrame(own, "license_id string, text string")
    results = []
    for small in (licenses.SMALL, 0):  # by broadcast and by shuffle
        monkeypatch.setattr(licenses, "SMALL", small)
        results.append(sorted(map(str, licenses.scan(df.unionByName(df.limit(3)), licenses.default_known(spark).unionByName(ours)).select("doc_id", "text_digest", "license_id", "n_license_lines", "line_licenses").collect())))
        one = licenses.scan(df, ours).filter("doc_id >= 7").orderBy("doc_id").collect()
        assert [(r["license_id"], r["n_license_lines"]) for r in one] == [("other", 1), (None, 0)]
        assert licenses.scan(odd).count() == 13 and licenses.scan(empty).count() == 0 and licenses.scan(df, ours.limit(0)).filter("license_id is null").count() == 9
    assert results[0] == results[1]


PAGE = """<html><head><title>no</title><script>var x="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h2>Title &amp; more</h2><p>First   line
of text, with <b>bold</b> words.<p>Short.</p><aside>See also</aside><div class="ad">Buy now</div><ul><li>One item</li></ul></article>
<section class="comments"><p>I, a reader, disagree with all of this, I do.</p></section></main><form><p>Your name</p></form><footer>&copy; us"""


def test_main_text(spark):
    df = pages(spark, [(i, "u", x, "p", 1) for i, x in enumerate([PAGE] * 30 + [None, "", "plain text, without any tag at all, that goes on for a while here."])])
    model = html_text.fit(df)
    got = [r["text"] for r in html_text.extract(df, model).orderBy("page_id").collect()]
    assert got[0] == "Title & more\nFirst line of text, with bold words.\nShort.\nOne item" and got[30:32] == ["", ""] and got[32]
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).count() == 0


def test_minimum_cut_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        gains = [float(x) for x in rng.normal(0, 2, n)]
        links = {(i, j): float(rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(max(0, -g) if k else max(0, g) for g, k in zip(gains, x, strict=True)) + sum(w for (i, j), w in links.items() if x[i] != x[j])  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product([True, False], repeat=n))
        assert abs(cost(html_text.minimum_cut(gains, links)) - best) < 1e-6


def test_boundaries_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        tops = sorted(set(rng.integers(0, 60, 9).tolist()))
        bins = [(t, int(n)) for t, n in zip(tops, rng.integers(1, 9, len(tops)), strict=True)]

        def waste(ends):
            return sum(n * (min(e for e in ends if e >= t) - t) for t, n in bins)  # noqa: B023

        best = min(waste((*e, tops[-1])) for k in range(3) for e in itertools.combinations(tops[:-1], k))
        assert waste(packing.best_boundaries(bins, 3)) == best
    bins = [(int(t), int(n)) for t, n in zip(np.unique(rng.integers(0, 10**7, 3000)), rng.integers(1, 10**6, 3000), strict=False)]  # lengths far apart, all pairs by the plain rule
    top, n = (np.array(x) for x in zip(*bins, strict=True))
    rows, tokens = (np.concatenate([[0], x.cumsum()]) for x in (n, n * top))
    cost = np.full(len(bins) + 1, 2**61)
    cost[0] = 0
    for _ in range(4):
        cost = np.array([0, *(min(cost[j], (cost[:j] + top[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])).min()) for j in range(1, len(cost)))])
    ends = np.array(packing.best_boundaries(bins, 4))
    assert (n * (ends[np.searchsorted(ends, top)] - top)).sum() == cost[-1]


def test_packing(spark, odd, empty):
    df = docs(spark, ["w " * (1 + i * i % 97) for i in range(500)])
    rows = packing.pack(df, buckets=4, budget=200, shard_rows=30).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(500))
    for (_, _), own in itertools.groupby(sorted(rows, key=lambda r: (r["bucket"], r["batch"], r["slot"])), key=lambda r: (r["bucket"], r["batch"])):
        own = list(own)
        assert [r["slot"] for r in own] == list(range(len(own))) and len(own) * own[0]["boundary"] <= 200 and all(r["n_tokens"] <= r["boundary"] for r in own)
    full = Counter((r["bucket"], r["batch"]) for r in rows)
    for b in {k[0] for k in full}:
        sizes = [full[b, i] for i in range(max(k[1] for k in full if k[0] == b) + 1)]
        assert len(set(sizes[:-1])) <= 1
    clash = df.withColumns({c: F.lit("x") for c in ("bucket", "batch", "shard", "i", "offset")} | {"n_tokens": F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") - 3)})
    got = {r["doc_id"]: r["n_tokens"] for r in packing.pack(clash, F.col("n_tokens")).collect()}
    assert got == {i: max(0, i - 3) if i % 5 else 0 for i in range(500)}
    same = docs(spark, ["a b"]).crossJoin(spark.range(400).select(F.lit(1).alias("one"))).drop("one")
    assert [r["n"] for r in packing.pack(same, budget=40, shard_rows=50).groupBy("batch").agg(F.count("*").alias("n")).collect()] == [20] * 20
    assert packing.pack(odd, budget=100).count() == 13 and packing.pack(empty).count() == 0


def test_pipeline_stages(spark, odd, empty, tmp_path):
    more = docs(spark, [" ".join(f"{EN.split()[k % 11]}{i * 13 + k}" for k in range(40)) for i in range(30)], ["en"] * 30).withColumn("doc_id", F.col("doc_id") + 100)
    for k, start in enumerate((odd.unionByName(more), empty)):
        start.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        ids = {r["doc_id"] for r in rows}
        assert (set(range(100, 130)) <= ids and not ids & {0, 1, 2}) if not k else not rows


def test_every_pipeline_stage_equals_a_plain_version(spark, tmp_path):
    """Each stage on all that its predecessor kept: distances by loops, the rules in SQL, all pairs, and the packing's own terms."""
    import duckdb

    start = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    now, kept = start, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, "").write.parquet(f"{tmp_path}/{name}")
        kept[name] = (now, spark.read.parquet(f"{tmp_path}/{name}"))
        now = kept[name][1]
        assert name == "packing" or now.columns == start.columns
    before, after = kept["language"]
    predict = language_id.predictor(language_id.fit(before))
    assert ids(after) == sorted(r["doc_id"] for r in before.collect() if (p := predict(r["text"]))[0] != "und" and p[1] >= 0.02)
    before, after = kept["quality"]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/language/*.parquet'")
    assert ids(after) == sorted(x[0] for x in c.sql(f"SELECT doc_id FROM ({queries.SQL['op7_quality_rules']}) WHERE kept").fetchall())
    before, after = kept["near_dups"]
    rows = sorted(before.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    root, _ = plain_classes([r["text"] for r in rows])
    assert ids(after) == [r["doc_id"] for i, r in enumerate(rows) if root[i] == i] and after.count() < before.count()
    before, after = kept["packing"]
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in before.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in after.collect()} == words
    ends = packing.best_boundaries(sorted(Counter(words.values()).items()), 16)
    assert all(r["boundary"] == min(e for e in ends if e >= r["n_tokens"]) and r["slot"] * r["boundary"] < 65536 for r in after.collect())


def test_warc_small_payloads_never_revisit(spark):
    rows = [(i, "u", x, "p", 1) for i, x in enumerate(["ab", "ab", "abcd", "abcd", "", None])]
    got = {r["page_id"]: r["refers_to"] for r in warc.with_duplicates(pages(spark, rows), least=3).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 2, 4: None, 5: None}
    got = {r["page_id"]: r["refers_to"] for r in warc.with_duplicates(pages(spark, rows)).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: 4}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, "/root/testdata/sf0.001"), c.sql(queries.SQL[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    assert sorted(str([r[x] for x in order]) for r in df.collect()) == sorted(str([r[rel.columns.index(x)] for x in order]) for r in rel.fetchall())


def test_near_copies_give_no_more_pairs_than_texts(spark):
    """Near copies share most of their buckets: each is paired in its own bucket alone, and who is left over in a group, with one text of another."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(w if rng.random() > 0.003 else f"x{i}" for w in base) for i in range(60)]
    found = [near_dups.shingles(t) for t in texts]
    corpus = near_dups.Corpus(np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    bands, wide = near_dups.signatures(found, corpus), near_dups.sketches(found, corpus)
    rows = [(int(k), i, i, 0, b.tobytes() + w.tobytes()) for i, (b, w) in enumerate(zip(bands, wide, strict=True)) for k in b]
    df = spark.createDataFrame(rows, "key long, id long, root long, side int, marks binary")
    sizes = df.groupBy("key").count()
    df = df.join(sizes, "key").withColumn("own", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "key")) == 1)
    df = df.withColumn("left", F.lit(0)).withColumn("right", F.lit(0))
    pairs = near_dups.agreeing(df, 0.8, "own").collect()
    assert 40 < len(pairs) < len(texts) and len({r.a for r in pairs}) == len(pairs)
    two = df.withColumn("root", F.when(F.col("id") < 58, 0).otherwise(F.col("id")))
    rest = near_dups.agreeing(two, 0.8, "rest").collect()
    assert rest and all(r.a >= 58 for r in rest) and len(rest) <= 2 * near_dups.BANDS
