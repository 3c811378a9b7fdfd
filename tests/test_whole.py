"""Queries over whole texts and files, and ways that differ from the SQL, against plain versions."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import scoring, segmentation, text
from voxlake.operators import relational, sequence
from voxlake.plans.registry import ACCENTS, PLAIN, QUERIES


def test_following_equals_lead(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["en", "en", "en", "de", None]), i, rng.choice([None, f"t{i}"])) for i in rng.sample(range(10**6), 300)] + [("one", 1, "x")]
    df = spark.createDataFrame(rows, "lang string, id long, text string")
    rows.sort(key=lambda r: (str(r[0]), r[1]))
    want = {a[1]: b[2] for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0]}
    for n in (1, 3, 7, 4096):
        got = sequence.following(df, "lang", "id", "text", n).collect()
        assert len(got) == len(want) and {r["id"]: r["next"] for r in got} == want
    assert sequence.following(df.limit(0), "lang", "id", "text").count() == 0


def test_alignment_of_whole_texts(spark, tmp_path):
    same = "these are the same "
    texts = [same * 40 + "canción", same * 40 + "cancion", same * 40 + "xx", "short", "", "é" * 300, "e" * 290 + "z" * 10]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    base = str.maketrans(ACCENTS, PLAIN)

    def status(a, b):
        one = lambda i: "missing" if i >= len(b) else "extra" if i >= len(a) else "perfect" if a[i] == b[i] else "tone_wrong" if a[i].translate(base) == b[i].translate(base) else "wrong"
        return [one(i) for i in range(max(len(a), len(b)))]

    def score(a, b, s):
        share = lambda *x: int(sum(y in x for y in s) / len(a) * 100) if a else 0
        pron, tone = share("perfect", "tone_wrong"), share("perfect")
        return pron, tone, max(0, int(pron * 0.5 + tone * 0.5) - min(20, 5 * abs(len(a) - len(b)))) if b else 0

    pairs = {i: (a, b, status(a, b)) for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))}
    run = lambda name: {r["doc_id"]: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    for name in ("n1_status", "n1_status_whole"):
        assert run(name) == {i: (",".join(s),) for i, (_, _, s) in pairs.items()}
    for name in ("n2_score", "n2_score_whole"):
        assert run(name) == {i: score(*p) for i, p in pairs.items()}
    got = run("n3_feedback")
    assert got[0] == ("excellent tone: ó",) and got[1] == ("good wrong: can",) and len(got) == 6


def test_sections_reach_the_last_page(spark, tmp_path):
    pages = [(p, pdf) for pdf, last in (("a", 1234), ("b", 90), ("c", 700)) for p in range(0, last + 1, 7 if pdf == "a" else 1)]
    spark.createDataFrame([(p, pdf, "x\ny") for p, pdf in pages], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    last = {pdf: max(p for p, x in pages if x == pdf) for _, pdf in pages}
    want = sorted((pdf, p, k, p - 100 * k) for p, pdf in pages for k in range(last[pdf] // 100 + 1) if 100 * k <= p <= min(100 * k + 150, last[pdf]))
    for name in ("j7_sections", "j7_sections_whole"):
        got = QUERIES[name](spark, str(tmp_path)).select("pdf", "page", "section", "page_index").collect()
        assert sorted(tuple(r) for r in got) == want and max(r["page"] for r in got) > 1200


def test_sections_by_buckets(spark):
    rng = random.Random(2)
    pages = [(rng.choice("ab"), rng.randrange(-50, 900)) for _ in range(80)]
    spans = [(rng.choice("ab"), s := rng.randrange(-90, 900), s + rng.randrange(-20, 400)) for _ in range(40)]
    last = {"a": 800, "b": 600}
    want = sorted((f, p, s, p - s) for f, p in pages for g, s, e in spans if f == g and s <= p <= min(e, last[f]))
    got = relational.pages_in_sections(spark.createDataFrame(pages, "pdf string, page long"), spark.createDataFrame(spans, "pdf string, start_page long, end_page long"), spark.createDataFrame([*last.items()], "pdf string, last_page long"))
    assert sorted((r["pdf"], r["page"], r["start_page"], r["page_index"]) for r in got.collect()) == want


def test_sections_of_any_width(spark):
    """Sections from one page to 100,000: the same pairs as by comparison, from a logarithmic number of rows."""
    rng = random.Random(8)
    pages = [(rng.choice("ab"), rng.randrange(-9, 120_000)) for _ in range(150)] + [("a", 119_999), ("a", 0), (None, 5), ("a", None)]
    spans = [(rng.choice("ab"), s := rng.randrange(0, 110_000), s + rng.choice([0, 1, 2, 63, 64, 65, 4095, 30_000, 99_999])) for _ in range(120)] + [("a", 0, 99_999), ("a", 119_999, 119_999), ("a", 5, 4), (None, 0, 10)]
    last = {"a": 119_999, "b": 70_000}
    want = sorted((f, p, s, e, p - s) for f, p in pages for g, s, e in spans if f and p is not None and f == g and s <= p <= min(e, last[f]))
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = relational.pages_in_sections(frame(pages, "pdf string, page long"), frame(spans, "pdf string, start_page long, end_page long"), frame([*last.items()], "pdf string, last_page long"))
    assert sorted((r["pdf"], r["page"], r["start_page"], r["end_page"], r["page_index"]) for r in got.collect()) == want and len(want) > 500
    assert len(got.schema) == 5


def test_mentions_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab\n😀,.") for _ in range(n))
    pages = [(i, word(rng.randrange(0, 400))) for i in range(60)] + [(60, None), (61, ""), (0, "ab" * 90)]
    cards = [(i, word(n)) for i, n in enumerate([0, 1, 1, 2, 3, 4, 5, 6, 7, 9, 13, 20] * 3)] + [(90, None), (91, ",."), (92, "ab")]
    cards += [(100 + i, rng.choice(pages[:60])[1][at : at + n]) for i, (at, n) in enumerate((a, n) for a in (0, 3, 17, 100) for n in (7, 15, 31, 63, 64, 126, 127, 128, 200))]
    clean = lambda t: (t or "").replace(",", "").replace(".", "")
    want = {(p, c) for p, t in pages for c, x in cards if clean(x) and clean(x) in clean(t)}
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = relational.mentions(frame(pages, "page_id"), frame(cards, "card_id")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 300
    assert relational.mentions(frame(pages, "page_id"), frame([], "card_id")).count() == 0


def test_numbered_equals_row_number(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(60), i) for i in range(500)]
    df = spark.createDataFrame(rng.sample(rows, 500), "a long, b long")
    want = {r: i + 1 for i, r in enumerate(sorted(rows))}
    for size in (1, 7, 100, 10**6):
        assert {(r["a"], r["b"]): r["n"] for r in sequence.numbered(df, "a", "b", "n", size).collect()} == want
    assert sequence.numbered(df.limit(0), "a", "b", "n").count() == 0


def greedy(units, window, known, other):
    out, i = [], 0
    while i < len(units):
        k = next((k for k in range(min(window, len(units) - i), 0, -1) if "".join(units[i : i + k]) in known), 0)
        out.append(known["".join(units[i : i + k])] if k else other(units[i]))
        i += k or 1
    return out


def test_dictionaries_as_tables(spark):
    rng = random.Random(7)
    terms = {"".join(rng.choice("你好中国人") for _ in range(rng.randrange(1, 8))): f"g{i}" for i in range(60)}
    texts = ["".join(rng.choice("你好中国人 x，") for _ in range(rng.randrange(0, 40))) for _ in range(80)] + [None, "", "abc", "你", next(iter(terms))]
    dictionary = spark.createDataFrame([*terms.items(), ("你好", None), (None, "x")], "term string, gloss string")
    df = spark.createDataFrame(list(enumerate(texts + texts[:3])), "id long, t string")
    by_trie, by_join = ({r["id"]: r["gloss"] for r in relational.gloss(df, "t", dictionary, bound=bound).collect()} for bound in (10**6, 0))
    assert by_trie == by_join
    got = by_trie
    clean = ["".join(c for c in t or "" if c not in "， ") for t in texts + texts[:3]]
    want = {i: terms.get(t) or ("; ".join(greedy(t, 6, terms, str)) if len(t) >= 2 and any("\u4e00" <= c <= "\u9fff" for c in t) else None) for i, t in enumerate(clean)}
    assert got == want
    toned = {"nǐhǎo": "你好", "hǎo": "好", "ma": "吗"}
    said = ["nǐ hǎo ma", "hǎo  ma nǐ", "no tones ma", "你 hǎo", None]
    for bound in (0, 100):
        df = segmentation.words_of_syllables(spark.createDataFrame(list(enumerate(said)), "id long, t string"), "t", spark.createDataFrame([*toned.items()], "term string, gloss string"), "s", {"ma": "嘛"}, bound)
        assert [r["s"] for r in df.orderBy("id").collect()] == ["你好吗", "好吗nǐ", "no tones ma", "你 hǎo", None]
    got = spark.createDataFrame([("nǐ hǎo ma 12",)], "t string").select(text.normalize_zh_ja(F.col("t"), "zh-cn", toned, {}).alias("zh"), text.normalize_zh_ja(F.col("t"), "ja", toned, {}).alias("ja")).first()
    assert tuple(got) == ("你好吗十二", "nǐ hǎo ma じゅうに")


def test_decimals_beside_units(spark):
    said = {"하지만3.5%": "하지만삼 점 오 퍼센트", "2663조3000억": "이천육백육십삼조삼천억", "3만5": "삼만오", "만 3": "만 삼"}
    got = spark.createDataFrame([*said.items()], "t string, want string").select("want", text.normalize_ko(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_visible_cards_are_counted(spark):
    records = spark.createDataFrame([(1, 5, False, "2024-01-15 01:00:00"), (1, 0, True, "2024-01-10 01:00:00")], "user_id long, score int, is_starred boolean, at string").withColumn("created_at", F.to_timestamp_ntz("at"))
    cards = spark.createDataFrame([(1, "general"), (1, "textbook"), (2, None), (3, "textbook"), (None, "general")], "user_id long, category string")
    got = sorted(map(tuple, relational.study_stats(records, "2024-01-15 12:00:00", cards).collect()))
    assert got == [(1, 2, 5.0, 1, 1, 3), (2, 0, 0.0, 0, 0, 3)]


def test_upserts_played_again(spark, tmp_path):
    from voxlake.streaming import running

    path = f"{tmp_path}/t"
    state = {}
    for n in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        rows = [(k, 10 * n + k, n) for k in range(n, 40, n + 1)]
        state |= {k: x for k, x, _ in rows}
        spark.createDataFrame(rows, "k long, x long, at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k long, x long, at long").parquet(f"{tmp_path}/in")
        running.upsert_sink(stream, path, ["k"], "at", 8).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
        assert {r["k"]: r["x"] for r in running.read_versions(spark, path).collect()} == state
    (tmp_path / "t" / "version=9").mkdir()  # one that was never finished
    assert {r["k"]: r["x"] for r in running.read_versions(spark, path).collect()} == state
    before = running.read_versions(spark, path, 3)
    assert before.count() and before.agg(F.max("at")).first()[0] == 2


def test_scopes_and_pairs_agree(spark):
    rows = spark.createDataFrame([(i, i % 4 if i else None, str(i)) for i in range(9)], "id long, voice_id long, text string")
    viewers = spark.createDataFrame([(0, 11), (1, 10), (2, 200), (3, None), (3, 50), (9, 3)], "id long, level int")
    pairs = {tuple(r) for r in relational.owner_scope(rows, viewers, "voice_id").select("viewer_id", "id").collect()}
    found = relational.scopes(rows, viewers, "voice_id").select("viewer_id", "sees_all", "id").collect()
    assert {(v, i) for v, every, x in found for i in (range(9) if every else [x])} == pairs
    assert sum(r["sees_all"] for r in found) == 2


def plain_walk(units, gloss, window, other):
    out, i = [], 0
    while i < len(units):
        k = max((k for k in range(1, window + 1) if i + k <= len(units) and "".join(units[i : i + k]) in gloss), default=0)
        out.append(gloss["".join(units[i : i + k])] if k else other(units[i]))
        i += k or 1
    return out


def test_terms_walk():
    """Against the plain walk: random texts of few letters, empty and null ones, chunks of any size, hashes that fall together, a shipped copy."""
    rng = random.Random(5)
    for trial in range(60):
        letters = "ab好𝄞"[: rng.randint(1, 4)]
        word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))  # noqa: E731, B023
        gloss = {word(6): rng.choice(["", "x", "long gloss"]) for _ in range(rng.choice([0, 1, 5, 40]))}
        terms = pickle.loads(pickle.dumps(segmentation.Terms(list(gloss), list(gloss.values()))))
        if trial % 3 == 0:
            terms.table[:] = True
        texts = [rng.choice([None, "", " ".join(word(3) for _ in range(rng.randint(1, 40)))]) for _ in range(8)]
        window = rng.randint(1, 6)
        for units in (list, str.split):
            want = [None if t is None else "|".join(plain_walk(units(t), gloss, window, str.upper)) for t in texts]
            with pytest.MonkeyPatch.context() as m:
                m.setattr(segmentation, "CHUNK", rng.choice([1, 7, 1000]))
                assert terms.read(texts, units, window, "|", str.upper) == want


def test_chunks(spark):
    """Limits hold but for long words, nothing but white space is lost, null and empty texts, a long text in linear time."""
    rng = random.Random(6)
    text_of = lambda n: "".join(rng.choice(["word", "a", "x" * 30, " ", ", ", ". ", "! ", "é", "\x85"]) for _ in range(n))
    texts = [text_of(rng.randint(0, 200)) for _ in range(100)]
    for t in texts:
        got = text.chunks_of(t, 40)
        assert all(len(c) <= 40 or " " not in c for c in got) and all(c.strip(text.ASCII_SPACE) == c != "" for c in got)
        squeeze = lambda s: "".join(s.split(" "))
        assert squeeze("".join(got)) == squeeze(t)
    rows = spark.createDataFrame([(None,), ("",), (text_of(300_000),)], "t string").select(F.size(text.pack_chunks(F.col("t"))).alias("n"), F.col("t").isNull().alias("gone")).collect()
    assert rows[0].n in (None, -1) and rows[1].n == 0 and rows[2].n > 1000


def test_terms_that_all_texts_hold(spark):
    """A large dictionary: a term is a row for some texts together, not for each; groups without a term, long texts, copies and null ones; all columns stay."""
    bits, one = np.full(1 << 13, 255, np.uint8), np.uint64(48)
    assert segmentation._unruled([["a", "b"]] * 100 + [[], ["c"]], 2, bits, one) == {"a", "b", "ab", "c"}
    rng = random.Random(8)
    gloss = {"a": "1", "ab": "2", "bca": "3", "dd": "4"}
    texts = [*("".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(40)), *["abca"] * 20, None, "", *["ee"] * 30, "abcd" * 30]
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "id long, t string, more array<long>").repartition(3, "id")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(segmentation, "TOGETHER", 4)
        m.setattr(segmentation, "ALONE", 100)
        got = segmentation.segmented(df, "t", spark.createDataFrame([*gloss.items()], "term string, gloss string"), "s", window=3, joined="|", bound=0).orderBy("id").collect()
    assert [(r["t"], r["s"], r["more"]) for r in got] == [(t, None if t is None else "|".join(plain_walk(list(t), gloss, 3, str)), [i]) for i, t in enumerate(texts)]


def test_batches_of_texts_are_read_one_at_a_time(spark, monkeypatch):
    """Neither chunks nor comparisons make all texts of a batch strings of Python at once; nulls, empty texts and many chunks come out as they should."""

    def none(*_):
        raise AssertionError("a batch of texts in pandas")

    monkeypatch.setattr(F, "pandas_udf", none)
    texts = [None, "", "a b. c!", "word, " * 70_000, None, "x" * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    assert [r["c"] for r in rows.select("i", text.pack_chunks(F.col("t"), 10).alias("c")).orderBy("i").collect()] == [None if t is None else text.chunks_of(t, 10) for t in texts]
    pairs = spark.createDataFrame([("aébc", "aexc"), (None, "a"), ("a", None), ("", ""), ("ab", "a")], "a string, b string").coalesce(1)
    got = pairs.select(scoring.compare_texts(F.col("a"), F.col("b"), {"é": "e"}).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(2, 1, "é", "b"), (None,) * 4, (None,) * 4, (0, 0, "", ""), (1, 0, "", "b")]


def test_acronyms_in_one_pass(spark):
    """Words of the table stand alone, in any case, longest first as a word each; the text is searched once for all of them."""
    said = {"ai IT wifi": "人工智能 信息技术 无线网络", "AIIT xAI aix": "诶爱爱替 x诶爱 aix", "AI/IT,USB3 ok": "人工智能/信息技术,优盘接口三 好的", "éAI中it": "é人工智能中信息技术", "": ""}
    zh = text.normalize_zh_ja(F.col("t"), "zh-cn")
    assert str(zh).count("(?i)") <= 3
    got = spark.createDataFrame([*said.items()], "t string, want string").select("want", zh.alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
