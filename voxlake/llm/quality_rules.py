"""Quality rules with thresholds that adapt to each language and source. DataFrame functions only.

Fixed base rules fail a document first. For the others every (lang, source) group gets fences of its own: Spark's
mergeable quantile sketch (`percentile_approx`, a Greenwald-Khanna summary, so partial sketches are merged and a group
of any size stays small) gives the quartiles of each ratio, and a document is kept while each of its ratios lies
within `reach` interquartile ranges, plus a tolerance, of them. Groups under `least` documents use the sketch of their
language, then that of all documents (one `rollup`). Thresholds are joined back by group.

Defined cases: null or empty text has no words and fails the base rules; null lang or source is a group of its own;
repeated rows are judged each; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Ratio, and how far beyond its fence a value may lie: a spread of zero must not reject the first that differs.
RATIOS = {"symbol_ratio": 0.05, "caps_ratio": 0.15, "dup_line_ratio": 0.4, "repeat_ratio": 0.2, "mean_word_chars": 2.0}
#: Ratios of which too little is as odd as too much.
TWO_SIDED = ("mean_word_chars",)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _less(text: Column, chars: str) -> Column:
    """How many characters of `text` are among `chars`."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measure(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Adds the measures of each text, and `n_lines` (lines with a word) and `n_caps` (ASCII capitals), as longs.

    Windows are compared by 64-bit hash within one text. Columns of the input keep their names; working columns start
    with `_q_`.
    """
    t = F.col("_q_text")
    df = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_q_words", F.filter(F.split(t, SPACE), lambda w: w != ""))
    df = df.withColumn("_q_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    words, n = F.col("_q_words"), F.size("_q_words")
    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(window))))
    df = df.withColumn("_q_win", F.when(n >= window, hashes).otherwise(F.array().cast("array<bigint>")))
    win = F.col("_q_win")
    df = df.withColumn("_q_twice", F.size(F.array_distinct(win)) < F.size(win))
    order = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_sorted", F.when(F.col("_q_twice"), order))
    s = F.col("_q_sorted")
    same = lambda j: F.coalesce(F.get(s, j)["h"], F.lit(0))
    again = F.filter(s, lambda x, j: ((j > 0) & (same(j - 1) == x["h"])) | ((j < F.size(s) - 1) & (same(j + 1) == x["h"])))
    df = df.withColumn("_q_at", F.when(F.col("_q_twice"), F.array_sort(F.transform(again, lambda x: x["i"]))))
    covered = F.aggregate(
        "_q_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + window - F.greatest(a["end"], p)).alias("n"), (p + window).alias("end")),
        lambda a: a["n"],
    )
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(t) - _less(t, " \t\n\x0b\x0c\r"),
            "n_symbols": _less(t, SYMBOLS),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_q_twice"), covered).otherwise(0).cast("long"),
            "n_lines": F.size("_q_lines").cast("long"),
            "n_caps": _less(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        }
    ).drop("_q_text", "_q_words", "_q_lines", "_q_win", "_q_twice", "_q_sorted", "_q_at")


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_ratio": per("n_symbols", "word_chars"),
        "caps_ratio": per("n_caps", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def thresholds(measured: DataFrame, accuracy: int = 2000) -> DataFrame:
    """A row for each (lang, source), each lang, and all: `n`, and the quartiles of every ratio from one merged sketch.

    `measured` has the ratios and `base_failed`; failed documents shape no threshold. `level` is 0 for (lang, source), 1
    for a language and 3 for all.
    """
    good = measured.filter(~F.col("base_failed"))
    quartiles = [F.percentile_approx(r, [0.25, 0.75], accuracy).alias(r) for r in RATIOS]
    return good.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *quartiles)


def judge(measured: DataFrame, limits: DataFrame, least: int = 50, reach: float = 3.0) -> DataFrame:
    """Adds `kept`: within every fence of the finest group of at least `least` documents, and not `base_failed`."""
    limits = written(limits, "limits")  # so that Spark knows their size, and moves no text to join a few rows
    for level, name, keys in ((0, "_l0", ("lang", "source")), (1, "_l1", ("lang",)), (3, "_l3", ())):
        picked = limits.filter((F.col("level") == level) & (F.col("n") >= (least if keys else 0)))
        picked = picked.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.struct(*RATIOS).alias(name))
        if keys:
            on = [F.col(k).eqNullSafe(F.col(f"{name}_{k}")) for k in keys]
            measured = measured.join(picked, on, "left").drop(*(f"{name}_{k}" for k in keys))
        else:
            measured = measured.join(F.broadcast(picked), F.lit(True), "left")  # one row
    at = F.coalesce("_l0", "_l1", "_l3")
    inside = F.lit(True)
    for r, slack in RATIOS.items():
        low, high = F.get(at[r], F.lit(0)), F.get(at[r], F.lit(1))
        inside &= F.col(r) <= high + reach * (high - low) + slack
        if r in TWO_SIDED:
            inside &= F.col(r) >= low - reach * (high - low) - slack
    return measured.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("_l0", "_l1", "_l3")


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, measures, ratios, base_failed and kept of every row of `docs`."""
    df = measure(docs.select("doc_id", "text", "lang", "source")).drop("text")
    df = df.withColumns(_ratios()).withColumn("base_failed", base_failed())
    df = written(df, "quality")  # texts are read once; sketches and the join both start from these few numbers
    return judge(df, thresholds(df))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    Rows are written once with their measures: a filter pushed below the measures would take them again.
    """
    names = {c: F.col(c) for c in docs.columns}
    df = measure(docs.select(F.struct(*names).alias("_q_row"), "text", "lang", "source")).drop("text")
    df = written(df.withColumns(_ratios()).withColumn("base_failed", base_failed()), "quality")
    return judge(df, thresholds(df)).filter("kept").select("_q_row.*")
