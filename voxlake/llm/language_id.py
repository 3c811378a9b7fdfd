"""Language identification by rank-order profiles (out-of-place distance of Cavnar and Trenkle).

A profile is the list of a language's most frequent character n-grams (1 to 3, within words, blanks as word ends). A
text's own most frequent n-grams are compared by rank: each costs its distance in rank, and one that the profile lacks
costs the profile's length.

Profiles are fitted on a bounded, documented sample of labelled rows: about `per_lang` documents a language, chosen by
hash of the id against a share that the counts by language give, so no text is shuffled to choose them.

Defined cases: a null text or one without a letter is `und` with score 0; a null lang is not learned from; ties go to
the smaller language name, equal counts to the smaller n-gram code; without any labelled row all is `und`; repeated rows
are judged each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled

SLICE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (three 21-bit code points) of a text's n-grams, and how often each occurs.

    Long texts go by slices, which end at a character that is no letter, so that the counts are those of the whole text.
    """
    text = text.lower()
    codes, counts, at = [], [], 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end].isalpha():
            end += 1
        c = np.frombuffer(text[at:end].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        at = end
        letter = _letters()[c]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        c = np.concatenate([[32], np.where(letter, c, 32)[keep], [32]])
        is_letter = c != 32
        two = c[:-1] | c[1:] << 21
        three = two[:-1] | c[2:] << 42
        got = np.concatenate([c[is_letter], two[is_letter[:-1] | is_letter[1:]], three[is_letter[1:-1]]])
        u, n = np.unique(got, return_counts=True)
        codes.append(u)
        counts.append(n)
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, where = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            parts = [gram_counts(t) for t in texts]
            u, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            yield pd.DataFrame({"lang": lang, "gram": u, "n": np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)})


def fit(labelled: DataFrame, per_lang: int = 3000, size: int = 400) -> dict[str, list[int]]:
    """Profiles: the `size` most frequent n-gram codes of each language, from about `per_lang` documents of each.

    `labelled` has doc_id, text and lang. What reaches the driver is `size` codes a language.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("doc_id is not null and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_lang / n))))
    chosen = rows.filter(sampled("doc_id", share[F.col("lang")]))
    grams = chosen.select("lang", "text").mapInPandas(_count_grams, "lang string, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def predictor(profiles: dict[str, list[int]], size: int = 400):
    """A function from a text to (language, score); score is 1 minus the mean out-of-place distance over its maximum."""
    langs = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    ranks = np.full((len(known) + 1, max(1, len(langs))), -1, np.int64)
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(known, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text) if text else ((), ())
        if not len(grams) or not langs:
            return "und", 0.0
        top = grams[np.argsort(-counts, kind="stable")[:size]]
        at = np.searchsorted(known, top)
        at[known[np.minimum(at, len(known) - 1)] != top] = len(known)
        theirs = ranks[at]
        off = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(top))[:, None])).sum(0)
        k = int(off.argmin())
        return langs[k], float(1 - off[k] / (size * len(top)))

    return predict


def identify(text: Column, profiles: dict[str, list[int]]) -> Column:
    """Struct of lang_pred and score for a text column; the profiles are a few kilobytes a language."""

    @F.pandas_udf("lang_pred string, score double")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = predictor(profiles)
        for s in texts:
            yield pd.DataFrame([predict(t) for t in s], columns=["lang_pred", "score"]).astype({"score": float})

    return udf(text)


def keep_known(docs: DataFrame, profiles: dict[str, list[int]], least: float = 0.02) -> DataFrame:
    """The rows of `docs` with a language: not `und`, and nearer to some profile than a text that shares nothing with it."""
    row = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_l_row"), F.col("text"))
    row = row.withColumn("_l", identify(F.col("text"), profiles))
    return row.filter((F.col("_l.lang_pred") != "und") & (F.col("_l.score") >= least)).select("_l_row.*")
