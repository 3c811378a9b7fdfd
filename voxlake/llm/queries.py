"""The operators as queries over the whole given tables, and their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, language_id, licenses, merkle, near_dups, packing, piece_sampling, quality_model, quality_rules, runs, suffix_dedup, topk, warc
from .common import Scratch, fold, new_folder, table

#: A public model of the tokenizers package; see README.
PIECE_MODEL = os.environ.get("VOXLAKE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record and reads the archives back."""
    path = new_folder(spark, "warc")
    index = warc.write(warc.with_duplicates(table(spark, sf_dir, "pages")), path)
    return warc.records(warc.read_chunks(spark, path, index, data=False))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of every 50th vector, by inner product."""
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    labels = labels.filter(fold(F.col("doc_id"), 4) != 2)
    model = quality_model.fit(docs.join(labels, "doc_id"))
    df = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), quality_model.score(F.col("text"), model).alias("score"))
    return df.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.fit(docs.filter(fold(F.col("doc_id"), 3) != 1))
    df = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), language_id.identify(F.col("text"), profiles).alias("p"))
    return df.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op6_piece_sampling(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    df = piece_sampling.encode(table(spark, sf_dir, "documents"), model)
    back = piece_sampling.decode(F.col("pieces"), model)
    return df.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), back.eqNullSafe(F.col("text")).alias("lossless"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.assess(table(spark, sf_dir, "documents"))
    return df.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of `documents`, and each leaf folded to a root again; a third of them after tampering with the text."""
    docs = table(spark, sf_dir, "documents")
    upper = "".join(map(chr, range(65, 91)))
    tampered = [F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in merkle.FIELDS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.digest(tampered))
    df = merkle.manifest(docs, Scratch(spark, "merkle"), {"changed": changed})
    df = df.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path"))).withColumn("proof_sha256", merkle.proof(F.col("path")))
    return df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def repeating_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth text by crc32 of its id, h, repeats itself from a word on: with g = h / 10, from word a = g % n with period 1 + (n - a) / (3 + g % 8)."""
    df = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string"))).withColumn("_g", F.floor(F.col("_h") / 10))
    df = df.select("doc_id", "text", "_g", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(runs.WORD), F.lit(0))).alias("_w"))
    df = df.withColumn("_a", F.when(F.size("_w") > 0, (F.col("_g") % F.size("_w")).cast("int")))
    df = df.withColumn("_p", 1 + F.floor((F.size("_w") - F.col("_a")) / (3 + F.col("_g") % 8)).cast("int"))
    tail = F.transform(F.sequence(F.col("_a"), F.size("_w") - 1), lambda i: F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    return df.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runs.with_runs(repeating_tails(table(spark, sf_dir, "documents")), F.col("text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    milli = F.floor(1000 * F.col("longest.length") / F.col("longest.period"))
    return df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.*", milli.alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "suffix-dedup"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return df.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_topk, op3_quality_model, op4_language_id, op5_near_dups, op6_piece_sampling, op7_quality_rules, op8_licenses, op9_html_text, op10_packing, op11_merkle, op12_runs, op13_suffix_dedup)}

_OP1 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS digest_ok FROM d"""

_OP2 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5"""

_OP7_MEASURES = r"""
m0 AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
m1 AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM m0),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM m1)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS x(k) GROUP BY r),
m AS (SELECT m1.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_caps FROM m1 LEFT JOIN rep USING (r))"""


def _op7() -> str:
    ratio = lambda a, b: f"{a}::DOUBLE / greatest({b}, 1)"
    ratios = {"symbol_ratio": ratio("n_symbols", "word_chars"), "caps_ratio": ratio("n_caps", "word_chars"), "dup_line_ratio": ratio("n_dup_lines", "n_lines")}
    ratios |= {"repeat_ratio": ratio("n_repeat_words", "n_words"), "mean_word_chars": ratio("word_chars", "n_words")}
    quart = ", ".join(f"quantile_disc({r}, 0.25) AS {r}_a, quantile_disc({r}, 0.75) AS {r}_b" for r in ratios)
    inside = []
    for r, slack in quality_rules.RATIOS.items():
        a, b = (f"CASE WHEN l0.n >= 50 THEN l0.{r}_{x} WHEN l1.n >= 50 THEN l1.{r}_{x} ELSE l3.{r}_{x} END" for x in "ab")
        inside.append(f"{r} <= ({b}) + 3 * (({b}) - ({a})) + {slack}::DOUBLE")
        if r in quality_rules.TWO_SIDED:
            inside.append(f"{r} >= ({a}) - 3 * (({b}) - ({a})) - {slack}::DOUBLE")
    return f"""
WITH {_OP7_MEASURES},
f AS (SELECT *, {", ".join(f"{x} AS {r}" for r, x in ratios.items())}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
l0 AS (SELECT lang, source, count(*) AS n, {quart} FROM f WHERE NOT base_failed GROUP BY 1, 2),
l1 AS (SELECT lang, count(*) AS n, {quart} FROM f WHERE NOT base_failed GROUP BY 1),
l3 AS (SELECT {quart} FROM f WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(inside)}, false) AS kept
FROM f LEFT JOIN l0 ON f.lang IS NOT DISTINCT FROM l0.lang AND f.source IS NOT DISTINCT FROM l0.source
  LEFT JOIN l1 ON f.lang IS NOT DISTINCT FROM l1.lang LEFT JOIN l3 ON true"""


#: crc32 of decimal ids, a byte at a time through the table of its 256 remainders
_CRC = """
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)"""


def _op11(levels: int = 9) -> str:
    """Trees of up to 8 ** levels leaves a lang, and as many langs: each level has its nodes and every node's siblings."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    fields = lambda text: " || ".join(part(text if c == "text" else c) for c in merkle.FIELDS)

    def tree(name: str, start: str) -> str:
        out = f"{name}0 AS MATERIALIZED ({start})"
        for k in range(levels):
            out += f""",
{name}{k + 1} AS MATERIALIZED (SELECT g, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{k} GROUP BY g, pos // 8, n),
{name}s{k} AS MATERIALIZED (SELECT a.g, a.pos, a.n, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.pos // 8 = b.pos // 8 GROUP BY a.g, a.pos, a.n)"""
        return out

    upper = lambda text: f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sides = [f"u{k}" for k in range(levels)] + [f"v{k}" for k in range(levels)]
    joins = []
    for s in sides:
        t, k, of = s[0], int(s[1:]), "leaf" if s[0] == "u" else "sub"
        joins.append(f"JOIN {t}s{k} {s} ON {s}.g = x0.{of}_g AND {s}.pos = x0.{of}_pos // {8**k}")
    folds = []
    for i, s in enumerate(sides):
        folds.append(f"f{i} AS MATERIALIZED (SELECT * EXCLUDE (f), CASE WHEN n{i} = 1 THEN f ELSE sha256(l{i} || f || r{i}) END AS f FROM {f'f{i - 1}' if i else 'x1'})")
    proof = " || ".join(f"CASE WHEN n{i} = 1 THEN '' ELSE l{i} || r{i} END" for i in range(len(sides)))
    return f"""
WITH {_CRC},
leaves AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS g, sha256({fields("text")}) AS leaf, sha256({fields(upper("text"))}) AS lowered FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{tree("u", "SELECT g, pos, n, leaf AS d FROM placed")},
subs AS MATERIALIZED (SELECT g AS sub, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, d FROM u{levels}),
{tree("v", "SELECT '' AS g, pos, n, d FROM subs")},
x0 AS (SELECT p.doc_id, leaf, CASE WHEN h % 3 = 0 THEN lowered END AS changed, p.g AS leaf_g, p.pos AS leaf_pos, '' AS sub_g, s.pos AS sub_pos, s.d AS subroot, v.d AS root
  FROM placed p LEFT JOIN crc USING (doc_id) JOIN subs s ON s.sub = p.g JOIN v{levels} v ON true),
x1 AS MATERIALIZED (SELECT x0.*, coalesce(changed, leaf) AS f, {", ".join(f"{s}.l AS l{i}, {s}.r AS r{i}, {s}.n AS n{i}" for i, s in enumerate(sides))} FROM x0 {" ".join(joins)}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(sides) - 1}"""


_OP12 = rf"""
WITH {_CRC},
w0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
w1 AS (SELECT w0.*, h, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM w0 LEFT JOIN crc USING (doc_id)),
w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
w3 AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM w2),
e AS MATERIALIZED (SELECT r, i, hash(array_to_string(w[i + 1:i + 8], ' ')) AS k FROM (SELECT r, w, unnest(range(n - 7)) AS i FROM w3 WHERE n >= 24)),
-- eight words equal those q later: stretches of such places
same AS (SELECT a.r, a.i, b.i - a.i AS q FROM e a JOIN e b ON a.r = b.r AND a.k = b.k AND b.i > a.i),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM same),
st AS (SELECT r, q, min(i) AS s, max(i) + 8 + q AS e FROM isle GROUP BY r, q, isle),
runs AS MATERIALIZED (SELECT r, s, e - s AS l, min(q) AS q FROM st WHERE e - s >= greatest(24, 3 * q) GROUP BY r, s, e),
per AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM runs GROUP BY r),
-- exact fractions: 10 ** 12 keeps the order of quotients of numbers under 10 ** 6
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY l::HUGEINT * 1000000000000 // q DESC, s, q) = 1),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
gone1 AS (SELECT r, list(i) AS g FROM gone GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(txt, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(g, j - 1)) END, ' ')) AS collapsed_sha256
FROM w3 LEFT JOIN per USING (r) LEFT JOIN best USING (r) LEFT JOIN gone1 USING (r)"""


SQL = {"op11_merkle": _op11(), "op12_runs": _OP12} | {"op1_warc": _OP1, "op2_topk": _OP2, "op7_quality_rules": _op7(), "op8_licenses": licenses.oracle()}
