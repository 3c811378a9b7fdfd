"""Licence scans by canonical digest: texts are normalised, digested, and hash-joined to the digests of known licences.

Canonical form: lower case; everything but letters, digits and line ends becomes one blank; copyright statements go;
equivalent spellings become one, word by word; lines are joined by a blank. A whole text is joined by its digest; every line
of it is looked up too, since a notice is often one line of a longer text. No fuzzy matching: one different word is no match.

Known licences are a table (license_id, text) of any size; by default that of `default_known`: the entire texts in
license_texts/ and the notices below. Up to `SMALL` digests of them are broadcast, so the texts are not shuffled. Beyond that
digests are joined by a shuffle, whole texts and lines alike, with the same result.

Defined cases: a null, empty or copyright-only text has the digest of the empty string and no licence; such known texts, and
those without a name, are none; repeated rows and null ids are scanned each; of two known texts with one canonical form the
smaller licence name is told; very long texts are taken whole; an empty table gives an empty one; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence notices and texts as their owners publish them, spellings that count as equal, copyright lines.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    (
        "MIT",
        """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
]
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("favour", "favor"),
    ("v2", "version 2"),
    ("v3", "version 3"),
]
#: A line that is a copyright statement: with (c), a year or an owner, not prose that happens to be wrapped before the word.
PROSE = "also|and|are|claims|disclaimer|doctrines|for|holders?|if|in|infringement|interests?|is|laws?|licen[sc]es?|like|lines?|notices?|of|on|or|owners?|ownership|patent|permissions?|protection|statements?|the (software|program|library|work)|those|to|treaty"
STATEMENT = rf"^(copyright (?!({PROSE})( |$)).*|c [0-9]{{4}}( .*)?|[0-9]{{4}} copyright( .*)?|all rights reserved( (?!permission |redistribution ).*)?)$"
#: The SQL's pattern. It drops each line that begins with the word, so the two agree only on texts without such prose lines.
COPYRIGHT = r"^(copyright|c [0-9]{4}|[0-9]{4} copyright|all rights reserved)( |$)"


#: Licences whose entire text is in license_texts/, besides the two in KNOWN.
ENTIRE = "Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 GPL-2.0-only GPL-3.0-only LGPL-2.1-only LGPL-3.0-only MPL-1.1 MPL-2.0 Unlicense Zlib".split()
#: Digests of known texts (some 50 bytes each) that are broadcast.
SMALL = 10_000


def entire_texts() -> list[tuple[str, str]]:
    """(licence, text) of each entire text: also without its title, with other bullets, without the appendix on its use."""
    texts = [(i, t) for i, t in KNOWN if t.startswith(f"{i} License\n")]
    texts += [(i, pkgutil.get_data(__package__, f"license_texts/{i}.txt").decode()) for i in ENTIRE]
    out = []
    for i, t in texts:
        out += [(i, t)]
        if i in ("MIT", "ISC") or i.startswith("BSD"):
            bare = t.partition("\n")[2]
            out += [(i, bare)] + [(i, re.sub(r"(?m)^[0-9]\. ", "* ", x)) for x in (t, bare)]
        if (end := t.find("END OF TERMS AND CONDITIONS")) >= 0:
            out += [(i, t[:end]), (i, t[:end] + "END OF TERMS AND CONDITIONS")]
    return out


def _respelled(t: Column, spellings: list[tuple[str, str]]) -> Column:
    """Spellings replaced in words between blanks. Blanks are doubled first, so no two neighbours share one."""
    t = F.replace(t, F.lit(" "), F.lit("  "))
    for old, new in spellings:
        t = F.replace(t, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.replace(t, F.lit("  "), F.lit(" "))


def canonical_lines(text: Column) -> Column:
    """Array of a text's canonical lines, without empty and copyright ones."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    t = F.concat(F.lit(" "), F.replace(t, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    lines = F.transform(F.split(_respelled(t, SPELLINGS), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(STATEMENT))


def digest(lines: Column) -> Column:
    """md5 of the joined lines; spellings of two words are looked for again, since a line may end between them."""
    t = F.concat(F.lit(" "), F.array_join(lines, " "), F.lit(" "))
    return F.md5(F.trim(_respelled(t, [x for x in SPELLINGS if " " in x[0]])))


def default_known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + entire_texts(), "license_id string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """known_digest and license_id of a table (license_id, text)."""
    df = known.filter("license_id is not null").select(canonical_lines(F.col("text")).alias("lines"), "license_id").filter(F.size("lines") > 0)
    return df.groupBy(digest(F.col("lines")).alias("known_digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, license_id (of the whole text, else null), n_license_lines and line_licenses of every row.

    `line_licenses` are the distinct licences of its lines, sorted, joined by commas.
    """
    found = known_digests(default_known(docs.sparkSession) if known is None else known)
    first = found.limit(SMALL + 1).collect()
    df = docs.select("doc_id", canonical_lines(F.col("text")).alias("_lines"))
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(hits)), ",").alias("line_licenses")
    if 0 < len(first) <= SMALL:
        table = F.create_map(*(F.lit(x) for r in first for x in (r["known_digest"], r["license_id"])))
        df = df.withColumn("_hits", F.filter(F.transform("_lines", lambda x: table[F.md5(x)]), lambda x: x.isNotNull()))
        df = df.select("doc_id", digest(F.col("_lines")).alias("text_digest"), F.size("_hits").cast("long").alias("n_license_lines"), names(F.col("_hits")))
        return df.join(F.broadcast(found), F.col("text_digest") == F.col("known_digest"), "left").drop("known_digest")
    # a row for the whole text (whole = 1) and each line of it, in one join; texts that share a line are spread by AQE
    df = df.withColumn("_row", F.monotonically_increasing_id())
    keys = F.concat(F.array(F.struct(F.lit(1).alias("whole"), digest(F.col("_lines")).alias("d"))), F.transform("_lines", lambda x: F.struct(F.lit(0).alias("whole"), F.md5(x).alias("d"))))
    df = df.select("_row", "doc_id", F.explode(keys).alias("k")).join(found, F.col("k.d") == F.col("known_digest"), "left")
    line = (F.col("k.whole") == 0) & F.col("license_id").isNotNull()
    df = df.groupBy("_row", "doc_id").agg(
        F.max(F.when(F.col("k.whole") == 1, F.col("k.d"))).alias("text_digest"),
        F.count_if(line).alias("n_license_lines"),
        names(F.collect_set(F.when(line, F.col("license_id")))),
        F.max(F.when(F.col("k.whole") == 1, F.col("license_id"))).alias("license_id"),
    )
    return df.select("doc_id", "text_digest", "n_license_lines", "line_licenses", "license_id")


def oracle() -> str:
    """The same in DuckDB SQL."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(col: str) -> str:
        t = rf"regexp_replace(lower(coalesce({col}, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
        t = f"' ' || replace({t}, chr(10), ' ' || chr(10) || ' ') || ' '"
        for old, new in SPELLINGS:
            t = f"replace({t}, {q(f' {old} ')}, {q(f' {new} ')})"
        return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, {q(COPYRIGHT)}))"

    values = ", ".join(f"({q(i)}, {q(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT md5(array_to_string({lines("t")}, ' ')) AS kd, min(i) AS license_id FROM (VALUES {values}) AS v(i, t) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, {lines("text")} AS ls FROM documents),
hits AS (SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names
  FROM (SELECT r, unnest(ls) AS l FROM docs) JOIN known ON md5(l) = kd GROUP BY r)
SELECT doc_id, md5(array_to_string(ls, ' ')) AS text_digest, k.license_id, coalesce(h.n, 0)::BIGINT AS n_license_lines,
  coalesce(h.names, '') AS line_licenses
FROM docs LEFT JOIN hits h USING (r) LEFT JOIN known k ON md5(array_to_string(ls, ' ')) = k.kd"""
