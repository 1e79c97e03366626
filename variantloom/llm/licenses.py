"""Licence scans by canonical digests.

A text is reduced to a canonical form (case, punctuation, copyright lines and equivalent spellings do
not matter), and the digest of the whole form is joined with the digests of known licence texts. Short
notices are known as lines.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm.common import read_table

# fixed values: public licence texts and notices
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("cancelled", "canceled"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("owner", "holder"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
]
# end of fixed values

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{2010}-\x{201F}]+"


def canonical(text: Column) -> Column:
    """The canonical form: words of a-z, 0-9 and letters outside ASCII, with one space between."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    plain = F.regexp_replace(F.regexp_replace(low, COPYRIGHT_LINE, "\n"), PUNCTUATION, "  ")
    out = F.concat(F.lit("  "), plain, F.lit("  "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {usual} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    """Digest of the canonical form; null when nothing is left of the text."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


@cache
def known_texts() -> tuple[tuple[str, str], ...]:
    """(id, text) of the shipped table: KNOWN, whole texts in their usual line lengths, standard headers and one-line notices."""
    shipped = Path(__file__).with_name("known_licenses.jsonl").read_text(encoding="utf-8").splitlines()
    return (*KNOWN, *((r["license_id"], r["known_text"]) for r in map(json.loads, shipped)))


def known_digests(spark: SparkSession, known: DataFrame | list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``license_id, license_digest``, one row for each distinct digest: as long as the list of known texts."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license_id string, known_text string")
    return rows.groupBy(digest(F.col("known_text")).alias("license_digest")).agg(F.min("license_id").alias("license_id")).where("license_digest IS NOT NULL")


def scan(df: DataFrame, known: DataFrame | list[tuple[str, str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: ``key``, ``license_digest`` of the whole text, ``license_id`` it is known as,
    and ``notices``: ids known for single lines, comma-joined, distinct, in order of the ids.

    Whole texts are hash-joined on their digest. The lines that name a licence at all are looked up in
    the row. ``known`` is a table ``license_id, known_text``, or rows of one; without it, the shipped table. Null and empty texts have no digest, no id and empty notices; null keys and repeated rows
    stay; other columns are left out. The known table is as long as there are known texts, so its join
    side may be broadcast.
    """
    spark = df.sparkSession
    digests = known_digests(spark, list(known_texts()) if known is None else known).collect()  # as long as the known table
    table = spark.createDataFrame(digests, "license_digest string, license_id string")
    notice_ids = F.from_json(F.lit(json.dumps({r["license_digest"]: r["license_id"] for r in digests})), "map<string,string>")
    own = df.select(F.col(key).alias("key"), F.col(text).alias("body"))
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda line: F.regexp_like(line, F.lit("(?i)licen[cs]e")))
    looked = own.withColumns({"license_digest": digest(F.col("body")), "line_digests": F.transform(lines, digest)})
    by_row = looked.join(F.broadcast(table), "license_digest", "left")
    ids = F.filter(F.transform("line_digests", lambda d: notice_ids[d]), lambda i: i.isNotNull())
    found = F.array_join(F.array_sort(F.array_distinct(ids)), ",")
    return by_row.select(F.col("key").alias(key), "license_digest", "license_id", found.alias("notices"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    low = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    plain = f"regexp_replace(regexp_replace({low}, '{COPYRIGHT_LINE}', chr(10), 'g'), '{PUNCTUATION}', '  ', 'g')"
    out = f"'  ' || {plain} || '  '"
    for other, usual in SPELLINGS:
        out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {usual} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


def oracle(known: list[tuple[str, str]] = KNOWN) -> str:
    rows = ", ".join(f"({_text(i)}, {_text(t)})" for i, t in known)
    return f"""
WITH known AS (
  SELECT sha256({_canonical_sql("known_text")}) AS license_digest, min(license_id) AS license_id
  FROM (VALUES {rows}) AS v(license_id, known_text) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents),
whole AS (SELECT row_no, doc_id, CASE WHEN form <> '' THEN sha256(form) END AS license_digest
  FROM (SELECT row_no, doc_id, {_canonical_sql("text")} AS form FROM docs)),
lines AS (
  SELECT row_no, sha256({_canonical_sql("line")}) AS license_digest
  FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '(?i)licen[cs]e')),
notices AS (SELECT row_no, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM lines JOIN known USING (license_digest) GROUP BY 1)
SELECT doc_id, license_digest, license_id, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (license_digest) LEFT JOIN notices USING (row_no)"""
