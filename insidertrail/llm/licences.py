"""Licence scans: entire texts, brought to a canonical form, are looked up among digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm.common import table

# Texts of public licences and the usual one-line notices of others, with their identifiers.
PERMISSION_NOTICE = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.")
USE_AND_DISTRIBUTE = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted{}.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
KNOWN_TEXTS = [
    ("MIT", PERMISSION_NOTICE),
    ("MIT", "MIT License\n\n" + PERMISSION_NOTICE),
    ("MIT", "The MIT License (MIT)\n\n" + PERMISSION_NOTICE),
    ("ISC", USE_AND_DISTRIBUTE.format(
        ", provided that the above copyright notice and this permission notice appear in all copies")),
    ("ISC", "ISC License\n\n" + USE_AND_DISTRIBUTE.format(
        ", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", USE_AND_DISTRIBUTE.format("")),
    ("0BSD", "BSD Zero Clause License\n\n" + USE_AND_DISTRIBUTE.format("")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]
# Spellings that licence matching takes as equal.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("fulfil ", "fulfill "), ("whilst", "while"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"), ("https", "http"),
]
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright (\(c\)|©|[0-9])|\(c\)|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words separated by one space, one spelling; null stays null."""
    plain = F.regexp_replace(F.lower(F.replace(text, F.lit("\r"), F.lit("\n"))), COPYRIGHT_LINE, "")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, NOT_WORD, " ")), F.lit(" "))
    for old, new in SPELLINGS:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.trim(plain)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN_TEXTS) -> DataFrame:
    """(licence_digest, licence): one row per canonical text; of equal texts the first identifier counts."""
    return (spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(known)], "n int, licence string, known string")
            .groupBy(digest(F.col("known")).alias("licence_digest")).agg(F.min_by("licence", "n").alias("licence")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known=KNOWN_TEXTS) -> DataFrame:
    """One row per document: key, text_digest and the licence whose canonical text equals the whole text.

    Native DataFrame operations only.  The known texts are a parameter of a few hundred rows, so their
    digests are broadcast and documents are never moved.  A null text has a null digest and no licence; a
    text without letters or digits has the digest of the empty text; repeated rows and null keys give a
    row each.
    """
    rows = docs.select(F.col(key).alias("__key"), digest(F.col(text)).alias("text_digest"))
    names = F.broadcast(known_digests(docs.sparkSession, known))
    return (rows.join(names, F.col("text_digest") == F.col("licence_digest"), "left")
            .select(F.col("__key").alias(key), "text_digest", "licence"))


def scan_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", known=KNOWN_TEXTS) -> DataFrame:
    """(key, line, licence) for each line, counted from 1, that as a whole is a known text."""
    lines = docs.select(F.col(key).alias("__key"), F.posexplode(F.split(F.col(text), "\n")).alias("__at", "__line"))
    names = F.broadcast(known_digests(docs.sparkSession, known))
    return (lines.join(names, digest(F.col("__line")) == F.col("licence_digest"))
            .select(F.col("__key").alias(key), (F.col("__at") + 1).alias("line"), "licence"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    plain = (f"regexp_replace(lower(replace({text}, chr(13), chr(10))), "
             f"{_sql_text(COPYRIGHT_LINE)}, '', 'g')")
    plain = f"' ' || trim(regexp_replace({plain}, {_sql_text(NOT_WORD)}, ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        plain = f"replace({plain}, {_sql_text(old)}, {_sql_text(new)})"
    return f"trim({plain})"


OP9_SQL = f"""
WITH given(n, licence, known) AS (VALUES
  {", ".join(f"({i}, {_sql_text(k)}, {_sql_text(t)})" for i, (k, t) in enumerate(KNOWN_TEXTS))}),
names AS (SELECT sha256({_canonical_sql("known")}) AS text_digest, arg_min(licence, n) AS licence FROM given GROUP BY 1),
texts AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS text_digest FROM documents)
SELECT doc_id, t.text_digest, licence FROM texts t LEFT JOIN names n ON t.text_digest = n.text_digest
"""
