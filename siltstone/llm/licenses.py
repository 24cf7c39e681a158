"""Licence scan: canonical digests of texts, passages, blocks and lines, looked up in a table of known ones.

A text is brought into canonical form: lower case, punctuation and blanks as one space, lines of
a copyright notice left out, equivalent spellings made one. The digest of the whole text, of each
block between empty lines and of each line is joined by hash to the digests of known licence texts.
A known text of several blocks is also found within a document, as a passage: its blocks' digests are joined in
the same way, and it is there if they come side by side, in order and all. Only whole units match, so prose that merely
mentions a licence does not.

Known are notices (KNOWN) and the published texts in license_texts, each with and without its title, and with and
without what follows its last term. Read on the driver, some 300 kB.

The table of known digests is written first, so that the planner knows its size: it is
broadcast if it is below the session's threshold, else joined by a shuffle of digests.

Nulls: a null or empty text, and a unit without letters or digits, matches nothing. Repeated rows
each match; a unit that is repeated within a text is reported once. An empty table gives no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import staged, texts

#: Equivalent spellings, the second form standing for both.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("merchantibility", "merchantability"),
    ("whilst", "while"), ("wilful", "willful"), ("favour", "favor"), ("behaviour", "behavior"),
    ("organisation", "organization"), ("authorised", "authorized"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("artefact", "artifact"), ("fulfil", "fulfill"), ("judgement", "judgment"),
    ("programme", "program"), ("https", "http"), ("v 2 0", "version 2 0"), ("percent", "per cent"),
]

#: Notices, by SPDX identifier.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


#: Lines of a copyright notice, in canonical form, and the empty lines between blocks.
NOTICE = r"(?m)^ ?(?:copyright (?:c |©|\d|by |the )|copyright$|c \d{4}|©|all rights reserved ?$)[^\n]*$"
BETWEEN = r"\n ?\n[ \n]*"


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all that is known, texts with their variants."""
    out = list(KNOWN)
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        blocks = re.split(r"\n[ \t\f]*\n\s*", file.read_text(encoding="utf-8").strip())
        ends = [i + 1 for i, x in enumerate(blocks) if x.strip().lower() == "end of terms and conditions"]
        for first in (0, 1)[: 1 + (len(blocks[0].split()) < 16)]:
            out += [(file.stem, "\n\n".join(blocks[first:end])) for end in (len(blocks), *ends, *(e - 1 for e in ends))]
    return out


def canonical_lines(text: Column) -> Column:
    """The canonical form, its lines still apart (a line feed with single spaces around words)."""
    out = F.regexp_replace(F.lower(text), F.lit(r"[^\p{L}\p{N}\n©]+"), F.lit(" "))
    out = F.regexp_replace(out, F.lit(NOTICE), F.lit(""))
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SPELLINGS))

    def spelt(text: Column, pair: Column) -> Column:
        whole = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), pair["a"], F.lit(r"(?![\p{L}\p{N}])"))
        return F.when(F.contains(text, pair["a"]), F.regexp_replace(text, whole, pair["b"])).otherwise(text)

    return F.aggregate(pairs, out, spelt)


def _flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, F.lit(r"\s+"), F.lit(" ")))


def digest(flat: Column) -> Column:
    return F.sha2(flat, 256)


def _blocks(canonical: Column) -> Column:
    return F.filter(F.transform(F.split(canonical, BETWEEN), _flat), lambda x: x != "")


def _words(flat: Column) -> Column:
    return F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + 1


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(known_digest, license, text_digest, seq, n_blocks, text_words): of each known text, seq null, and of each block of those that have several."""
    rows = spark.createDataFrame(known or known_texts(), "license string, text string").withColumn("c", canonical_lines(F.col("text")))
    whole = rows.groupBy(digest(_flat(F.col("c"))).alias("text_digest"), _words(_flat(F.col("c"))).alias("text_words")).agg(F.min("license").alias("license"), F.max(_blocks(F.col("c"))).alias("blocks"))
    whole = whole.withColumn("n_blocks", F.size("blocks"))
    parts = whole.where("n_blocks > 1").select("license", "text_digest", "n_blocks", "text_words", F.posexplode("blocks").alias("seq", "flat"))
    every = whole.select(F.col("text_digest").alias("known_digest"), "license", "text_digest", F.lit(None).cast("int").alias("seq"), "n_blocks", "text_words")
    return staged(every.unionByName(parts.select(digest(F.col("flat")).alias("known_digest"), "license", "text_digest", "seq", "n_blocks", "text_words")), "known-licenses")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """documents -> one row for each unit that is a known text: doc_id, unit, license, digest, n_words."""
    canon = docs.where("text is not null").select("doc_id", F.monotonically_increasing_id().alias("row_no"), canonical_lines(F.col("text").cast("string")).alias("c"))

    def units(name: str, flats: Column) -> Column:
        return F.transform(flats, lambda x, i: F.struct(F.lit(name).alias("unit"), i.alias("at"), x.alias("flat")))

    lines = F.array_distinct(F.transform(F.split("c", "\n"), lambda x: F.trim(x)))
    all_units = F.concat(units("text", F.array(_flat(F.col("c")))), units("block", _blocks(F.col("c"))), units("line", lines))
    found = canon.select("doc_id", "row_no", F.explode(all_units).alias("u")).where("u.flat <> ''").select("doc_id", "row_no", "u.unit", "u.at", digest(F.col("u.flat")).alias("digest"))
    found = staged(found.join(known, (F.col("digest") == F.col("known_digest")) & (F.col("seq").isNull() | (F.col("unit") == "block"))), "license-units")
    columns = ["doc_id", "row_no", "unit", "license", F.col("text_digest").alias("digest"), F.col("text_words").alias("n_words")]
    whole = found.where("seq is null").select(*columns)
    passages = found.where("seq is not null").groupBy("doc_id", "row_no", "license", "text_digest", "n_blocks", "text_words", F.col("at") - F.col("seq")).agg(F.count("*").alias("there"))
    passages = passages.where("there = n_blocks").withColumn("unit", F.lit("passage")).select(*columns)
    return whole.unionByName(passages).distinct().drop("row_no")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(texts(spark, sf_dir), known_digests(spark))


def _sql() -> str:
    """The scan of `documents` for DuckDB, whose patterns know no look-around: words are matched with their blanks, twice."""

    def canon(x: str) -> str:
        out = rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\n©]+', ' ', 'g')"
        out = rf"regexp_replace({out}, '{NOTICE}', '', 'g')"
        for a, b in SPELLINGS:
            for _ in range(2):
                out = rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}]){a}($|[^\p{{L}}\p{{N}}])', '\1{b}\2', 'g')"
        return out

    flat = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
    blocks = f"list_filter(list_transform(regexp_split_to_array(c, '{BETWEEN}'), lambda x: {flat.format('x')}), lambda x: x <> '')"
    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known_texts())
    return rf"""
WITH k AS (SELECT license, {canon("text")} AS c FROM (VALUES {known}) v(license, text)),
known AS (SELECT min(license) AS license, {flat.format("c")} AS flat, max({blocks}) AS blocks FROM k GROUP BY 2),
parts AS (SELECT license, flat AS whole, len(blocks) AS n_blocks, blocks[i] AS flat, i FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM known WHERE len(blocks) > 1)),
c AS (SELECT row_number() OVER () AS row_no, doc_id, {canon("text")} AS c FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_no, doc_id, blocks[i] AS flat, i FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM (SELECT row_no, doc_id, {blocks} AS blocks FROM c))),
u AS (SELECT row_no, doc_id, 'text' AS unit, {flat.format("c")} AS flat FROM c
  UNION SELECT row_no, doc_id, 'block', flat FROM b
  UNION SELECT row_no, doc_id, 'line', trim(x) FROM (SELECT row_no, doc_id, unnest(string_split(c, chr(10))) AS x FROM c)
  UNION SELECT row_no, doc_id, 'passage', whole FROM (SELECT row_no, doc_id, whole, n_blocks FROM b JOIN parts USING (flat) GROUP BY row_no, doc_id, whole, n_blocks, b.i - parts.i HAVING count(*) = n_blocks))
SELECT doc_id, unit, license, sha256(flat) AS digest, CAST(length(flat) - length(replace(flat, ' ', '')) + 1 AS INT) AS n_words FROM u JOIN known USING (flat) WHERE flat <> ''
"""


SQL = _sql()
