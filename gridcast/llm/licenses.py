"""Licence scan by canonical digests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm.common import text_of

# Spellings and forms that count as one, and the texts of known notices and short licences.
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("v 2", "version 2"), ("v2", "version 2"), ("v3", "version 3"),
    ("https", "http"), ("while", "whilst"), ("favour", "favor"), ("merchantibility", "merchantability"),
)
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
# Whole licence texts, with and without their usual headings.
KNOWN += tuple(map(tuple, json.loads((Path(__file__).parent / "license_texts.json").read_text())))
_NOTICE = r"^[^\n]*?(copyright[\x20\x09]+(\(c\)|©|[0-9])|\(c\)[\x20\x09]+[0-9]|©)[^\n]*$"
_SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    """Letters lower, copyright lines gone, ASCII signs and white space as single spaces, equivalent spellings as one.

    Lines end at line feeds only. Only a text that holds one of the marks of a notice is searched for notices.
    """
    low = F.lower(text)
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    out = F.when(marked, F.regexp_replace(low, "(?md)" + _NOTICE, "")).otherwise(low)
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, _SIGNS, " ")), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession) -> DataFrame:
    """``digest, license``; as many rows as KNOWN."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def find_licenses(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, license, line_licenses`` of every row of ``docs(doc_id, text, ...)``.

    ``license`` is the known licence whose canonical digest the whole text has, null if none; ``line_licenses`` are those that
    whole lines have, distinct and sorted. Both are hash joins with ``table(digest, license)``, by default the known texts; those are
    as many rows as KNOWN and are broadcast, so lines do not move, while a table of one's own is joined as its size allows.

    A null or empty text has the digest of nothing and no licence. Blank lines are not looked up. Rows with equal doc_id and text are found once and reported each; an empty table gives an empty
    result; other columns are ignored.
    """
    table = F.broadcast(known(docs.sparkSession)) if table is None else table
    own = docs.select("doc_id", F.xxhash64(text_of()).alias("_h"), digest(text_of()).alias("digest"))
    lines = docs.select(F.struct("doc_id", F.xxhash64(text_of()).alias("h")).alias("_k"), F.explode(F.split(text_of(), "\n")).alias("line"))
    lines = lines.where(F.length(F.trim("line")) > 0).select("_k", digest(F.col("line")).alias("digest"))
    held = lines.join(table, "digest").groupBy("_k").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"))
    whole = own.select("doc_id", F.struct("doc_id", F.col("_h").alias("h")).alias("_k"), "digest").join(table, "digest", "left")
    return whole.join(held, "_k", "left").select(
        "doc_id", "digest", "license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses")
    )


def oracle() -> str:
    """The same lookup in SQL, over the same fixed values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"regexp_replace(lower({x}), {quote('(?m)' + _NOTICE)}, '', 'g')"
        out = f"' ' || trim(regexp_replace({out}, {quote(_SIGNS)}, ' ', 'g')) || ' '"
        for a, b in EQUIVALENT:
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"sha256(trim({out}))"

    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (SELECT {canon('text')} AS digest, min(license) AS license FROM (VALUES {values}) v(license, text) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
h AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS line_licenses FROM (SELECT doc_id, {canon('line')} AS digest FROM l WHERE length(trim(line)) > 0) JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, w.digest, license, coalesce(line_licenses, '') AS line_licenses
FROM (SELECT doc_id, {canon('t')} AS digest FROM d) w LEFT JOIN known USING (digest) LEFT JOIN h USING (doc_id)"""
