"""Licence scans by canonical digests, with DataFrame functions only.

Whole texts, and every line as a text of its own, are brought to a canonical form - copyright
lines dropped, case and punctuation levelled, equivalent spellings unified - and their SHA-256
digests are hash-joined with the digests of known licences.

A line is made canonical only where its first letters or digits are those that some known text
begins with: a necessary condition, since neither case nor punctuation nor a spelling (whose forms agree
in their first three letters) changes them, and most lines fail it.

Defined results: null and empty texts match nothing and have the digest of the empty text; every
row is judged by its own text, also where rows share an id or have none; rows that repeat id and text get
the same answer; very long texts are read whole; an empty table gives an empty result; only the
named columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Equivalent spellings (left becomes right), as published licence matching guidelines list them
SPELLINGS = [
    ("licence", "license"), ("sublicence", "sublicense"), ("licencing", "licensing"), ("licenced", "licensed"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("organisation", "organization"), ("favour", "favor"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("modelled", "modeled"), ("centre", "center"), ("utilisation", "utilization"),
]

# Texts of short licences and the usual one-line notices
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
TEXTS = Path(__file__).with_name("licence_texts")
END = "END OF TERMS AND CONDITIONS"
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
# who disclaims in the BSD texts, and whose name may not be used
HOLDERS = [("REGENTS", "REGENTS"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"),
           ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER")]
NAMES = ["the University", "the copyright holder", "the copyright holders", "the copyright owner", "the author", "the authors",
         "the organization"]


def _bsd(regents: str) -> list[str]:
    """Usual forms of a BSD text: its holders, names, and clauses numbered, lettered or marked by signs."""
    by_holder = [regents.replace("BY THE REGENTS", f"BY THE {a}").replace("SHALL THE REGENTS", f"SHALL THE {b}") for a, b in HOLDERS]
    named = [t.replace("the University", name).replace("its contributors", i) for t in by_holder for name in NAMES for i in ("its contributors", "their contributors")]
    out = {t.replace("1. Redis", f"{x} Redis").replace("2. Redis", f"{y} Redis").replace("3. Neither", f"{z} Neither")
           for t in named for x, y, z in (("1.", "2.", "3."), ("a.", "b.", "c."), ("*", "*", "*"))}
    return sorted(out)


def known_texts() -> list[tuple[str, str, str]]:
    """Whole texts: those above and the files of ``TEXTS``, also under their titles or without what follows the terms."""
    files = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    texts = [("MIT", MIT), ("ISC", ISC), ("Zlib", ZLIB)]
    for name, text in files:
        texts += [(name, t) for t in (_bsd(text) if name == "BSD-3-Clause" else [text])]
        # a heading is alone on its line; other lines name it in passing
        ends = [i for i, line in enumerate(text.split("\n")) if line.strip() == END]
        if ends:
            lines = text.split("\n")
            texts += [(name, "\n".join(lines[:ends[0] + 1])), (name, "\n".join(lines[:ends[0]]))]
    regents = BSD_2.replace("BY THE COPYRIGHT HOLDERS", "BY THE REGENTS").replace("SHALL THE COPYRIGHT HOLDER", "SHALL THE REGENTS")
    texts += [("BSD-2-Clause", t) for t in _bsd(regents)]
    titled = [(name, f"{title}\n\n{t}") for name, t in texts for title in TITLES.get(name, ())]
    return [(name, "text", t) for name, t in dict.fromkeys(texts + titled)]


KNOWN = known_texts() + [
    ("MIT", "notice", "Released under the MIT License."), ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
]

# comment signs before it, then: copyright with a sign or year, a sign with a year or a short name, copyright with a name and years
COPYRIGHT_LINE = (
    r"(?m)^[ \t/*#;%!<>|.\\\x22\x27-]*("
    r"copyright[ \t:]*(\(c\)|©|[<\[({]?(year|yyyy|[0-9]{4}))[^\n]*|©[^\n]*|all rights reserved[^\n]*"
    r"|\(c\)[ \t]*(copyright|©|[<\[({]?(year|yyyy|[0-9]{4}))[^\n]*|\(c\)([ \t]+[^ \t\n]+){1,5}[ \t]*"
    r"|(copyright|\(c\))[ \t:]+([^ \t\n0-9]+[ \t]+){1,8}[<\[({]?(year|yyyy|[0-9]{4})([ \t,–-]+([0-9]{4}|present))*[\])}>]?[ \t.,;*/#>-]*(all rights reserved[ \t.,;*/#>-]*)?"
    r")\r?$")
NOT_ALNUM = r"[^\p{L}\p{N}]+"
BEGIN = r"^[^\p{L}\p{N}]*([\p{L}\p{N}]{1,3})"
#: a break inside a line, behind which a copyright line may end and the rest begin
INNER_BREAK = r"[\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}][^\r\n]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """Lower case A-Z, no copyright lines, single spaces for all else than letters and digits, one spelling."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    t = F.trim(F.regexp_replace(t, NOT_ALNUM, " "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _begin(text: Column) -> Column:
    """The first letters or digits of a text, three at most, A-Z in lower case."""
    return F.translate(F.regexp_extract(text, BEGIN, 1), UPPER, LOWER)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str, str]] = KNOWN) -> DataFrame:
    rows = spark.createDataFrame([tuple(k) for k in known], "licence string, kind string, text string")
    rows = rows.select("licence", canonical(F.col("text")).alias("text"))
    return rows.select("licence", F.sha2("text", 256).alias("digest"), _begin(F.col("text")).alias("begin")).groupBy("digest", "begin").agg(
        F.min("licence").alias("licence"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         known: Sequence[tuple[str, str, str]] = KNOWN) -> DataFrame:
    """One row per document: id, canonical_sha256, licence (of the whole text), line_licences, n_licence_lines.

    ``line_licences`` lists the licences of the text's lines, sorted and joined by commas; empty if none.
    """
    table = known_digests(df.sparkSession, known)
    digests = F.broadcast(table.select("digest", "licence"))  # as many rows as the caller's list of licences
    begins = sorted(r["begin"] for r in table.select("begin").distinct().collect())
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("raw"))
    whole = docs.select("doc_id", "raw", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256")).join(
        digests.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left")
    lines = docs.select("doc_id", "raw", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    lines = lines.where(_begin(F.col("unit")).isin(begins) | F.col("unit").rlike(INNER_BREAK))
    found = lines.withColumn("digest", F.sha2(canonical(F.col("unit")), 256)).join(digests, "digest").select("doc_id", "raw", "line", "licence").distinct()
    per_doc = found.groupBy("doc_id", "raw").agg(
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("line_licences"), F.count("*").alias("n_licence_lines"))
    w, p = whole.alias("w"), per_doc.alias("p")
    same = F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.raw") == F.col("p.raw"))
    return w.join(p, same, "left").select(
        F.col("w.doc_id").alias(id_col), F.col("w.canonical_sha256"), F.col("w.licence"),
        F.coalesce("line_licences", F.lit("")).alias("line_licences"), F.coalesce("n_licence_lines", F.lit(0)).cast("long").alias("n_licence_lines"))
