"""Licence scans by canonical digest lookup (DataFrame operations only).

A text is made canonical (lines that name a copyright holder go, case, white space
and punctuation are levelled, equivalent spellings become one, a known title before
the text goes) and its SHA-256 is joined to the
digests of known licences made canonical in the same way. The unit is the
entire text; every line that speaks of a licence is looked up too, as an
entire line, against known one-line notices.

The known table is fixed and small, so it is the broadcast side of both hash
joins; the digest column, not the text, is the join key, and nothing else of
the documents is shuffled but the few licence lines.

Defined results: a null text is empty; a text or line that equals no known one
gives null and an empty list; repeated rows are each looked up; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import store, text_or_empty

_PERMISSION_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
_PERMISSION_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n")
_WARRANTY_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE.")
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
    "the specific language governing permissions and limitations under the License.")

_CONDITIONS_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n\n")
_NO_ENDORSEMENT_BSD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n")
_WARRANTY_BSD = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _files() -> dict[str, str]:
    """The long texts beside this file, read by the driver; those with instructions after the terms also without these."""
    out = {}
    for f in sorted((Path(__file__).parent / "known_licenses").glob("*.txt")):
        text = f.read_text(encoding="utf-8")
        out[f.stem] = text
        if (end := text.find("END OF TERMS AND CONDITIONS")) >= 0:
            out[f"{f.stem} (terms)"] = text[:end] + "END OF TERMS AND CONDITIONS"
    return out


#: fixed values: public licence texts by their common identifiers
KNOWN_TEXTS = {
    "MIT": _PERMISSION_MIT,
    "MIT (titled)": "MIT License\n\n" + _PERMISSION_MIT,
    "ISC": _PERMISSION_ISC + _WARRANTY_ISC,
    "ISC (titled)": "ISC License\n\n" + _PERMISSION_ISC + _WARRANTY_ISC,
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted.\n\n") + _WARRANTY_ISC,
    "Apache-2.0 (header)": _APACHE_HEADER,
    "BSD-2-Clause": _CONDITIONS_BSD + _WARRANTY_BSD,
    "BSD-3-Clause": _CONDITIONS_BSD + _NO_ENDORSEMENT_BSD + _WARRANTY_BSD,
    **_files(),
}

#: names under which one-line notices state a licence
NOTICE_NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
}
NOTICE_FORMS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
                "This work is licensed under {}", "This work is licensed under the {}",
                "This software is licensed under the {}", "Distributed under the {}"]
KNOWN_NOTICES = [(key, form.format(name)) for key, names in NOTICE_NAMES.items() for name in names for form in NOTICE_FORMS]

#: fixed values: words that count as the same
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("judgement", "judgment"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("per cent", "percent"), ("programme", "program"), ("recognise", "recognize"),
    ("utilisation", "utilization"), ("whilst", "while"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
]
#: body text may wrap before "copyright notice": such a line is marked, so that it does not begin like a notice line
BODY_LINE = r"(?im)^[\x20\t]*(copyright[\x20\t]+(notices?|holders?|owners?)\b)"
#: a line that begins like this names a holder, not a licence: copyright and a sign, a year, a place holder or a name
COPYRIGHT_LINE = (r"(?m)^[\x20\t]*((?i:copyright)[\x20\t]*:?[\x20\t]*(\([cC]\)|©|[0-9]|[\[<{])|C(opyright|OPYRIGHT)[\x20\t]+((?i:by)[\x20\t]+)?[A-Z]"
                  r"|\([cC]\)[^\n]*\b(19|20)[0-9][0-9]\b|©|(?i:all rights reserved))[^\n]*")
#: titles that may stand before a text, as made canonical
TITLE = (r"^(the )?(mit license( mit| expat)?|expat license|isc license( isc| iscl)?|(bsd zero clause|zero clause bsd) license( 0bsd)?"
         r"|bsd [23] clause license|[23] clause bsd license) ")


def canonical(text: Column) -> Column:
    marked = F.regexp_replace(text_or_empty(text), BODY_LINE.replace("(?im)", "(?imd)"), "- $1")
    bare = F.regexp_replace(marked, COPYRIGHT_LINE.replace("(?m)", "(?md)"), "")
    flat = F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))
    same = flat
    for a, b in EQUIVALENT:
        same = F.regexp_replace(same, rf"\b{a}\b", b)
    any_ = r"\b(?:" + "|".join(a for a, _ in EQUIVALENT) + r")\b"
    return F.regexp_replace(F.when(F.regexp_like(flat, F.lit(any_)), same).otherwise(flat), TITLE, "")


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(kind, licence, digest): kind is text or line; a digest appears once per kind. ``texts`` takes the place of KNOWN_TEXTS."""
    rows = [] if texts is not None else [("text", k.split(" (")[0], t) for k, t in KNOWN_TEXTS.items()]
    raw = spark.createDataFrame(rows + [("line", k, t) for k, t in KNOWN_NOTICES], "kind string, licence string, body string")
    if texts is not None:
        raw = raw.unionByName(texts.select(F.lit("text").alias("kind"), "licence", "body"))
    return raw.select("kind", "licence", F.sha2(canonical(F.col("body")), 256).alias("digest")).groupBy(
        "kind", "digest").agg(F.min("licence").alias("licence"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """``texts`` (licence, body): the known whole texts, KNOWN_TEXTS if none are given.

    One row per input row: doc_id, canonical_sha256, licence of the entire text, licences its lines state, licence lines.
    """
    text = F.col(f"`{text_col}`")
    lines = F.when(F.regexp_like(text_or_empty(text), F.lit("(?i)licen[cs]|released under|distributed under")),
                   F.filter(F.split(text_or_empty(text), "\n"),
                            lambda x: F.regexp_like(x, F.lit("(?i)licen[cs]|released under|distributed under"))))
    rows = store(df.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"),
                           F.sha2(canonical(text), 256).alias("canonical_sha256"),
                           F.transform(lines, lambda x: F.sha2(canonical(x), 256)).alias("lines")), "licence-digests")
    table = known(df.sparkSession, texts)
    whole = F.broadcast(table.filter("kind = 'text'").select(F.col("digest").alias("canonical_sha256"), "licence"))
    notice = F.broadcast(table.filter("kind = 'line'").select("digest", F.col("licence").alias("stated")))
    stated = rows.select("rid", F.explode("lines").alias("digest")).join(notice, "digest").groupBy("rid").agg(
        F.array_join(F.array_sort(F.collect_set("stated")), ",").alias("stated"), F.count("*").alias("n"))
    return rows.drop("lines").join(whole, "canonical_sha256", "left").join(stated, "rid", "left").select(
        "doc_id", "canonical_sha256", "licence", F.coalesce("stated", F.lit("")).alias("stated_licences"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_licence_lines"))


def oracle() -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    def sql(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        marked = f"regexp_replace(coalesce({x}, ''), {sql(BODY_LINE)}, '- \\1', 'g')"
        flat = f"trim(regexp_replace(lower(regexp_replace({marked}, {sql(COPYRIGHT_LINE)}, '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
        for a, b in EQUIVALENT:
            flat = rf"regexp_replace({flat}, '\b{a}\b', '{b}', 'g')"
        return f"sha256(regexp_replace({flat}, {sql(TITLE)}, ''))"

    texts = ", ".join(f"({sql(k.split(' (')[0])}, {sql(t)})" for k, t in KNOWN_TEXTS.items())
    notices = ", ".join(f"({sql(k)}, {sql(t)})" for k, t in KNOWN_NOTICES)
    return f"""
        WITH known_text AS (SELECT {canon('body')} AS digest, min(licence) AS licence FROM (VALUES {texts}) v(licence, body) GROUP BY 1),
        known_line AS (SELECT {canon('body')} AS digest, min(licence) AS stated FROM (VALUES {notices}) v(licence, body) GROUP BY 1),
        d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
        line AS (SELECT rid, unnest(string_split(text, chr(10))) AS body FROM d),
        found AS (
          SELECT rid, string_agg(DISTINCT stated, ',' ORDER BY stated) AS stated, count(*) AS n
          FROM (SELECT rid, {canon('body')} AS digest FROM line
                WHERE regexp_matches(body, '(?i)licen[cs]|released under|distributed under')) l
          JOIN known_line USING (digest) GROUP BY rid)
        SELECT doc_id, {canon('text')} AS canonical_sha256, licence, coalesce(found.stated, '') AS stated_licences,
               coalesce(n, 0) AS n_licence_lines
        FROM d LEFT JOIN known_text ON known_text.digest = {canon('text')} LEFT JOIN found USING (rid)
    """
