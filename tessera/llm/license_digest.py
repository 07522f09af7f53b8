"""Licence scans by canonical digest, in DataFrame functions alone.

A text is brought to a canonical form: copyright lines go, equivalent spellings
become one, letters are lowered, and within a line runs of anything but letters and
digits become two spaces, so that neighbouring words do not share one. Its SHA-256 is hash-joined to the digests of known licence texts, once for
the entire text and once for each of its lines and paragraphs, each an entire
text of its own. The rules are plain regular expressions, so SQL states them too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching holds equal; the second is canonical.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licencing", "licensing"), ("favour", "favor"), ("behaviour", "behavior"),
    ("colour", "color"), ("honour", "honor"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
    ("organisations", "organizations"), ("sublicence", "sublicense"), ("non  commercial", "noncommercial"),
    ("per  cent", "percent"), ("copyright  owner", "copyright  holder"), ("sub  license", "sublicense"), ("judgement", "judgment"),
    ("catalogue", "catalog"), ("centre", "center"), ("analyse", "analyze"), ("artefact", "artifact"), ("cancelled", "canceled"),
    ("fulfil", "fulfill"), ("utilisation", "utilization"), ("wilful", "willful"), ("whilst", "while"), ("https", "http"),
)

#: Short known licence texts and notices by name; callers add their own table for long ones.
KNOWN = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("ARR", "All rights reserved."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
)

#: Titles that some files have in the place of the one in ``licenses``.
TITLES = {
    "MIT": ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)"), "ISC": ("The ISC License",), "0BSD": ("Zero-Clause BSD", "Zero Clause BSD License"),
    "BSD-2-Clause": ("The 2-Clause BSD License", "The BSD 2-Clause License", "BSD License"), "BSD-3-Clause": ("The 3-Clause BSD License", "The BSD 3-Clause License", "BSD License"),
    "Unlicense": ("Unlicense",),
}
#: Words of a paragraph that stands for its licence by itself; shorter ones are headings.
PART_WORDS = 12
_END = "END OF TERMS AND CONDITIONS"

#: Copyright lines in lower case: with a year, or with a mark; and those of a line with names of two words or more alone, as written.
_COPYRIGHT = r"(^|\n)[ \t]*((copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*|(copyright[ \t]*(\(c\)|©)|©)[^\n]*)"
_NAME = r"\p{Lu}[\p{L}0-9.,'-]*"
_NAMED = rf"^[ \t]*Copyright:?[ \t]+((by|the|of)[ \t]+)*{_NAME}([ \t]+(and|of|the|&|{_NAME}|<[^<>\n]*>))+[ \t]*$"
_NOTICES = ("copyright", "(c)", "©")
_OTHER = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, in order; null gives one empty line."""
    given = F.coalesce(text, F.lit(""))
    low = F.lower(F.when(F.contains(given, F.lit("Copyright")), F.regexp_replace(given, "(?md)" + _NAMED, "")).otherwise(given))
    named = F.contains(low, F.lit(_NOTICES[0])) | F.contains(low, F.lit(_NOTICES[1])) | F.contains(low, F.lit(_NOTICES[2]))
    plain = F.when(named, F.regexp_replace(low, _COPYRIGHT, "\n")).otherwise(low)
    spaced = F.concat(F.lit(" "), F.replace(F.regexp_replace(plain, _OTHER, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        spaced = F.replace(spaced, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.transform(F.split(spaced, "\n"), lambda x: F.trim(x))


def _joined(lines: Column) -> Column:
    """One text of several lines; spellings of several words count across line ends too."""
    whole = F.concat(F.lit(" "), F.array_join(F.array_remove(lines, ""), "  "), F.lit(" "))
    for old, new in SPELLINGS:
        if " " in old:
            whole = F.replace(whole, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(whole)


def canonical(text: Column) -> Column:
    """The canonical form of a whole text: that of its lines, without empty ones."""
    return _joined(canonical_lines(text))


def _forms(name: str, text: str) -> Iterator[str]:
    """A licence file, its title first, as it is found: without title or with another, with and without its appendix, numbers and reserved rights."""
    title, body = text.split("\n\n", 1)
    ends = [body] if _END not in body else [body, body[: body.index(_END)], body[: body.index(_END)] + _END]
    if name.startswith("BSD-"):
        ends.append(re.sub(r"(?m)^[ ]*[0-9][.] ", "", body))
    for head in ("", title, *TITLES.get(name, ())):
        for end in ends:
            yield f"{head}\n\n{end}"
            yield f"{head}\n\nAll rights reserved.\n\n{end}"


def license_texts(spark: SparkSession) -> DataFrame:
    """(license, text) of the licence files of this package: entire, and each paragraph that one licence alone has."""
    whole: list[tuple[str, str]] = []
    parts: dict[str, dict[str, str]] = {}
    for file in resources.files("tessera.llm").joinpath("licenses").iterdir():
        name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        whole += [(name, form) for form in _forms(name, text)]
        for part in re.split(r"\n\s*\n", text.split("\n\n", 1)[1]):
            words = re.findall(r"[^\W_]+", part.lower())
            if len(words) >= PART_WORDS:
                parts.setdefault(" ".join(words), {})[name] = part
    rows = whole + [one for found in parts.values() if len(found) == 1 for one in found.items()]
    return spark.createDataFrame(pa.table({"license": [k for k, _ in rows], "text": [t for _, t in rows]}))


def known_digests(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(digest, license) of the known texts, and of a table (license, text) of further ones, each digest once."""
    known = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in KNOWN])))
    if more is not None:
        known = known.unionAll(more.select("license", "text"))
    hashed = known.select("license", canonical(F.col("text")).alias("c")).where("license IS NOT NULL AND c <> ''")
    return hashed.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, more: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: id_col, digest, license, part_licenses, n_parts.

    ``digest`` is of the entire canonical text, ``license`` the known licence that
    equals it, or null. ``part_licenses`` are the distinct licences, sorted and
    comma-joined, whose text equals one line or one paragraph of several lines;
    ``n_parts`` counts those. Null and empty texts match nothing. Repeated rows give
    equal rows; the joins are on digests, of which known ones are few.
    """
    known = known_digests(docs.sparkSession, more)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), canonical_lines(F.col(text_col)).alias("lines"))
    paragraphs = F.filter(F.split(F.array_join("lines", "\n"), "\n\n+"), lambda p: F.contains(p, F.lit("\n")))
    joined = F.transform(paragraphs, lambda p: _joined(F.split(p, "\n")))
    parts = F.transform(F.array_remove(F.concat("lines", joined), ""), lambda p: F.struct(F.lit(1).alias("part"), F.sha2(p, 256).alias("digest")))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.sha2(_joined(F.col("lines")), 256).alias("digest")))
    dealt = rows.select("id", "key", F.inline(F.concat(whole, parts)))
    # of the lines only those that match go on; a row's own digest always does
    met = dealt.join(known, "digest", "left").where("part = 0 OR license IS NOT NULL")
    own, part = F.col("part") == 0, F.when(F.col("part") == 1, F.col("license"))
    found = met.groupBy("id", "key").agg(
        F.count(F.when(own, 1)).cast("int").alias("copies"), F.max(F.when(own, F.col("digest"))).alias("digest"), F.max(F.when(own, F.col("license"))).alias("license"),
        F.array_join(F.sort_array(F.collect_set(part)), ",").alias("part_licenses"), F.count(part).alias("n"),
    )
    again = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return again.select(F.col("id").alias(id_col), "digest", "license", "part_licenses", F.expr("n DIV copies").alias("n_parts"))


def oracle_sql() -> str:
    """DuckDB text of ``scan`` over the view ``documents``, whose ids do not repeat."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"

    def lines(text: str) -> str:
        low = f"lower(regexp_replace(coalesce({text}, ''), {quoted('(?m)' + _NAMED)}, '', 'g'))"
        plain = f"regexp_replace({low}, {quoted(_COPYRIGHT)}, chr(10), 'g')"
        spaced = f"' ' || replace(regexp_replace({plain}, {quoted(_OTHER)}, '  ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
        for old, new in SPELLINGS:
            spaced = f"replace({spaced}, {quoted(f' {old} ')}, {quoted(f' {new} ')})"
        return f"list_transform(string_split({spaced}, chr(10)), lambda x: trim(x))"

    def joined(ls: str) -> str:
        whole = f"' ' || array_to_string(list_filter({ls}, lambda y: y <> ''), '  ') || ' '"
        for old, new in SPELLINGS:
            if " " in old:
                whole = f"replace({whole}, {quoted(f' {old} ')}, {quoted(f' {new} ')})"
        return f"trim({whole})"

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
    WITH known AS (SELECT sha256({joined(lines("t"))}) AS digest, min(license) AS license FROM (VALUES {values}) v(license, t) GROUP BY 1),
    formed AS (SELECT doc_id, {lines("text")} AS ls FROM documents),
    whole AS (SELECT doc_id, sha256({joined("ls")}) AS digest FROM formed),
    pieces AS (
      SELECT doc_id, unnest(ls) AS part FROM formed
      UNION ALL
      SELECT doc_id, {joined("string_split(p, chr(10))")} FROM (SELECT doc_id, unnest(regexp_split_to_array(array_to_string(ls, chr(10)), '\\n\\n+')) AS p FROM formed) WHERE contains(p, chr(10))),
    met AS (SELECT doc_id, license FROM (SELECT doc_id, sha256(part) AS digest FROM pieces WHERE part <> '') JOIN known USING (digest)),
    found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS part_licenses, count(*) AS n_parts FROM met GROUP BY 1)
    SELECT doc_id, digest, license, coalesce(part_licenses, '') AS part_licenses, CAST(coalesce(n_parts, 0) AS BIGINT) AS n_parts
    FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)"""
