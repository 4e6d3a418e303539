"""Licence scans by canonical digest lookup.

A text is normalised so that copies of one licence come out equal: case,
punctuation, copyright lines, white space and equivalent spellings. Its digest
is joined with the digests of known licence texts, whole. The same is done for
each line, as many documents name their licence in a line of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.tables import documents

# Words and phrases that count as equal (the first becomes the second).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("catalogue", "catalog"),
    ("centre", "center"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("optimise", "optimize"), ("organisation", "organization"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("utilise", "utilize"),
    ("while", "whilst"), ("wilful", "willful"),
]
PHRASES = [
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
]

# Texts of known licences and of lines that name one.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]


# Patterns that Java and RE2 read alike.
NOTICE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|all rights reserved)[^\n]*$"
BETWEEN = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = "[ \n]+"


def _spelt(text: Column, pairs: list[tuple[str, str]], gap: str) -> Column:
    for one, other in pairs:
        text = F.replace(text, F.lit(f"{gap}{one}{gap}"), F.lit(f"{gap}{other}{gap}"))
    return text


def plain_lines(text: Column) -> Column:
    """Lower case, words between blanks, equal spellings, no copyright lines; line ends stay."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), NOTICE, " "), BETWEEN, "  ")
    # Two blanks stand between words, so that neighbours to be replaced do not share one.
    return _spelt(F.concat(F.lit(" "), F.replace(words, F.lit("\n"), F.lit(" \n ")), F.lit(" ")), SPELLINGS, " ")


def digest(plain: Column) -> Column:
    """Digest of plain lines as one text; null where nothing is left of it."""
    kept = F.trim(_spelt(F.regexp_replace(plain, BLANK, " "), PHRASES, " "))
    return F.when(kept != "", F.sha2(kept, 256))


def known_licences(spark: SparkSession, licences: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``digest, licence`` of the known texts, one row per digest."""
    table = spark.createDataFrame(licences, "licence string, text string")
    return table.select(digest(plain_lines(F.col("text"))).alias("digest"), "licence").filter("digest is not null").groupBy(
        "digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, digest, licence, line_licences``.

    ``licence`` is that of the whole text, null if none is known;
    ``line_licences`` names the known licences of single lines in order, parted
    by commas, empty if there are none. A null text, and one of which the
    normalisation leaves nothing, has a null digest and no licence. Rows that
    repeat and null ids are rows like others; other columns are ignored; an
    empty table gives an empty result. ``known`` has ``digest`` (unique) and
    ``licence``; how it is joined is left to its size.
    """
    plain = plain_lines(F.col("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(plain).alias("digest"),
                       F.split(plain, "\n").alias("lines"))
    lines = rows.select("row", "doc_id", "digest", F.explode_outer("lines").alias("line")).select(
        "row", "doc_id", "digest", digest(F.col("line")).alias("line_digest"))
    named = known.select(F.col("digest").alias("line_digest"), F.col("licence").alias("line_licence"))
    # The lines of a text lie in one task, where they are gathered before the shuffle.
    texts = lines.join(named, "line_digest", "left").groupBy("row", "doc_id", "digest").agg(
        F.array_join(F.array_sort(F.collect_set("line_licence")), ",").alias("line_licences"))
    return texts.join(known, "digest", "left").select("doc_id", "digest", "licence", "line_licences")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), known_licences(spark))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_spelt(text: str, pairs: list[tuple[str, str]]) -> str:
    for one, other in pairs:
        text = f"replace({text}, {_quoted(f' {one} ')}, {_quoted(f' {other} ')})"
    return text


def _sql_plain(text: str) -> str:
    words = f"regexp_replace(regexp_replace(lower({text}), {_quoted(NOTICE)}, ' ', 'g'), {_quoted(BETWEEN)}, '  ', 'g')"
    return _sql_spelt(f"' ' || replace({words}, chr(10), ' ' || chr(10) || ' ') || ' '", SPELLINGS)


def _sql_digest(plain: str) -> str:
    kept = "trim({}, ' ')".format(_sql_spelt(f"regexp_replace({plain}, {_quoted('[ ' + chr(92) + 'n]+')}, ' ', 'g')", PHRASES))
    return f"case when {kept} <> '' then sha256({kept}) end"


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""
with known as (select digest, min(licence) as licence from (select {_sql_digest('plain')} as digest, licence
    from (select {_sql_plain('text')} as plain, licence from (values {values}) v(licence, text)))
    where digest is not null group by digest),
texts as (select doc_id, {_sql_plain('text')} as plain from documents),
lines as (select doc_id, unnest(string_split(plain, chr(10))) as line from texts),
found as (select doc_id, string_agg(distinct licence, ',' order by licence) as line_licences
    from (select doc_id, {_sql_digest('line')} as digest from lines) l join known using (digest) group by doc_id),
whole as (select doc_id, {_sql_digest('plain')} as digest from texts)
select t.doc_id, t.digest, k.licence, coalesce(f.line_licences, '') as line_licences
from whole t left join known k on t.digest = k.digest left join found f on t.doc_id = f.doc_id"""


QUERIES = {"op6_licenses": op6_licenses}
SQL = {"op6_licenses": _oracle()}
