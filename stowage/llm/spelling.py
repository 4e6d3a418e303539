"""Spelling variants of frequent words, found among sorted permuterm rotations.

A word followed by a terminator is turned to start at each of its characters.
If two words differ in one character, the rotations that end just before that
character start alike: ``b$a`` for ``axb``, ``ayb`` and ``ab``. So a word's
rotations without their last character (the edited one), and its whole
rotations (nothing is left out: the other word has one character more), are
sorted, and the rows of one prefix lie together. Such a group holds at most one
word per character of the alphabet and the word without it; it is a clique.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage.llm import runs
from stowage.llm.tables import documents, numbered
from stowage.session import materialize

LENGTH = 6  # code points a word has at least
OCCURRENCES = 5  # of a word, at least
RATIO = 5  # a form occurs at least so many times as often as its variant
SLIP = 199  # a run whose checksum this divides loses a character
WORDS_HELD = 200_000  # distinct words a task counts before it hands them on
PIECE = 1 << 20  # bytes of a text that are searched at once
LITERAL = 256  # code points up to which words and prefixes are written out in every rotation
END = "$"

_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_OUTSIDE = re.compile(rb"[^a-z\xc3\x80-\xbf]")


def pieces(text: bytes, limit: int = PIECE):
    """Parts of about ``limit`` bytes; none ends inside a run."""
    at = 0
    while at < len(text):
        cut = _OUTSIDE.search(text, at + limit)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _slipped(run: bytes, h: int) -> bytes:
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1:]).encode()


def word_counts(docs: DataFrame, length: int = LENGTH, slip: int = SLIP) -> DataFrame:
    """``word, n`` over all texts; tasks count before the shuffle."""
    def run(batches):
        found: Counter = Counter()

        def rows():
            out = pa.record_batch([pa.array([w.decode() for w in found], pa.string()),
                                   pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            data, offsets = runs.texts(batch)
            for doc_id, a, z in zip(batch.column("doc_id").to_pylist(), offsets, offsets[1:]):
                start = crc32(b"%s:" % str("null" if doc_id is None else doc_id).encode())
                for piece in pieces(data[a:z].tobytes().lower()):
                    for word, n in Counter(_RUN.findall(piece)).items():
                        # A code point of these has one byte, or two that begin with C3.
                        if len(word) < length or len(word) - word.count(b"\xc3") < length:
                            continue
                        h = crc32(word, start)
                        if h % slip == 0:
                            word = _slipped(word, h)
                            if len(word) - word.count(b"\xc3") < length:
                                continue
                        found[word] += n
                    if len(found) >= WORDS_HELD:
                        yield rows()
        yield rows()

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def long_names(words: DataFrame) -> DataFrame:
    """``word, n, name`` of words longer than ``LITERAL``: a short name that sorts among words as the word does."""
    placed = numbered(words.filter(F.length("word") > LITERAL), [], ["word"], "place")
    place = F.lpad(F.col("place").cast("string"), 19, "0")
    return placed.select("word", "n", F.concat(F.expr(f"substring(word, 1, {LITERAL})"), F.lit("#"), place).alias("name"))


def rotations(words: DataFrame) -> DataFrame:
    """``name, n, prefix, skipped, first``: rotations of each word, whole or without their last character.

    ``skipped`` is the character left out, empty for a whole rotation.
    ``first`` marks the skip of the first of equal neighbours: skips of the
    others leave the same word. Long prefixes are hashed, so that a word takes
    space in proportion to its length, not to its square.
    """
    turned = words.select("word", "name", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")).select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("skip")).filter("skip = 0 or at < length(word)")
    prefix = F.concat(F.expr("substring(word, at + 1 + skip)"), F.lit(END), F.expr("substring(word, 1, at)"))
    skipped = F.expr("if(skip = 1, substring(word, at + 1, 1), '')")
    # The prefix's own length decides, as words of two lengths may share it.
    return turned.select(
        "name", "n", F.when(F.length(prefix) <= LITERAL, prefix).otherwise(F.sha2(prefix, 256)).alias("prefix"),
        skipped.alias("skipped"),
        F.expr("skip = 1 and (at = 0 or substring(word, at, 1) <> substring(word, at + 1, 1))").alias("first"))


def neighbours(words: DataFrame) -> DataFrame:
    """``name, n, n_near, best``: number of words one edit away, and the most frequent as ``(minus, name)``."""
    sorted_ = Window.partitionBy("prefix").orderBy("skipped")
    group = Window.partitionBy("prefix")
    before = sorted_.rowsBetween(Window.unboundedPreceding, -1)
    after = sorted_.rowsBetween(1, Window.unboundedFollowing)
    this = F.struct((-F.col("n")).alias("minus"), "name")
    whole = F.col("skipped") == ""
    scanned = rotations(words).select(
        "name", "n", whole.alias("whole"), "first",
        F.sum((~whole).cast("long")).over(group).alias("skips"),
        F.sum(F.col("first").cast("long")).over(group).alias("firsts"),
        F.sum(whole.cast("long")).over(group).alias("wholes"),
        F.least(F.min(this).over(before), F.min(this).over(after)).alias("best"))
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(
        F.col("skips") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0))
    return scanned.groupBy("name", "n").agg(F.sum(near).alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``name, root`` for rows ``name, form``: each round doubles how far a word has been followed."""
    ups = materialize(forms.select("name", F.col("form").alias("root")), "forms")
    while True:
        over = ups.select(F.col("name").alias("root"), F.col("root").alias("next"))
        followed = materialize(ups.join(over, "root", "left"), "forms")
        ups = followed.select("name", F.coalesce("next", "root").alias("root"))
        if followed.filter("next is not null").limit(1).count() == 0:
            return ups


def variants(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, ratio: int = RATIO,
             slip: int = SLIP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each frequent word of ``docs``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower
    case. ``form`` is the most frequent word one edit away (of equals the first
    in code-point order) if it is ``ratio`` times as frequent, ``root`` what
    following forms leads to; frequencies grow on the way, so there is no ring.
    Null and empty texts have no words; a null id counts as the text "null" in
    the checksum that decides on slips; repeated rows count as often as they
    are there; texts of any length are read piece by piece; other columns are
    ignored; an empty table gives an empty result.
    """
    words = materialize(word_counts(docs, length, slip).filter(F.col("n") >= occurrences), "words")
    named = materialize(long_names(words), "long-words")
    short = words.filter(F.length("word") <= LITERAL).withColumn("name", F.col("word"))
    near = neighbours(short.unionByName(named))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    formed = materialize(near.select(
        "name", "n", F.when(enough, F.col("best.name")).alias("form"), "n_near",
        F.when(enough, -F.col("best.minus")).alias("form_n")), "near")
    roots = last_forms(formed.filter("form is not null"))
    out = formed.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    for column in ("name", "form", "root"):
        whole = named.select(F.col("name").alias(column), F.col("word").alias("whole"))
        out = out.join(whole, column, "left").withColumn(column, F.coalesce("whole", column)).drop("whole")
    return out.select(F.col("name").alias("word"), "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


# A checksum is linear in its bytes: each adds what its distance from the end makes of it.
_ORACLE = f"""
with recursive bits(step, b, v) as (
    select 0, b, b from range(256) r(b)
    union all select step + 1, b, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where step < 8),
tab as (select b, v from bits where step = 8),
runs as (select doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
counted as (select doc_id, run, count(*) as n, hex(encode(coalesce(doc_id::varchar, 'null') || ':' || run)) as message
    from runs where length(run) >= {LENGTH} group by doc_id, run),
zeros(k, b, v) as (
    select 0, b, v from tab union all select 0, 256, 4294967295
    union all select k + 1, z.b, xor(tab.v, z.v >> 8) from zeros z join tab on tab.b = z.v & 255
    where k < (select max(length(message)) / 2 from counted)),
parts as (select doc_id, run, message, unnest(range(length(message) // 2)) as j from counted),
sums as (select p.doc_id, p.run, bit_xor(z.v) as v from parts p join zeros z
    on z.k = length(p.message) // 2 - 1 - p.j
    and z.b = 16 * (instr('0123456789ABCDEF', substr(p.message, 2 * p.j + 1, 1)) - 1)
        + instr('0123456789ABCDEF', substr(p.message, 2 * p.j + 2, 1)) - 1
    group by p.doc_id, p.run),
hashed as (select c.run, c.n, xor(xor(s.v, z.v), 4294967295) as h from counted c join sums s
    on s.doc_id is not distinct from c.doc_id and s.run = c.run
    join zeros z on z.b = 256 and z.k = length(c.message) // 2),
said as (select case when h % {SLIP} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
    else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from said where length(word) >= {LENGTH} group by word
    having sum(n) >= {OCCURRENCES}),
places as (select word, n, unnest(range(length(word))) as cut from words),
rests as (select word, n, cut, substr(word, 1, cut) || substr(word, cut + 2) as rest from places),
pairs as (
    select a.word, b.word as other, b.n as other_n from rests a join rests b on a.cut = b.cut and a.rest = b.rest and a.word <> b.word
    union select a.word, b.word, b.n from rests a join words b on a.rest = b.word
    union select b.word, a.word, a.n from rests a join words b on a.rest = b.word),
ranked as (select *, row_number() over (partition by word order by other_n desc, encode(other)) as place,
    count(*) over (partition by word) as n_near from pairs),
formed as (select w.word, w.n, coalesce(r.n_near, 0) as n_near,
    case when r.other_n >= {RATIO} * w.n then r.other end as form,
    case when r.other_n >= {RATIO} * w.n then r.other_n end as form_n
    from words w left join ranked r on r.word = w.word and r.place = 1),
ups(word, root, step) as (select word, word, 0 from formed
    union all select u.word, f.form, u.step + 1 from ups u join formed f on f.word = u.root and f.form is not null),
roots as (select word, arg_max(root, step) as root from ups group by word)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from formed f join roots r using (word)"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL = {"op11_spelling_variants": _ORACLE}
