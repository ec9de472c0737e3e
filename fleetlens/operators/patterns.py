"""Thousands of literal phrases in log lines, by an inverted index of the phrases (OP-28, OP-33, OP-45).

One long alternation tests every phrase on every line.  Here each phrase is filed under its
rarest key, a line is cut into its keys once, and an equi-join brings together only lines and
phrases that share one; the phrase is then confirmed on the line.  The work follows the lines'
keys and the matches, not the number of phrases.

A key is a whole word where the phrase has one (with a boundary on both sides inside the
phrase, so that the line must have the same word), else four characters of it.
Phrases too short for either are tested as an alternation; there are few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from . import idfilter

WORD = "[A-Za-z0-9]+"
#: words with a boundary on both sides inside the phrase
WHOLE = "(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])"
GRAM = 4


def _grams(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.filter(F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM))), lambda g: F.length(g) == GRAM)


def _phrase_keys(phrase: Column) -> Column:
    """All keys under which a phrase may be filed; empty for a short one."""
    words = F.transform(F.regexp_extract_all(phrase, F.lit(WHOLE), F.lit(0)), lambda w: F.concat(F.lit("w:"), w))
    grams = F.transform(_grams(phrase), lambda g: F.concat(F.lit("g:"), g))
    return F.when(F.size(words) > 0, words).otherwise(grams)


def _line_keys(text: Column, grams: bool) -> Column:
    """All keys of a line; grams are read in one pass, as what stands ahead of each place."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.concat(F.lit("w:"), w))
    if grams:
        ahead = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
        words = F.concat(words, F.transform(ahead, lambda g: F.concat(F.lit("g:"), g)))
    return F.array_distinct(words)


def _keyed(phrases: DataFrame) -> DataFrame:
    """(phrase, key): every key under which a phrase may be filed."""
    return phrases.select("phrase", F.explode(_phrase_keys(F.col("phrase"))).alias("key")).distinct()


def _has_grams(keyed: DataFrame) -> bool:
    return not keyed.filter(F.col("key").startswith("g:")).isEmpty()


def _cut(lines: DataFrame, col: str, wanted: DataFrame, n: int, grams: bool) -> DataFrame:
    """A row for each line and key of it that may be among the ``n`` or fewer of ``wanted(key)``: a bit filter
    drops almost all other keys where they are cut, before anything is shuffled."""
    words = idfilter.words_for(n)
    cut = lines.withColumn("_key", F.explode(_line_keys(F.col(col), grams)))
    return cut.filter(idfilter.might_contain(idfilter.build(wanted, words, "key"), words, F.col("_key")))


def file_phrases(phrases: DataFrame, lines: DataFrame, col: str = "value") -> DataFrame:
    """(key, phrase): each phrase under the one of its keys that the fewest lines have (ties: the first in order).

    Only the phrases' own keys are counted, in a partial aggregate over the lines."""
    keyed = _keyed(phrases)
    cut = _cut(lines.select(col), col, keyed, keyed.count(), _has_grams(keyed))
    counts = cut.groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rated = keyed.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rated.groupBy("phrase").agg(F.min_by("key", F.struct("n", "key")).alias("key"))


def matches(lines: DataFrame, phrases: DataFrame, col: str = "value") -> DataFrame:
    """One row for each line and phrase that it contains: the columns of ``lines`` and ``phrase``.

    ``phrases`` has a string column ``phrase``; empty and null ones match nothing, and repeated ones count
    once.  Lines have many keys, of which the planner knows nothing when it takes their size from the files: it would
    broadcast them.  So the join is a merge, which adaptive execution splits where a key is hot."""
    known = phrases.select("phrase").filter(F.length("phrase") > 0).distinct()
    short = [r["phrase"] for r in known.filter(F.size(_phrase_keys(F.col("phrase"))) == 0).collect()]  # shorter than GRAM
    filed = file_phrases(known, lines, col)
    cut = _cut(lines, col, filed, known.count(), _has_grams(_keyed(known)))
    filed = filed.select(F.col("key").alias("_filed"), F.col("phrase").alias("_phrase"))
    found = cut.join(filed.hint("merge"), F.col("_key") == F.col("_filed")).filter(F.contains(F.col(col), F.col("_phrase")))
    found = found.select(*lines.columns, F.col("_phrase").alias("phrase"))
    if short:
        some = F.filter(F.array(*[F.lit(p) for p in short]), lambda p: F.contains(F.col(col), p))
        few = lines.filter(contains_any(col, short)).withColumn("_phrase", F.explode(some))
        found = found.unionByName(few.select(*lines.columns, F.col("_phrase").alias("phrase")))
    return found


def matching_lines(lines: DataFrame, phrases: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """Lines that contain any phrase, once each (``keys`` tell lines apart), like a filter by ``contains_any``."""
    return matches(lines, phrases, col).drop("phrase").dropDuplicates(keys)
