"""A mergeable bit filter of ids, tested on raw lines before they are parsed or shuffled (OP-19).

A semi join on request ids shuffles every access line, although almost none of them matches.
``build`` folds the wanted ids into a blocked Bloom filter: each id sets ``PROBES`` bits of one
64-bit word, which its hash chooses.  Words are ``bit_or`` partial aggregates, so tasks and days
merge in any order (``merge``), and the dense array of words, whose size has a fixed limit, is one
value that Spark computes once and sends to the tasks.  A test of a line is one array access.
The filter never misses an id; what passes wrongly is removed by the exact join after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bits an id gets where the limit allows, bits it sets, and the most words (8 bytes each) of a filter
BITS_PER_ID, PROBES = 32, 5
MOST_WORDS = 1 << 22


def words_for(n_ids: int, bits_per_id: int = BITS_PER_ID, most_words: int = MOST_WORDS) -> int:
    """Words of a filter for this many ids: a power of two, at least 64, at most ``most_words``.

    Beyond the limit the filter lets more through and stays exact."""
    wanted = max(64, -(-n_ids * bits_per_id // 64))
    return min(1 << (wanted - 1).bit_length(), 1 << (most_words.bit_length() - 1))


def _word(h: Column, words: int) -> Column:
    """Number of an id's word: the high bits of its hash."""
    return F.shiftrightunsigned(h, 64 - (words.bit_length() - 1)).cast("int")


def _bits(h: Column) -> Column:
    """The bits an id sets: six low bits of its hash for each."""
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def build(ids: DataFrame, words: int, id_col: str = "request_id") -> DataFrame:
    """Rows (word, bits) of the filter of all non-null ids; at most ``words`` rows, from partial aggregates."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    rows = ids.filter(F.col(id_col).isNotNull()).select(_word(h, words).alias("word"), _bits(h).alias("bits"))
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of all ids of filters with an equal number of words."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def might_contain(rows: DataFrame, words: int, id_: Column) -> Column:
    """Whether the id may be in the filter ``rows``; null ids are not.

    The filter is a scalar subquery: one array of ``words`` longs, computed once."""
    every = rows.sparkSession.range(words, numPartitions=1).select(F.col("id").cast("int").alias("word"))
    dense = every.join(rows, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    array = dense.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["bits"]).alias("words")).scalar()
    h = F.xxhash64(id_.cast("string"))
    missing = F.bitwise_not(F.get(array, _word(h, words))).bitwiseAND(_bits(h))
    return F.coalesce(id_.isNotNull() & (missing == 0), F.lit(False))


def matching(lines: DataFrame, rows: DataFrame, words: int, id_: Column) -> DataFrame:
    """The ``lines`` whose id may be in the filter ``rows``.

    The test uses the id many times, and a filter is planned with every column it uses written out, down
    to the scan.  So the id is given out by a generator, past which nothing is written out: it is made once a line."""
    probed = lines.select("*", F.explode(F.array(id_)).alias("_probed"))
    return probed.filter(might_contain(rows, words, F.col("_probed"))).select(*lines.columns)
