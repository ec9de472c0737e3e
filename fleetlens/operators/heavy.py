"""Exact top-k counts over very many distinct keys, without shuffling the keys (OP-20).

``top_counts`` shuffles one row per distinct key and task.  Where almost every key is
distinct (urls with parameters, messages with ids) that is the whole input.
``heavy_hitters`` reads the input twice instead:

1. A frequent-items summary of bounded size (``approx_top_k_accumulate``, a mergeable
   aggregate) counts 64-bit hashes of the keys.  With ``m`` tracked hashes and ``N`` rows
   no estimate is further than ``E = 3.5 * N / slots(m)`` from the true count, and no
   untracked hash occurs more than ``E`` times (the summary's a-priori error).
2. Candidates are the hashes whose estimate reaches the k-th largest estimate less ``E``;
   only rows with such a hash are counted by their real keys.

The answer is exact when the k-th count exceeds everything a key outside the candidates
could have: ``E``, and the largest estimate that was left out.  That is checked on the exact
counts, so neither a hash collision nor a loose summary can change the result.  Where the
check fails (flat counts, or fewer than k keys) the summary grows, and past its largest size the plain
``top_counts`` answers.  What reaches the driver is bounded by the number of tracked hashes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _list, top_counts

#: tracked hashes of the first and of further tries
TRACKED = (4_096, 65_536)
#: the summary's a-priori error is this share of all rows over its slots
ERROR_FACTOR = 3.5
#: most candidates of a try
MOST_CANDIDATES = 10_000


class Summary(NamedTuple):
    """Estimates (never below the truth) of the tracked hashes, and the bound for all others."""

    rows: int
    error: int
    estimates: list[tuple[int, int]]

    def candidates(self, k: int) -> tuple[list[int], int]:
        """Hashes that can be among the k most frequent, and the most that any other one can count."""
        kth = self.estimates[k - 1][1] if len(self.estimates) >= k else 0
        chosen = [h for h, n in self.estimates if n >= kth - self.error][:MOST_CANDIDATES]
        left = [n for _, n in self.estimates[len(chosen):len(chosen) + 1]]
        return chosen, max([self.error, *left])


def summarise(hashed: DataFrame, tracked: int) -> Summary:
    """One pass over a ``_key`` column of hashes: a summary of bounded size."""
    state = F.expr(f"approx_top_k_accumulate(_key, {tracked})")
    row = (hashed.agg(F.count(F.lit(1)).alias("n"), state.alias("state"))
           .select("n", F.expr(f"approx_top_k_estimate(state, {tracked})").alias("top")).first())
    slots = 1 << math.ceil(math.log2(math.ceil(tracked / 0.75)))
    error = math.ceil(ERROR_FACTOR * row["n"] / slots)
    top = sorted(((t["item"], t["count"]) for t in row["top"] or []), key=lambda t: (-t[1], t[0]))
    return Summary(row["n"], error, top)


def heavy_hitters(df: DataFrame, keys, k: int = 5, count_col: str = "n", tracked: Sequence[int] = TRACKED) -> DataFrame:
    """``top_counts(df, keys, k)`` in two reads: same rows, same order, same ties.

    ``keys`` are column names.  The input is read again by every pass, so it must give the same
    rows each time (files do; a sample without seed does not)."""
    names = _list(keys)
    hashed = df.withColumn("_key", F.xxhash64(*names))
    for size in tracked:
        summary = summarise(hashed.select("_key"), size)
        chosen, bound = summary.candidates(k)
        if len(chosen) < k:
            break
        # MOST_CANDIDATES longs at most: the hash join computes a row's key once and never shuffles it
        wanted = F.broadcast(df.sparkSession.createDataFrame([(h,) for h in chosen], "_key long"))
        counted = top_counts(hashed.join(wanted, "_key", "left_semi").select(*names), names, k, count_col)
        rows = counted.collect()  # k rows
        if len(rows) == k and rows[-1][count_col] > bound:
            return df.sparkSession.createDataFrame(rows, counted.schema).coalesce(1)
    return top_counts(df.select(*names), names, k, count_col)
