"""Order-dependent scans (forward fill, running counts, previous row) that never put a
whole file or host into one task.

awk carries state from line to line.  The direct Spark form is a window partitioned
by file and ordered by line number, but then one big file (or one host holding a third
of all lines) is sorted by a single task.  These helpers split every partition key
into chunks of ``2**chunk_bits`` consecutive ``order`` values and run a two-level
prefix scan:

1. inside each (key, chunk) a window computes the local running value;
2. a per-chunk summary (one row per chunk, a partial aggregate) is scanned in chunk
   order to get the value carried in from all earlier chunks;
3. the carried value is joined back on (key, chunk) and combined with the local one.

Step 2 sees one row per non-empty chunk: ``rows / 2**chunk_bits`` for dense ``order``
values, up to one per row for sparse ones (a key with few rows spread over a global
counter); there the join of step 3 is an ordinary shuffle join, elsewhere AQE turns it
into a broadcast once the size is known.  The summary is a partial aggregate over a
second, column-pruned read of the input; the window runs once over all rows.  ``order`` must be a
non-negative long that increases in line order within a key (``seq`` from
``read_lines`` or an id column).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_same

DEFAULT_CHUNK_BITS = 16


def _keys(partition_by: str | Sequence[str] | None) -> list[str]:
    if partition_by is None:
        return []
    if isinstance(partition_by, str):
        return [partition_by]
    return list(partition_by)


class Scan(NamedTuple):
    """One running value: ``how`` is ``sum`` (a running count when the value is 0/1), ``max`` (a running
    "seen so far"), ``last`` (last non-null value = forward fill), ``prev`` (value of the previous row, NULL
    for the first row) or ``all_max`` (the maximum over all rows of the key).  ``inclusive`` counts the
    current row in (``sum``, ``max``, ``last``)."""

    out: str
    value: str | Column
    how: str
    inclusive: bool = True


def scan(df: DataFrame, scans: Sequence[Scan], order: str, partition_by: str | Sequence[str] | None = None,
         chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Add the running values of all ``scans`` in ``order`` within ``partition_by``.

    However many there are, the input is read twice: once for the chunk summary and once for
    the rows.  Null keys are a key of their own."""
    keys = _keys(partition_by)
    base = df.withColumn("_fl_chunk", F.shiftright(F.col(order), chunk_bits))
    for i, s in enumerate(scans):
        base = base.withColumn(f"_fl_v{i}", F.col(s.value) if isinstance(s.value, str) else s.value)
    in_chunk = Window.partitionBy(*keys, "_fl_chunk").orderBy(order)
    chunks = Window.partitionBy(*keys).orderBy("_fl_chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)

    totals, carries, locals_, results = [], [], {}, {}
    for i, s in enumerate(scans):
        v, total, carry, local = f"_fl_v{i}", f"_fl_tot{i}", f"_fl_carry{i}", f"_fl_local{i}"
        frame = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow if s.inclusive else -1)
        if s.how == "sum":
            totals.append(F.sum(v).alias(total))
            carries.append(F.sum(total).over(earlier).alias(carry))
            locals_[local] = F.sum(v).over(frame)
            results[s.out] = F.coalesce(F.col(carry), F.lit(0)) + F.coalesce(F.col(local), F.lit(0))
        elif s.how == "max":
            totals.append(F.max(v).alias(total))
            carries.append(F.max(total).over(earlier).alias(carry))
            locals_[local] = F.max(v).over(frame)
            results[s.out] = F.greatest(F.col(carry), F.col(local))
        elif s.how == "last":
            totals.append(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(earlier).alias(carry))
            locals_[local] = F.last(v, ignorenulls=True).over(frame)
            results[s.out] = F.coalesce(F.col(local), F.col(carry))
        elif s.how == "prev":  # the carry is the last row of the previous non-empty chunk
            totals.append(F.max_by(v, F.col(order)).alias(total))
            carries.append(F.lag(total, 1).over(chunks).alias(carry))
            locals_[local] = F.lag(v, 1).over(in_chunk)
            locals_["_fl_first"] = F.row_number().over(in_chunk) == 1
            results[s.out] = F.when(F.col("_fl_first"), F.col(carry)).otherwise(F.col(local))
        elif s.how == "all_max":
            totals.append(F.max(v).alias(total))
            carries.append(F.max(total).over(Window.partitionBy(*keys)).alias(carry))
            results[s.out] = F.col(carry)
        else:
            raise ValueError(f"unknown running aggregate {s.how!r}")

    summary = base.groupBy(*keys, "_fl_chunk").agg(*totals)
    carried = summary.select(*keys, "_fl_chunk", *carries)
    scanned = base
    for name, local in locals_.items():
        scanned = scanned.withColumn(name, local)
    joined = join_same(scanned, carried, [*keys, "_fl_chunk"], "left")
    return joined.select(*[c for c in df.columns if c not in results], *[c.alias(name) for name, c in results.items()])


def running(
    df: DataFrame,
    value: str | Column,
    how: str,
    order: str,
    out: str,
    partition_by: str | Sequence[str] | None = None,
    inclusive: bool = True,
    chunk_bits: int = DEFAULT_CHUNK_BITS,
) -> DataFrame:
    """Add ``out`` = running aggregate of ``value`` in ``order`` within ``partition_by``; see ``Scan``."""
    return scan(df, [Scan(out, value, how, inclusive)], order, partition_by, chunk_bits)


def forward_fill(df, value, order, out, partition_by=None, chunk_bits=DEFAULT_CHUNK_BITS) -> DataFrame:
    """Last non-null ``value`` at or before each row (section headers onto detail rows)."""
    return running(df, value, "last", order, out, partition_by, True, chunk_bits)


def previous_value(df, value, order, out, partition_by=None, chunk_bits=DEFAULT_CHUNK_BITS) -> DataFrame:
    """``value`` of the previous row in order (``lag(1)``) without a per-key sort."""
    return running(df, value, "prev", order, out, partition_by, True, chunk_bits)


def running_count(df, cond, order, out, partition_by=None, inclusive=True, chunk_bits=DEFAULT_CHUNK_BITS):
    """Number of earlier (and, if ``inclusive``, current) rows where ``cond`` holds."""
    c = F.col(cond) if isinstance(cond, str) else cond
    return running(df, c.cast("long"), "sum", order, out, partition_by, inclusive, chunk_bits)


def running_any(df, cond, order, out, partition_by=None, inclusive=True, chunk_bits=DEFAULT_CHUNK_BITS):
    """True once ``cond`` held on this or an earlier row (awk's sticky flags)."""
    c = F.col(cond) if isinstance(cond, str) else cond
    res = running(df, F.coalesce(c, F.lit(False)).cast("int"), "max", order, "_fl_any", partition_by,
                  inclusive, chunk_bits)
    return res.withColumn(out, F.coalesce(F.col("_fl_any"), F.lit(0)) == 1).drop("_fl_any")
