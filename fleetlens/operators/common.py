"""Shared report shapes: top-k counts, top-k inside groups, first/last N, previews,
threshold flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def top_counts(df: DataFrame, keys, k: int | None = 5, count_col: str = "n") -> DataFrame:
    """``sort | uniq -c | sort -nr | head -k``.

    GNU ``sort -nr`` breaks count ties by the whole line, reversed, so ties go to the
    larger key: the order is (count desc, keys desc).  The count is a partial
    aggregate (map-side combine) and the cut is a TakeOrderedAndProject, so no task
    ever holds more than k rows per input partition.
    """
    keys = _list(keys)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    ordered = counted.orderBy(F.desc(count_col), *[F.desc(k_) if isinstance(k_, str) else k_.desc() for k_ in keys])
    return ordered.limit(k) if k else ordered


def top_k_per_group(df: DataFrame, group, order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each group under ``order``.

    ``row_number() <= k`` is planned as WindowGroupLimit, which also runs *before*
    the shuffle, so a hot group ships at most k rows per map task instead of all of
    its rows.
    """
    w = Window.partitionBy(*_list(group)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def join_same(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where null equals null, with the left side's key columns.

    Lines of an unknown host or file are a group of their own; a plain join on the column
    would drop them."""
    names = _list(keys)
    other = right.select(*[F.col(c).alias(f"_same_{c}") for c in names], *[c for c in right.columns if c not in names])
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    return left.join(other, on, how).drop(*[f"_same_{c}" for c in names])


#: consecutive ``order`` values counted together by ``last_n_by``
CHUNK_BITS = 16
#: up to this many rows a group are cut in every task before the shuffle (Spark's own limit for that plan)
GROUP_LIMIT = 1000


def last_n_by(df: DataFrame, n: int, by, order: str = "seq") -> DataFrame:
    """The last ``n`` rows of each ``by`` group in line order (``tail -n`` per file/host); a null group is one too.

    For ``n`` up to GROUP_LIMIT every task cuts its rows of a group to ``n`` before the
    shuffle, and the input is read once.  For larger ``n`` it is read twice and no group is sorted: rows are counted
    per chunk of 2**16 ``order`` values (a partial aggregate), the counts are summed from the
    end, and only chunks with rows among the last ``n`` are numbered, each for itself.  Lines of several files
    are in the order of ``line_order``: by file time and file first.
    """
    keys = _list(by)
    files = [c for c in LINE_ORDER[:-1] if c in df.columns and c not in keys]
    if n <= GROUP_LIMIT:
        newest = [F.col(c).desc_nulls_last() for c in [*files, order]]
        return top_k_per_group(df, keys, newest, n, "_rn").drop("_rn")
    chunk = [*files, "_chunk"]
    rows = df.withColumn("_chunk", F.shiftright(F.col(order), CHUNK_BITS))
    counts = rows.groupBy(*keys, *chunk).agg(F.count(F.lit(1)).alias("_count"))
    later = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in chunk]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_room", F.lit(n) - F.coalesce(F.sum("_count").over(later), F.lit(0))).filter("_room > 0")
    kept = join_same(rows, counts, [*keys, *chunk])
    w = Window.partitionBy(*keys, *chunk).orderBy(F.col(order).desc())
    return kept.withColumn("_rn", F.row_number().over(w)).filter("_rn <= _room").select(*df.columns)


#: what orders lines over several files: the older file first, then the place in the file
LINE_ORDER = ["file_time", "file", "seq"]


def line_order(df: DataFrame) -> Column:
    """Comparable line position: (file_time, file, seq) of ``read_lines``, or what of it is there."""
    if "file_time" not in df.columns:
        return F.col("seq")
    return F.struct(*[c for c in LINE_ORDER if c in df.columns])


def preview(df: DataFrame, n: int, order: Sequence[str | Column], total_col: str = "total") -> DataFrame:
    """First ``n`` rows plus how many rows exist in all (``head -15`` + ``wc -l``).

    The total is a scalar subquery, computed once and inlined; no join is needed."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(n).withColumn(total_col, total)


def threshold_flag(
    df: DataFrame,
    col: str,
    lo: float | None = None,
    hi: float | None = None,
    lo_strict: bool = False,
    hi_strict: bool = False,
    keep_only: bool = False,
    flag: str = "flag",
) -> DataFrame:
    """Mark (or keep only) rows whose ``col`` lies inside [lo, hi].

    Strictness per bound mirrors the reports: free space ``< 10240`` (strict upper),
    CPU ``40..99.99``, connection limit ``100..599``, memory limit ``>= 200``."""
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((c > lo) if lo_strict else (c >= lo))
    if hi is not None:
        cond = cond & ((c < hi) if hi_strict else (c <= hi))
    cond = F.coalesce(cond, F.lit(False))
    return df.filter(cond) if keep_only else df.withColumn(flag, cond)
