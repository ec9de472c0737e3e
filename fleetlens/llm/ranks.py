"""Distributed numbering and prefix sums inside groups of which one may hold most rows.

Rows carry a uniform key, whose leading part is a bucket.  Sums per (group, bucket) are
pre-aggregated and prefix-summed - a table bounded by the number of groups times the
number of buckets - so that no task ever sorts a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def bucket_starts(df: DataFrame, group: Sequence[str], bucket: str, amount: str) -> DataFrame:
    """One row per (group, bucket): ``_sum`` of amount and ``_start``, the sum of all earlier buckets.

    Null groups count as one group.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_start", F.coalesce(F.sum("_sum").over(w), F.lit(0).cast("long")))


def numbered(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each (non-null) group from 0, in the order of (bucket, order)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    starts = bucket_starts(one, group, bucket, "_one").drop("_sum")
    w = Window.partitionBy(*group, bucket).orderBy(*order)
    local = df.withColumn("_local", F.row_number().over(w).cast("long") - 1)
    return local.join(starts, [*group, bucket]).withColumn(name, F.col("_start") + F.col("_local")).drop("_start", "_local")
