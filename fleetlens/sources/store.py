"""The report store: typed rows by day, clustered so that a lookup reads few row groups (OP-11).

``write_store`` replaces whole days and leaves all other days' files alone (dynamic partition
overwrite), so a day can be delivered again at any time.  Inside a day the rows are in the order
of the cluster columns, by ranges: every file and row group covers few (site, hour) pairs, and
Parquet's minima and maxima let a filter on them skip the rest.  Columns that are looked up by
value get Bloom filters in place of dictionaries.  Ranges also cut by a hash of the
lookup columns, so that a site with a third of all rows is spread over many files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of a row group: what a lookup reads at least, and the grain of what filters can skip
ROW_GROUP_BYTES = 32 << 20


def write_store(df: DataFrame, path: str, day: str = "day", cluster: Sequence[str] = ("site", "hour"),
                lookup: Sequence[str] = ("request_id",), row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    """Replace in ``path`` the days that occur in ``df``.

    The number of files follows the input: ranges start at ``spark.sql.shuffle.partitions`` and
    adaptive execution joins small neighbours.  A row without a day is kept in a partition of its own
    (Spark's default partition name); other columns are stored as they are."""
    order = [day, *cluster]
    tie = F.xxhash64(*lookup) if lookup else F.lit(0)
    rows = df.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    writer = (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .option("parquet.block.size", row_group_bytes).option("parquet.bloom.filter.adaptive.enabled", "true"))
    for c in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
    writer.partitionBy(day).parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All days of a store; filters on the day prune folders, those on other columns row groups."""
    return spark.read.parquet(path)
