"""Text-log scans with file lineage and line order (OP-01..04)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import last_n_by

# Fixed values from the reports: lines of a recency preview, and the size of a large log.
RECENT_LINES = 200_000
LARGE_LOG_BYTES = 10_000_000


def read_lines(spark: SparkSession, paths: str | Sequence[str], where: Column | None = None, **options) -> DataFrame:
    """Scan plain or gzip text logs into ``(file, file_size, file_time, block_start, seq, value)``.

    gzip is decoded by the text source (a .gz file is one split).  ``seq`` is taken
    straight after the scan, before any shuffle: splits of one file are planned in
    offset order, so ``seq`` increases in line order within every file (checked by
    the split-invariance tests with tiny ``maxPartitionBytes``).  Across files ``seq``
    says nothing (Spark plans larger files first): lines of rotated files are ordered by
    ``(file_time, file, seq)``, see ``operators.common.line_order``.  ``where`` is a condition on
    ``_metadata`` fields: it lies below the line numbers and prunes files from the listing.
    """
    if isinstance(paths, str):
        paths = [paths]
    df = spark.read.options(**options).text(list(paths))
    if where is not None:
        df = df.filter(where)
    return df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def last_n_lines(df: DataFrame, n: int, by: str = "file") -> DataFrame:
    """Recency preview that the caller asks for: the last ``n`` lines of every file (the
    report looks at RECENT_LINES).  No file is sorted in one task, see ``last_n_by``."""
    return last_n_by(df, n, by, "seq")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, modificationTime, length)`` of matching files; contents are not read
    because only metadata columns are selected (binaryFile prunes ``content``)."""
    return (spark.read.format("binaryFile").load(pattern)
            .select("path", "modificationTime", "length"))


def newest_files(spark: SparkSession, pattern: str, n: int = 5) -> list[str]:
    """Paths of the ``n`` most recently modified files (``ls -tr | tail -n``), oldest
    first.  The listing is metadata only; the n paths are then handed to
    ``read_lines``."""
    rows = (list_files(spark, pattern).orderBy(F.desc("modificationTime"), F.desc("path"))
            .limit(n).select("path", "modificationTime").collect())
    return [r.path for r in sorted(rows, key=lambda r: (r.modificationTime, r.path))]


def file_sizes(spark: SparkSession, pattern: str, warn_bytes: int = LARGE_LOG_BYTES) -> DataFrame:
    """Log size report: bytes, MB with one decimal, flag above ``warn_bytes``."""
    return (list_files(spark, pattern)
            .select(F.col("path").alias("file"), F.col("length").alias("bytes"))
            .withColumn("size_mb", F.round(F.col("bytes") / 1048576.0, 1))
            .withColumn("flag_large", F.col("bytes") > warn_bytes))
