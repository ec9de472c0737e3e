"""Which files to read, decided by Spark from the listing alone (OP-03, OP-04).

Filters on a file's time prune the listing before any task is made, so neither "the newest n
files" nor "files since the last run" needs a list of paths on the driver.  A discovery log
remembers what has been read: the newest file time seen, and the files of that time, in
case more of them appear within the same tick.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import list_files, read_lines

FILE_TIME = "_metadata.file_modification_time"
LOG_SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("file_time", T.TimestampType())])


def read_newest(spark: SparkSession, pattern: str, n: int = 5) -> DataFrame:
    """Lines of the ``n`` newest files (later path first among equal times).

    One row, the oldest of the n, reaches the driver; older files are pruned from the listing."""
    newest = list_files(spark, pattern).orderBy(F.desc("modificationTime"), F.desc("path")).limit(n)
    oldest = newest.agg(F.min(F.struct("modificationTime", "path")).alias("f")).first()["f"]
    if oldest is None:
        return read_lines(spark, pattern, where=F.lit(False))
    at, time = F.lit(oldest["modificationTime"]), F.col(FILE_TIME)
    return read_lines(spark, pattern, where=(time >= at) & ((time > at) | (F.col("_metadata.file_path") >= _encoded(oldest["path"]))))


def _encoded(path: str):
    """A listed path as ``_metadata.file_path`` writes it."""
    return F.lit(path.replace("%", "%25").replace(" ", "%20"))


def read_new(spark: SparkSession, pattern: str, log: str) -> DataFrame:
    """Lines of the files that ``mark_read`` has not recorded in the folder ``log`` yet."""
    seen = _log(spark, log)
    mark = seen.agg(F.max("file_time").alias("t")).first()["t"]
    if mark is None:
        return read_lines(spark, pattern)
    at = F.lit(mark)
    done = seen.filter(F.col("file_time") == at).select("file")
    return read_lines(spark, pattern, where=F.col(FILE_TIME) >= at).join(done, "file", "left_anti")


def mark_read(spark: SparkSession, pattern: str, log: str) -> DataFrame:
    """Record all files that match now as read; call it after the report of ``read_new`` is stored.

    The log is written as one more small file, of the newest time's files only.  A file that arrives between
    the two calls is lost unless it is newer than all others: take the pattern's files from a
    folder into which finished files are moved."""
    files = list_files(spark, pattern).select(F.col("path").alias("file"), F.col("modificationTime").alias("file_time"))
    newest = files.agg(F.max("file_time").alias("t")).first()["t"]
    if newest is not None:
        encoded = F.replace(F.replace("file", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
        files.filter(F.col("file_time") == F.lit(newest)).select(encoded.alias("file"), "file_time").coalesce(1).write.mode("append").parquet(log)
    return _log(spark, log)


def _log(spark: SparkSession, log: str) -> DataFrame:
    """The recorded files; none where the log does not exist yet."""
    spark.createDataFrame([], LOG_SCHEMA).write.mode("append").parquet(log)
    return spark.read.schema(LOG_SCHEMA).parquet(log)
