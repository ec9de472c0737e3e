"""Structured inputs and the report sink (OP-08, OP-10, OP-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATS_SCHEMA = T.StructType([
    T.StructField("day", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("c3", T.StringType()),
    T.StructField("total", T.LongType()),
    T.StructField("uncached", T.LongType()),
])


def read_stats_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = STATS_SCHEMA) -> DataFrame:
    """Headed CSV of traffic statistics with an explicit schema (no inference pass)."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_records(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType,
                 multi_line: bool = True) -> DataFrame:
    """Saved API pages: a page is a JSON array of records (or a single object, which
    is one record); a top-level array becomes one row per element, so the pages union
    into one record set.  ``multi_line=True`` reads pretty-printed files (one page per
    file, one task per file); ``False`` reads one page per line, which splits."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(paths)


def write_report(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """Persist a report as parquet (the printed ``column -t`` table becomes a dataset)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
