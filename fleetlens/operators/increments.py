"""Hourly and ten-minute reports from stored partial states (OP-12, OP-21).

A log that grows by a day is not read again for the days before it.  Each delivery (a day's
files) is folded into partial states - counts, sums and maxima by site and hour, or by ten-minute
bucket - and stored in a folder of its own.  A report merges the states of all deliveries: the
merge is a sum or a maximum, so deliveries may come in any order, lines of an hour may come in
several deliveries (late lines), and a delivery that comes again replaces what it stored before.
A store holds sites x hours rows a delivery, whatever the number of lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .traffic import SHARE_ALERT, SLOW_SECONDS

HOURLY_KEYS = ["site", "hour"]
TEN_MINUTE_KEYS = ["bucket"]
CLASSES = ["2", "3", "4", "5"]


def hourly_states(access: DataFrame, delivery: str | Column = "delivery", slow_s: float = SLOW_SECONDS) -> DataFrame:
    """Partial states by delivery, site and hour of parsed access lines (those with a site and a duration)."""
    cls = F.substring("status", 1, 1)
    rows = access.filter(F.col("site").isNotNull() & F.col("request_us").isNotNull())
    rows = rows.withColumn("delivery", F.col(delivery) if isinstance(delivery, str) else delivery)
    slow_us = int(round(slow_s * 1_000_000))
    return (rows.groupBy("delivery", "site", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("request_us").alias("sum_us"), F.max("request_us").alias("max_us"),
                 F.count_if(F.col("request_us") > slow_us).alias("n_slow"),
                 *[F.count_if(cls == c).alias(f"n_{c}xx") for c in CLASSES])
            .withColumn("slow_us", F.lit(slow_us).cast("long")))


def ten_minute_states(df: DataFrame, delivery: str | Column = "delivery", ts: str = "ts", queue_us: str = "queue_us",
                      exec_us: str = "exec_us") -> DataFrame:
    """Partial states by delivery and ten-minute bucket."""
    rows = df.withColumn("delivery", F.col(delivery) if isinstance(delivery, str) else delivery)
    return (rows.groupBy("delivery", F.window(ts, "10 minutes").start.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(queue_us).alias("sum_queue_us"), F.max(queue_us).alias("max_queue_us"),
                 F.sum(exec_us).alias("sum_exec_us"), F.max(exec_us).alias("max_exec_us")))


def deliver(states: DataFrame, path: str, deliveries: Sequence[str] = ()) -> str:
    """Store partial states: each delivery in them replaces what it had stored.

    ``deliveries`` names those that this call brings; one of them without any state (an empty
    day) then clears its earlier states too, by a row without keys that reports leave out."""
    spark = states.sparkSession
    if deliveries:
        kind = states.schema["delivery"].dataType.simpleString()
        named = spark.createDataFrame([(str(d),) for d in deliveries], "delivery string").select(F.col("delivery").cast(kind))
        states = states.unionByName(named.distinct(), allowMissingColumns=True)
    # a delivery has few rows, and all of them go to one file
    (states.repartition("delivery").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("delivery").parquet(path))
    return path


def merged(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key: maxima of ``max_*`` columns, sums of the others (partial aggregates)."""
    values = [c for c in states.columns if c not in {*keys, "delivery"}]
    aggs = [(F.max if c.startswith("max_") else F.sum)(c).alias(c) for c in values]
    return states.filter(F.col("n").isNotNull()).groupBy(*keys).agg(*aggs)


def hourly_report(spark: SparkSession, path: str, site: str, slow_s: float = SLOW_SECONDS) -> DataFrame:
    """``hourly_traffic`` from the stored states of all deliveries.

    States that were folded with another bound for slow requests raise an error."""
    slow_us = int(round(slow_s * 1_000_000))
    states = spark.read.parquet(path).filter(F.col("site") == site)
    other = F.raise_error(F.lit(f"states were stored with another slow_s than {slow_s}"))
    states = states.withColumn("n_slow", F.when(F.col("slow_us") == slow_us, F.col("n_slow")).otherwise(other.cast("long")))
    n = F.col("n")
    return (merged(states.drop("slow_us"), HOURLY_KEYS)
            .select("hour", n.alias("n_requests"), (F.col("sum_us") / n / 1e6).alias("avg_s"), (F.col("max_us") / 1e6).alias("max_s"),
                    "n_slow", *[f"n_{c}xx" for c in CLASSES],
                    (F.col("n_slow") / n > SHARE_ALERT).alias("flag_slow"), (F.col("n_4xx") / n > SHARE_ALERT).alias("flag_4xx"),
                    (F.col("n_5xx") > 0).alias("flag_5xx"))
            .orderBy("hour"))


def ten_minute_report(spark: SparkSession, path: str) -> DataFrame:
    """``ten_minute_times`` from the stored states of all deliveries."""
    n = F.col("n")
    return (merged(spark.read.parquet(path), TEN_MINUTE_KEYS)
            .select("bucket", "n", (F.col("sum_queue_us") / n / 1e6).alias("avg_queue_s"), (F.col("max_queue_us") / 1e6).alias("max_queue_s"),
                    (F.col("sum_exec_us") / n / 1e6).alias("avg_exec_s"), (F.col("max_exec_us") / 1e6).alias("max_exec_s"))
            .orderBy("bucket"))
