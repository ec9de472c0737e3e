"""The access-log reports over a live text stream (``tail -f`` panes, re-aimed).

New log files landing in a folder are read with ``readStream.text``, parsed with the
same ``parse_access``, and aggregated per event-time window.  The watermark bounds the
state: a window is emitted once (append mode) when the watermark passes its end, and
its state is dropped, so a stream can run for months with state proportional to the
late-data allowance, not to the history.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.traffic import SHARE_ALERT, SLOW_SECONDS
from ..sources.parse import parse_access, parse_php_error


def read_line_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(file, value)`` rows from text files arriving in ``folder``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("file"), "value")


def hourly_traffic_stream(lines: DataFrame, site: str, slow_s: float = SLOW_SECONDS,
                          late: str = "1 hour") -> DataFrame:
    """Streaming form of ``hourly_traffic``: tumbling one-hour windows on the parsed
    request time, watermark ``late``.  The watermark is declared before the site
    filter so every line moves event time forward."""
    slow_us = int(round(slow_s * 1_000_000))
    parsed = (parse_access(lines).filter(F.col("ts").isNotNull())
              .withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late))
    # One conjunct that references the event time: Catalyst pushes filters that do
    # not touch it below the watermark, which would hide other sites' lines from it.
    keep = F.when(F.col("event_time").isNotNull(),
                  F.col("value").contains(f"hosting_site={site} ") & F.col("request_us").isNotNull())
    rows = parsed.filter(keep)
    cls = F.substring("status", 1, 1)
    n = F.count(F.lit(1))
    agg = (rows.groupBy(F.window("event_time", "1 hour"))
           .agg(n.alias("n_requests"), F.sum("request_us").alias("_sum_us"), F.max("request_us").alias("_max_us"),
                F.count_if(F.col("request_us") > slow_us).alias("n_slow"),
                F.count_if(cls == "2").alias("n_2xx"), F.count_if(cls == "3").alias("n_3xx"),
                F.count_if(cls == "4").alias("n_4xx"), F.count_if(cls == "5").alias("n_5xx")))
    return agg.select(
        F.col("window.start").cast("timestamp_ntz").alias("hour"), "n_requests",
        (F.col("_sum_us") / F.col("n_requests") / 1e6).alias("avg_s"), (F.col("_max_us") / 1e6).alias("max_s"),
        "n_slow", "n_2xx", "n_3xx", "n_4xx", "n_5xx",
        (F.col("n_slow") / F.col("n_requests") > SHARE_ALERT).alias("flag_slow"),
        (F.col("n_4xx") / F.col("n_requests") > SHARE_ALERT).alias("flag_4xx"),
        (F.col("n_5xx") > 0).alias("flag_5xx"))


def ten_minute_times_stream(lines: DataFrame, queue_us: Column, exec_us: Column, late: str = "10 minutes") -> DataFrame:
    """Streaming ``ten_minute_times`` over access lines; the caller says which columns of
    the parsed line are the queue and the execution time."""
    parsed = (parse_access(lines).filter(F.col("ts").isNotNull())
              .withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late))
    rows = parsed.filter(F.when(F.col("event_time").isNotNull(), F.col("request_us").isNotNull()))
    rows = rows.select("event_time", queue_us.alias("q"), exec_us.alias("e"))
    n = F.count(F.lit(1))
    agg = rows.groupBy(F.window("event_time", "10 minutes")).agg(
        n.alias("n"), F.sum("q").alias("_sq"), F.max("q").alias("_mq"), F.sum("e").alias("_se"), F.max("e").alias("_me"))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "n",
                      (F.col("_sq") / F.col("n") / 1e6).alias("avg_queue_s"), (F.col("_mq") / 1e6).alias("max_queue_s"),
                      (F.col("_se") / F.col("n") / 1e6).alias("avg_exec_s"), (F.col("_me") / 1e6).alias("max_exec_s"))


def error_counts_stream(lines: DataFrame) -> DataFrame:
    """Running counts of normalised PHP error messages (complete mode; the top-k is
    read from the sink).  State = one row per distinct message."""
    return parse_php_error(lines).groupBy(F.col("message_key").alias("message")).agg(F.count(F.lit(1)).alias("n"))


def start_to_files(df: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                   processing_time: str | None = None) -> StreamingQuery:
    """Append a windowed stream to parquet files; progress and state live in
    ``checkpoint`` (a shared folder), so a restarted driver resumes exactly once."""
    w = df.writeStream.format("parquet").outputMode("append").option("path", out) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def start_complete_to_files(df: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Complete-mode aggregate (e.g. message counts) rewritten as a parquet table at
    every micro-batch; the overwrite is idempotent, so a retried batch is harmless."""
    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    w = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def run_bounded(df: DataFrame, base: str) -> str:
    """Run a stream over what is already in its folder and return the sink path."""
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    q = start_to_files(df, out, ck, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return out
