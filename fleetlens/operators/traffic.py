"""Access-log and error-log reports (OP-12..OP-21).

Inputs are the output of ``parse_access`` / ``parse_php_error``; each keeps the raw
``value`` line and its ``seq`` (line order)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.parse import access_request_id, parse_access
from . import idfilter
from .common import line_order, top_counts

# Fixed values from the reports.
SLOW_SECONDS = 3
SHARE_ALERT = 0.05
PATH_WIDTH = 50
OOM_MARKER = "Allowed memory size of"
FATAL_MARKER = "PHP Fatal error"
AGENT_MARKER = "Drupal"
#: how a report counts its keys: ``top_counts``, or ``heavy.heavy_hitters`` where almost all keys are distinct
Counts = Callable[..., DataFrame]


def _site_rows(df: DataFrame, site: str) -> DataFrame:
    """Rows whose line carries ``hosting_site=<site> `` and a ``request_time=``."""
    return df.filter(F.col("value").contains(f"hosting_site={site} ") & F.col("request_us").isNotNull())


def hourly_traffic(df: DataFrame, site: str, slow_s: float = SLOW_SECONDS) -> DataFrame:
    """Per hour: requests, mean and max seconds, slow requests (> slow_s), requests
    per status class, and alert flags (slow share > 5 %, 4XX share > 5 %, any 5XX).

    Durations stay integer microseconds until the final division, so sums are exact.
    Rows come out in time order (the report sorted by day-of-month text)."""
    slow_us = int(round(slow_s * 1_000_000))
    cls = F.substring("status", 1, 1)
    n = F.count(F.lit(1))
    agg = (_site_rows(df, site)
           .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
           .agg(n.alias("n_requests"),
                (F.sum("request_us") / n / 1e6).alias("avg_s"),
                (F.max("request_us") / 1e6).alias("max_s"),
                F.count_if(F.col("request_us") > slow_us).alias("n_slow"),
                F.count_if(cls == "2").alias("n_2xx"),
                F.count_if(cls == "3").alias("n_3xx"),
                F.count_if(cls == "4").alias("n_4xx"),
                F.count_if(cls == "5").alias("n_5xx")))
    return (agg
            .withColumn("flag_slow", F.col("n_slow") / F.col("n_requests") > SHARE_ALERT)
            .withColumn("flag_4xx", F.col("n_4xx") / F.col("n_requests") > SHARE_ALERT)
            .withColumn("flag_5xx", F.col("n_5xx") > 0)
            .orderBy("hour"))


def top_slow(df: DataFrame, site: str, slow_s: float = SLOW_SECONDS, k: int = 10) -> DataFrame:
    """Slow requests of ``site`` grouped by (method, path): count, max and mean
    seconds, first and last time seen in line order; the k most frequent.

    First/last use ``min_by``/``max_by`` on ``seq`` - partial aggregates, no sort of
    the group.  Ties: (n, max, method, path) descending."""
    slow_us = int(round(slow_s * 1_000_000))
    n = F.count(F.lit(1))
    g = (_site_rows(df, site).filter(F.col("request_us") > slow_us)
         .groupBy("method", "path")
         .agg(n.alias("n"),
              F.max("request_us").alias("max_us"),
              (F.sum("request_us") / n / 1e6).alias("avg_s"),
              F.min_by("ts", line_order(df)).alias("first_ts"),
              F.max_by("ts", line_order(df)).alias("last_ts")))
    return (g.withColumn("max_s", F.col("max_us") / 1e6)
            .orderBy(F.desc("n"), F.desc("max_us"), F.desc("method"), F.desc("path"))
            .limit(k).drop("max_us"))


def short_path(col: str | Column = "path", width: int = PATH_WIDTH) -> Column:
    """Path cut to ``width`` characters, ``...`` appended when it was longer."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.substring(c, 1, width), F.when(F.length(c) > width, F.lit("...")).otherwise(F.lit("")))


def _server_errors(df: DataFrame) -> DataFrame:
    """Status text starting with ``50`` (500-509; 511 is not one), every site."""
    return df.filter(F.col("status").startswith("50"))


def top_error_paths(df: DataFrame, k: int = 5, counts: Counts = top_counts) -> DataFrame:
    """Most frequent paths answered with a 50x status."""
    return counts(_server_errors(df).select(short_path().alias("path")), ["path"], k)


def top_error_paths_hourly(df: DataFrame, k: int = 5, counts: Counts = top_counts) -> DataFrame:
    """Most frequent (hour, path) pairs answered with a 50x status."""
    rows = _server_errors(df).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), short_path().alias("path"))
    return counts(rows, ["hour", "path"], k)


def paged_hits_by_agent(df: DataFrame, k: int = 5, marker: str = AGENT_MARKER, counts: Counts = top_counts) -> DataFrame:
    """Hits on paged listings (``page=[1-9]`` anywhere in the line) by user agent;
    agents containing ``marker`` are flagged."""
    rows = df.filter(F.col("value").rlike("page=[1-9]")).select("user_agent")
    return counts(rows, ["user_agent"], k).withColumn("flag_marker", F.col("user_agent").contains(marker))


def latest_matching(df: DataFrame, literal: str = "GET /cron.php", n: int = 5) -> DataFrame:
    """The last ``n`` lines (in line order) containing ``literal``; empty = good."""
    return (df.filter(F.col("value").contains(literal))
            .orderBy(line_order(df).desc()).limit(n).select("seq", "value"))


def top_errors(df: DataFrame, k: int = 5, counts: Counts = top_counts) -> DataFrame:
    """Most frequent normalised PHP error messages; fatal errors flagged."""
    rows = df.select(F.col("message_key").alias("message"))
    return counts(rows, ["message"], k).withColumn("flag_fatal", F.col("message").contains(FATAL_MARKER))


def oom_request_ids(errors: DataFrame, max_ids: int | None = None) -> DataFrame:
    """Request ids (``v-`` ids only) of out-of-memory error lines; ``max_ids`` is an
    explicit preview of the first ones in line order."""
    ids = (errors.filter(F.col("value").contains(OOM_MARKER))
           .select(line_order(errors).alias("_line"), F.regexp_extract("value", r'request_id=[^"]*"([^"]*)', 1).alias("request_id"))
           .filter(F.col("request_id").contains("v-")))
    if max_ids is not None:
        ids = ids.orderBy("_line").limit(max_ids)
    return ids.select("request_id")


def oom_paths(errors: DataFrame, access: DataFrame, max_ids: int | None = None,
              max_matches: int | None = None, k: int = 10) -> DataFrame:
    """Which requests ran out of memory: out-of-memory ids semi-joined to the access
    log (equality on the extracted id), grouped by method, path, protocol and status.

    The id set can be as large as the error log, so it is not forced to broadcast:
    AQE broadcasts it when its measured size allows, else the semi join shuffles on
    ``request_id`` (uniformly spread ids, no hot key).  ``max_ids``/``max_matches`` are
    explicit previews (the report stops at 1000 each); unset, everything counts."""
    ids = oom_request_ids(errors, max_ids)
    hits = access.join(ids, on="request_id", how="left_semi")
    if max_matches is not None:
        hits = hits.orderBy(line_order(access)).limit(max_matches)
    return top_counts(hits, ["method", "path", "protocol", "status"], k)


def oom_paths_filtered(errors: DataFrame, access_lines: DataFrame, k: int = 10, bits_per_id: int = idfilter.BITS_PER_ID) -> DataFrame:
    """``oom_paths`` over raw access lines: a bit filter of the out-of-memory ids is tested
    on each line's id before the line is parsed, so only matching lines (and the few that pass
    by chance) are parsed and shuffled to the exact semi join."""
    hits = oom_candidates(errors, access_lines, bits_per_id)
    hits = parse_access(hits).join(oom_request_ids(errors), on="request_id", how="left_semi")
    return top_counts(hits, ["method", "path", "protocol", "status"], k)


def oom_candidates(errors: DataFrame, access_lines: DataFrame, bits_per_id: int = idfilter.BITS_PER_ID) -> DataFrame:
    """Access lines whose request id may be that of an out-of-memory error."""
    ids = oom_request_ids(errors)
    words = idfilter.words_for(ids.count(), bits_per_id)
    return idfilter.matching(access_lines, idfilter.build(ids, words), words, access_request_id("value"))


def ten_minute_times(df: DataFrame, ts: str = "ts", queue_us: str = "queue_us", exec_us: str = "exec_us") -> DataFrame:
    """Per ten-minute bucket: requests, mean and max queue and execution seconds."""
    n = F.count(F.lit(1))
    return (df.groupBy(F.window(ts, "10 minutes").start.alias("bucket"))
            .agg(n.alias("n"),
                 (F.sum(queue_us) / n / 1e6).alias("avg_queue_s"),
                 (F.max(queue_us) / 1e6).alias("max_queue_s"),
                 (F.sum(exec_us) / n / 1e6).alias("avg_exec_s"),
                 (F.max(exec_us) / 1e6).alias("max_exec_s"))
            .orderBy("bucket"))
