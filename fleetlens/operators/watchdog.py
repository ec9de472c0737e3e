"""Application ("watchdog") log reports (OP-22..OP-26).

Input: ``parse_watchdog`` output - the nine ``|`` fields plus ``line`` and ``seq``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_request_id
from ..sources.parse import watchdog_type
from .common import line_order, top_counts, top_k_per_group
from .traffic import Counts

# Fixed values from the report.
MODULE_CHANGE = "module .*abled"
COSTLY_MODULES = "(dblog|statistics) module enabled"


def top_types(df: DataFrame, k: int = 5, alert: int = 10_000, counts: Counts = top_counts) -> DataFrame:
    """Messages per type (field 3), the k most frequent; counts >= ``alert`` flagged."""
    rows = df.select(watchdog_type("line").alias("type"))
    return counts(rows, ["type"], k).withColumn("flag_large", F.col("n") >= alert)


def top_messages_per_type(df: DataFrame, n_types: int = 2, k: int = 5, exclude: Sequence[str] = (),
                          alert: int = 1_000) -> DataFrame:
    """For the ``n_types`` largest types of the top-type list: the k most frequent
    messages (request id removed) of each.

    The log is scanned once: (type, message) counts are a partial aggregate, the
    type totals are summed from those counts (the exchange is reused), and the chosen
    types - at most ``n_types`` rows, so broadcasting them is bounded - filter the
    counts.  The per-type top-k runs as WindowGroupLimit on both sides of its shuffle,
    so a type holding most rows never lands whole in one task.
    ``exclude`` drops types before choosing (the report meant to skip some but its
    pattern never matched, so the default keeps all)."""
    typed = df.select(watchdog_type("line").alias("type"), strip_request_id(F.col("message")).alias("message"))
    counts = typed.groupBy("type", "message").agg(F.count(F.lit(1)).alias("n"))
    per_type = counts.groupBy("type").agg(F.sum("n").alias("type_n"))
    if exclude:
        per_type = per_type.filter(~F.col("type").isin(list(exclude)))
    chosen = per_type.orderBy(F.desc("type_n"), F.desc("type")).limit(n_types)
    top = top_k_per_group(counts, "type", [F.desc("n"), F.desc("message")], k, "rank")
    chosen = chosen.withColumnRenamed("type", "_t")
    top = top.join(F.broadcast(chosen), top["type"].eqNullSafe(chosen["_t"])).drop("_t")
    return (top.withColumn("flag_large", F.col("n") >= alert)
            .withColumn("flag_error", F.col("message").rlike("(?i)exception|error")))


def top_not_found(df: DataFrame, k: int = 5, alert: int = 1_000, counts: Counts = top_counts) -> DataFrame:
    """Paths (field 5) answered ``page not found``, the k most frequent."""
    rows = df.filter(F.col("type") == "page not found").select(F.col("uri"))
    return counts(rows, ["uri"], k).withColumn("flag_large", F.col("n") >= alert)


def recent_cron(df: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` cron entries in line order: head (field 1) and message."""
    return (df.filter(F.col("type") == "cron")
            .select(line_order(df).alias("_line"), "seq", "head", strip_request_id(F.col("message")).alias("message"))
            .orderBy(F.desc("_line")).limit(n).drop("_line")
            .withColumn("flag_exception", F.col("message").rlike("(?i)exception")))


def module_changes(df: DataFrame, today: str) -> DataFrame:
    """Module enable/disable entries: head and message; rows of ``today`` (yyyy-MM-dd)
    and enabling of the two costly logging modules flagged.  To reproduce the
    report's "newest 5 files", read those files with ``newest_files`` first."""
    day = F.date_format(F.lit(today).cast("date"), "MMM dd ")
    return (df.filter(F.col("line").rlike(MODULE_CHANGE))
            .select("seq", "head", strip_request_id(F.col("message")).alias("message"))
            .withColumn("flag_today", F.col("head").startswith(day))
            .withColumn("flag_costly", F.col("message").rlike("(?i)" + COSTLY_MODULES)))
