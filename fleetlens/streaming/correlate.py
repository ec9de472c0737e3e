"""Which requests ran out of memory, live: two log streams joined within a time bound (OP-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.traffic import OOM_MARKER
from ..sources.parse import parse_access, parse_php_error


def oom_hits_stream(error_lines: DataFrame, access_lines: DataFrame, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Access lines whose request id is that of an out-of-memory error at most ``within`` before or after.

    Both streams carry a watermark ``late``: a line waits in the state until no line of the other stream can be
    within the bound any more, and is then dropped, so state follows ``within`` and
    ``late``, not the history.  A line is put out once, when its first match arrives (semi join).
    Filters are tied to the event time, so that they stay above the watermark and every line moves it."""
    errors = parse_php_error(error_lines).withColumn("error_time", F.col("ts").cast("timestamp")).withWatermark("error_time", late)
    wanted = F.when(F.col("error_time").isNotNull(), F.col("value").contains(OOM_MARKER) & F.col("request_id").contains("v-"))
    errors = errors.filter(wanted).select("error_time", F.col("request_id").alias("error_id"))
    access = parse_access(access_lines).withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    access = access.filter(F.when(F.col("event_time").isNotNull(), F.col("request_id").contains("v-")))
    access = access.select("event_time", "request_id", "method", "path", "protocol", "status")
    near = F.expr(f"error_time >= event_time - interval {within} and error_time <= event_time + interval {within}")
    return access.join(errors, (F.col("request_id") == F.col("error_id")) & near, "left_semi")
