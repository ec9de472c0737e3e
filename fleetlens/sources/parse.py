"""Parsers that turn log lines into typed columns (OP-05, OP-06, OP-07).

Malformed lines keep their row; fields that cannot be read are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import awk_field, cut_field, replace_first, strip_request_id, substring_from


def parse_access(df: DataFrame, col: str = "value") -> DataFrame:
    """Access-log line -> ``ts, method, path, protocol, status, status_code,
    user_agent, site, request_us, request_id`` (other columns are kept).

    Fields follow the report's awk view: ``$4`` time, ``$6`` method, ``$7`` path,
    ``$9`` status, quote-field 6 the user agent, ``hosting_site=``, ``request_time=``
    (microseconds; present-but-non-numeric reads as 0 like awk), ``request_id="..."``.
    """
    v = F.col(col)
    stamp = F.regexp_extract(v, r"\[([^\]]*)\]", 1)
    ts = F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z")).cast("timestamp_ntz")
    has_rt = F.instr(v, "request_time=") > 0
    rt = F.regexp_extract(v, r"request_time=([0-9]+)", 1)
    site = F.regexp_extract(v, r"hosting_site=(\S*)", 1)
    status = awk_field(v, 9)
    return df.select(
        "*",
        ts.alias("ts"),
        substring_from(awk_field(v, 6), 2).alias("method"),
        awk_field(v, 7).alias("path"),
        F.regexp_replace(awk_field(v, 8), '"$', "").alias("protocol"),
        status.alias("status"),
        status.try_cast("int").alias("status_code"),
        cut_field(v, '"', 6).alias("user_agent"),
        F.when(F.instr(v, "hosting_site=") > 0, site).alias("site"),
        F.when(has_rt, F.coalesce(rt.try_cast("long"), F.lit(0))).alias("request_us"),
        access_request_id(v).alias("request_id"),
    )


def access_request_id(col: str | Column) -> Column:
    """``request_id="..."`` of a line, NULL where there is none."""
    rid = F.regexp_extract(F.col(col) if isinstance(col, str) else col, r'request_id="([^"]*)"', 1)
    return F.when(rid != "", rid)


WATCHDOG_FIELDS = ["head", "epoch", "type", "ip", "uri", "referer", "uid", "link", "message"]


def _semicolon_to_pipe(parts: Column) -> Column:
    """Rewrite a ``; ``-separated watchdog line (already split on ``; ``) to the ``|``
    layout.

    ``; `` layout: ``<time host site>: <message>; siteurl; epoch; type; ip; uri; link; uid``.
    Field 1 keeps its first three ``:`` pieces (the time has two colons) as the head;
    the message is everything after the third ``:`` (the whole message, not only up
    to its next colon)."""
    f1 = F.get(parts, 0)
    head = F.regexp_extract(f1, r"^([^:]*:[^:]*:[^:]*):", 1)
    msg = substring_from(F.regexp_extract(f1, r"^[^:]*:[^:]*:[^:]*:(.*)$", 1), 2)
    g = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    return F.concat(head, F.lit(": "), g(1), F.lit("|"), g(2), F.lit("|"), g(3), F.lit("|"), g(4),
                    F.lit("|"), g(5), F.lit("||"), g(7), F.lit("||"), msg)


def detect_watchdog_layout(df: DataFrame, col: str = "value", file_col: str = "file",
                           order: str = "seq", sample: int = 20) -> DataFrame:
    """Per file: ``; `` layout when any of the first ``sample`` lines has more than 5
    ``; ``-fields.  Lines of ``read_lines`` know their block: only first blocks are looked
    at.  The sample is a per-file top-n (WindowGroupLimit), the result one row per file."""
    from ..operators.common import top_k_per_group

    lines = df.filter("block_start = 0") if "block_start" in df.columns else df
    first = top_k_per_group(lines.select(file_col, order, col), file_col, [F.col(order)], sample, "_rn")
    return first.groupBy(file_col).agg(
        (F.max(F.size(F.split(F.col(col), "; "))) > 5).alias("semicolon_layout"))


def parse_watchdog(df: DataFrame, col: str = "value", file_col: str = "file", order: str = "seq") -> DataFrame:
    """Watchdog line (either layout) -> the nine ``|`` fields plus ``line`` (the
    normalised ``|`` line).  Layout detection is per file; the per-file flag, one short row a
    file, is broadcast: a shuffle by file would gather all lines of a file in one task."""
    layout = detect_watchdog_layout(df, col, file_col, order)
    v = F.col(col)
    # the ``; `` split is its own column so the rewrite reads it once (expressions
    # inside a conditional branch are not shared by Catalyst)
    with_layout = (df.join(F.broadcast(layout), on=file_col, how="left")
                   .withColumn("_semi", F.when(F.col("semicolon_layout"), F.split(v, "; "))))
    line = F.when(F.col("_semi").isNotNull(), _semicolon_to_pipe(F.col("_semi"))).otherwise(v)
    out = with_layout.withColumn("line", line).drop("semicolon_layout", "_semi")
    parts = F.split(F.col("line"), r"\|")
    return out.select("*", *[F.get(parts, i).alias(name) for i, name in enumerate(WATCHDOG_FIELDS)])


def parse_watchdog_pipe(df: DataFrame, col: str = "value") -> DataFrame:
    """Parse lines already in the ``|`` layout (no detection pass)."""
    parts = F.split(F.col(col), r"\|")
    return df.select("*", F.col(col).alias("line"),
                     *[F.get(parts, i).alias(name) for i, name in enumerate(WATCHDOG_FIELDS)])


def watchdog_type(col: str = "line") -> Column:
    """``cut -f3 -d'|'``: a line without ``|`` is its own type."""
    return cut_field(col, "|", 3)


def normalize_error(col: str | Column) -> Column:
    """PHP error line -> message key: text after the first ``]``, first
    `` request_id="..."`` removed, first ``tried to allocate <digits>`` made constant."""
    c = F.col(col) if isinstance(col, str) else col
    after = F.when(F.instr(c, "]") == 0, c).otherwise(F.regexp_replace(c, r"^[^\]]*\]", ""))
    return replace_first(strip_request_id(after), r"tried to allocate [0-9]*", "tried to allocate [number]")


def parse_php_error(df: DataFrame, col: str = "value") -> DataFrame:
    """PHP error line -> ``ts, message, request_id, message_key``."""
    v = F.col(col)
    stamp = F.regexp_extract(v, r"^\[([^\]]*)\]", 1)
    rid = F.regexp_extract(v, r'request_id="([^"]*)"', 1)
    return df.select(
        "*",
        F.try_to_timestamp(stamp, F.lit("dd-MMM-yyyy HH:mm:ss 'UTC'")).cast("timestamp_ntz").alias("ts"),
        F.when(rid != "", rid).alias("request_id"),
        normalize_error(v).alias("message_key"),
    )
