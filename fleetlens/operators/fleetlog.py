"""Per-host log checks across a fleet (OP-27..OP-36).

Hosts are a column, so every host is scanned in parallel instead of one SSH session
after another.  Inputs carry ``host``, ``seq`` (line order) and ``value``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import awk_field, contains_any, flag_keywords, matches_any, substring_from
from .common import last_n_by, threshold_flag, top_k_per_group

# Fixed values from the checks.
SYSLOG_INCLUDE = [
    "not enough memory", "could not be unfrozen", "Out of memory", r"Killed process [0-9]* \([^\)]*\)",
    "AH_SERIOUS_", "AH_SPLIT_BRAIN", "Applying configuration version", "ah-callback: task [0-9]* triggering .*",
    " deploying .*", "Restarting .*",
]
SYSLOG_SEVERE = ["not enough memory", "could not be unfrozen", "Out of memory", "Killed process",
                 "handling overloaded server", "sending 503"]
SERIOUS_TAG = "AH_SERIOUS_"
FPM_SKIP_PHRASES = ["you may need to increase pm.start_servers", "server reached max_children setting"]
WEBSERVER_SKIP_PHRASE = "skip the spawn request"
TASK_KEYWORDS = ["db-migrate", "purge-domain", "save.site_config_setting", "php.ini", "code-push", "Prod", "commit",
                 "elevate code", "reboot"]
EXCLUDED_PORTS = [3306, 11211]
ANSI_CODES = "\x1b\\[[0-9;]*[mK]"


def _syslog_day(now: str) -> Column:
    """``%h %_d `` of ``now``: month and blank-padded day, as syslog writes them."""
    t = F.lit(now).cast("timestamp_ntz")
    return F.concat(F.date_format(t, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(t).cast("string"), 2, " "), F.lit(" "))


def _syslog_hour(now: str) -> Column:
    t = F.lit(now).cast("timestamp_ntz")
    return F.concat(_syslog_day(now), F.date_format(t, "HH"), F.lit(":"))


def mail_per_day(df: DataFrame) -> DataFrame:
    """Delivered mails per day: every ``yyyy-m-d`` in lines with ``Completed`` counts."""
    days = (df.filter(F.col("value").contains("Completed"))
            .select(F.explode(F.regexp_extract_all("value", F.lit("[0-9]{4}-[0-9]*-[0-9]*"), 0)).alias("day")))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy("day")


def syslog_events(df: DataFrame, now: str, include: Sequence[str] = SYSLOG_INCLUDE, exclude: Sequence[str] = (),
                  n: int | None = None, window: int | None = None) -> DataFrame:
    """Important syslog lines per host: matching ``include``, not containing any
    ``exclude`` literal; flags: today, this hour, severe.  Two explicit previews: ``n``
    keeps the last ``n`` matches per host (the report shows 100), ``window`` looks only
    at each host's last ``window`` lines (the report reads 3000)."""
    src = last_n_by(df, window, "host") if window else df
    hits = src.filter(matches_any("value", include) & ~contains_any("value", exclude))
    shown = last_n_by(hits, n, "host") if n else hits
    return (shown.select("host", "seq", "value")
            .withColumn("flag_today", F.col("value").startswith(_syslog_day(now)))
            .withColumn("flag_hour", F.col("value").startswith(_syslog_hour(now)))
            .withColumn("flag_severe", matches_any("value", SYSLOG_SEVERE)))


def literal_events(df: DataFrame, now: str, tag: str = SERIOUS_TAG, window: int | None = None) -> DataFrame:
    """Lines containing ``tag`` (``fgrep``) per host, flagged for today / this hour."""
    src = last_n_by(df, window, "host") if window else df
    return (src.filter(F.col("value").contains(tag)).select("host", "seq", "value")
            .withColumn("flag_today", F.col("value").startswith(_syslog_day(now)))
            .withColumn("flag_hour", F.col("value").startswith(_syslog_hour(now))))


def skip_spawns(df: DataFrame, dialect: str = "fpm", window: int | None = None) -> DataFrame:
    """Process-spawn refusals per host and hour key.

    ``fpm``: lines with either pool phrase, key = text before the first ``:`` plus
    ``:XX:XX``.  ``webserver``: lines with ``skip the spawn request``, key = text
    before the first ``:`` without its first character, plus ``:XX``."""
    src = last_n_by(df, window, "host") if window else df
    head = F.split_part(F.col("value"), F.lit(":"), F.lit(1))
    if dialect == "fpm":
        rows = src.filter(contains_any("value", FPM_SKIP_PHRASES)).select(
            "host", F.concat(head, F.lit(":XX:XX")).alias("hour_key"))
    elif dialect == "webserver":
        rows = src.filter(F.col("value").contains(WEBSERVER_SKIP_PHRASE)).select(
            "host", F.concat(substring_from(head, 2), F.lit(":XX")).alias("hour_key"))
    else:
        raise ValueError(dialect)
    return rows.groupBy("host", "hour_key").agg(F.count(F.lit(1)).alias("n"))


def count_literal_by_host(df: DataFrame, hosts: DataFrame, literal: str = "SIGSEGV") -> DataFrame:
    """Lines containing ``literal`` per host; hosts without any still listed with 0."""
    counts = df.filter(F.col("value").contains(literal)).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return (hosts.select("host").distinct().join(counts, "host", "left")
            .select("host", F.coalesce("n", F.lit(0)).alias("n")))


def downtime_events(df: DataFrame, today: str, body: str = "html", key: str = "page_id", sep: str = "<br>|\n",
                    skip: int = 2, n: int | None = None, keep: str = "20") -> DataFrame:
    """Downtime notices: split each body on ``sep`` (line breaks of either kind), drop the
    first ``skip`` pieces, keep pieces containing ``keep`` (``20``: a year); today's
    flagged.  ``n`` is an explicit preview of the first pieces per body (the report shows
    15).  Each body is exploded on its own row, so no body is gathered anywhere."""
    pieces = df.select(key, F.posexplode(F.split(F.col(body), sep)).alias("pos", "piece"))
    kept = pieces.filter((F.col("pos") >= skip) & F.col("piece").contains(keep))
    first = top_k_per_group(kept, key, [F.col("pos")], n, "_rn").drop("_rn") if n else kept
    return (first.select(key, (F.col("pos") + 1).cast("long").alias("pos"), "piece")
            .withColumn("flag_today", F.col("piece").contains(today)))


def flag_tasks(df: DataFrame, now: str, keywords: Sequence[str] = TASK_KEYWORDS) -> DataFrame:
    """Task history with flags: risky keywords (case-insensitive) and today's rows."""
    day = F.date_format(F.lit(now).cast("timestamp_ntz"), "yyyy-MM-dd")
    return (flag_keywords(df, "value", {"keyword": keywords}, ignore_case=True)
            .withColumn("flag_today", F.col("value").contains(day)))


def audit_errors(df: DataFrame) -> DataFrame:
    """``[error]`` lines of an audit, with carriage returns, colour codes, the tag and
    trailing blanks removed."""
    v = F.translate(F.col("value"), "\r", "")
    v = F.regexp_replace(v, ANSI_CODES, "")
    v = F.regexp_replace(v, r"\[error\]", "")
    v = F.regexp_replace(v, r"[ \t]*$", "")
    return df.filter(F.col("value").contains("[error]")).select("host", "seq", v.alias("message"))


def external_connections(sockets: DataFrame, hosts: DataFrame, exclude_ports: Sequence[int] = EXCLUDED_PORTS) -> DataFrame:
    """Open outbound TCP sockets of PHP processes, database and cache ports excluded;
    hosts with none get one row with status ``none``.

    The socket table is the big, host-skewed side, so it is never the non-preserved
    side of an outer join: connections are kept with an inner join against the host
    list (the small side, broadcastable), and hosts without any come from an anti
    join against the distinct connected hosts (a partial aggregate)."""
    conns = sockets.filter(F.col("process").startswith("php") & (F.col("protocol") == "TCP")
                           & ~F.col("port").isin(list(exclude_ports))).select("host", "process", "protocol", "port")
    host_list = hosts.select("host").distinct()
    found = conns.join(host_list, "host").withColumn("status", F.lit("open"))
    none = (host_list.join(conns.select("host").distinct(), "host", "left_anti")
            .select("host", *[F.lit(None).cast(t).alias(c) for c, t in
                              (("process", "string"), ("protocol", "string"), ("port", "int"))],
                    F.lit("none").alias("status")))
    return found.unionByName(none)


def session_status(df: DataFrame) -> DataFrame:
    """Per captured fetch: ``timeout`` when the fetch failed, ``anonymous session``
    when a Set-Cookie carries a session cookie, ``redirect`` when exactly one Location
    header came back, else ``ok``.  Header arrays are inspected in place (no explode)."""
    # the report reads the captured header lines only: sent (>) and received (<)
    h = F.filter("headers", lambda x: x.rlike("^[<>]"))
    sess = F.exists(h, lambda x: x.rlike("^< Set-Cookie: .*SESS"))
    locs = F.size(F.filter(h, lambda x: x.rlike(". Location:")))
    status = (F.when(F.col("exit") != 0, "timeout").when(sess, "anonymous session")
              .when(locs == 1, "redirect").otherwise("ok"))
    return df.select("domain", "seq", status.alias("status"))


def expand_urls(df: DataFrame, col: str = "domain", n: int | None = None) -> DataFrame:
    """Domains to fetch: a bare domain becomes its http:// and https:// URL; ``n``
    keeps the first n (the check looked at 15)."""
    c = F.col(col)
    urls = F.when(c.startswith("http"), F.array(c)).otherwise(
        F.array(F.concat(F.lit("http://"), c), F.concat(F.lit("https://"), c)))
    out = df.select(c.alias("domain"), F.explode(urls).alias("url"))
    return out.orderBy("domain", "url").limit(n) if n else out


# The four threshold checks.
LOW_DISK_KB = 10_240
BUSY_CPU = (40.0, 99.99)
CONNECTIONS = (100, 599)
LARGE_MEMORY_MB = 200


def low_disk_space(df: DataFrame) -> DataFrame:
    """``df -k`` rows of disks (``/dev/sd``) with less than 10 MB free."""
    v = F.col("value")
    disks = df.filter(v.contains("/dev/sd")).select(
        "host", awk_field(v, 1).alias("filesystem"), awk_field(v, 4).try_cast("long").alias("available_kb"), awk_field(v, 6).alias("mounted"))
    low = threshold_flag(disks, "available_kb", hi=LOW_DISK_KB, hi_strict=True, keep_only=True)
    return low.withColumn("available_mb", F.round(F.col("available_kb") / 1024, 2))


def busy_cpu(df: DataFrame) -> DataFrame:
    """Process statistics; lines with a share of 40.00 to 99.99 % flagged."""
    share = F.regexp_extract("value", r"([0-9]+\.[0-9]{2})", 1).try_cast("double")
    return threshold_flag(df.select("host", "seq", share.alias("cpu")), "cpu", *BUSY_CPU)


def connection_limits(df: DataFrame) -> DataFrame:
    """Connection limits of balancers; complete settings (ending in ``;``) of 100 to 599 flagged."""
    limit = F.regexp_extract("value", r"max_conn=([0-9]+);$", 1).try_cast("int")
    return threshold_flag(df.select("seq", limit.alias("max_conn")), "max_conn", *CONNECTIONS)


def memory_limits(df: DataFrame) -> DataFrame:
    """Memory limits; 200 MB and more flagged."""
    limit = F.regexp_extract("value", r"=> ([0-9]+)M", 1).try_cast("int")
    return threshold_flag(df.select("seq", limit.alias("limit_mb")), "limit_mb", lo=LARGE_MEMORY_MB)
