"""Fleet-table checks (OP-38..OP-58; OP-37 and OP-44 live in ``common``).

Inputs are DataFrames of captured command output (``seq``, ``value`` lines) or of
catalog-like tables.  Order-dependent checks use the chunked scans of ``sequence``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import awk_field, flag_keywords, matches_any
from .common import join_same
from .sequence import DEFAULT_CHUNK_BITS, Scan, forward_fill, scan

# Fixed values from the checks.
UNCACHED_BAD = 0.075
SYSTEM_SCHEMAS = ["mysql", "information_schema", "performance_schema"]
GB = 1024 ** 3
BIG_TABLE_BYTES = 100 * 1024 * 1024
BIG_TABLE_ROWS = 10_000
PAYLOAD_LIMIT = 1_048_576
MODULE_LIMIT = 200
WEB_LIKE = "srv-|web-|ded-|staging-|managed-"
OUT_OF_ROTATION = r" (\*|†)"
CACHE_PROBLEM = r"page_cache_maximum_age  *0| cache  *0|Enabled  *($|none)|DRUPAL_NO_CACHE"
DOMAIN_ALERTS = ["not pointing at", "No DNS entry"]
UPDATE_ALERTS = {"security": "SECURITY UPDATE available", "unsupported": "Installed version not supported"}
DUPLICATE_TEST_FIXTURES = "drupal_system_listing_(in|)compatible_test"


def _num(c: Column) -> Column:
    """Leading integer of a field, NULL when there is none."""
    return F.regexp_extract(c, r"^(-?[0-9]+)", 1).try_cast("long")


def _positive(c: Column) -> Column:
    """awk's ``field > 0``: the leading number, decimals included."""
    return F.coalesce(F.regexp_extract(c, r"^([0-9]+(\.[0-9]+)?|\.[0-9]+)", 1).try_cast("double") > 0, F.lit(False))


def drift(df: DataFrame, host: str = "host", n: str = "folders") -> DataFrame:
    """Deployment drift: every host should hold the same count.  ``problem`` when any
    two differ; hosts below the maximum are flagged.  Max and min are scalar
    subqueries (one global partial aggregate), not a join."""
    mx = df.select(F.max(n)).scalar()
    mn = df.select(F.min(n)).scalar()
    return df.select(host, n, mx.alias("max_n"), (F.col(n) < mx).alias("flag_below_max"),
                     (mx != mn).alias("problem"))


def version_drift(df: DataFrame, host: str = "host", version: str = "version") -> DataFrame:
    """Release version per host; ``problem`` when more than one version is deployed."""
    nv = df.select(F.count_distinct(version)).scalar()
    return df.select(host, version, (nv > 1).alias("problem"))


def uncached_ratio(df: DataFrame, bad: float = UNCACHED_BAD) -> DataFrame:
    """Rows with total > 0 and their uncached share, flagged above ``bad``; an input
    with no data rows yields one ``no data`` row."""
    rows = (df.filter(F.col("total") > 0)
            .withColumn("ratio", F.try_divide(F.col("uncached"), F.col("total")))
            .withColumn("status", F.when(F.col("ratio") > bad, "high").otherwise("ok")))
    spark = df.sparkSession
    nodata = (spark.range(1).filter(~df.exists())
              .select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields
                        if f.name != "status"], F.lit("no data").alias("status")))
    return rows.unionByName(nodata)


def process_capacity(lines: DataFrame, user: str, file: str = "file") -> DataFrame:
    """Per server section of a process listing: overall and per-user process limits,
    running processes, memory; flags user at limit, free memory under 20 %.

    Section headers (``[server]``) are forward-filled onto their rows with the chunked
    scan, then each section is one conditional aggregate (last value by ``seq``).  A
    server listed twice is two sections; a section without a count of running
    processes has 0."""
    rows = process_values(lines.filter(~F.col("value").contains("defunct")), user)
    header = F.when(F.col("server").isNotNull(), F.struct(F.col("seq").alias("at"), "server"))
    rows = forward_fill(rows.withColumn("_hdr", header).drop("server"), "_hdr", "seq", "_section", partition_by=file)
    rows = rows.select("*", F.col("_section.at").alias("_at"), F.col("_section.server").alias("server"))

    def last_known(col: str) -> Column:
        return F.max_by(col, F.when(F.col(col).isNotNull(), F.col("seq"))).alias(col)

    agg = (rows.filter(F.col("server").isNotNull())
           .groupBy(file, "_at", "server")
           .agg(last_known("max_overall"), last_known("total_running"), last_known("max_user"),
                F.sum("user_running").alias("user_running"), last_known("total_mem"), last_known("free_mem")))
    return (agg.drop("_at").withColumn("total_running", F.coalesce("total_running", F.lit(0)))
            .withColumn("flag_user_at_max", F.col("user_running") >= F.col("max_user"))
            .withColumn("flag_low_mem", F.try_divide(F.col("free_mem"), F.col("total_mem")) < 0.2))


def process_values(lines: DataFrame, user: str) -> DataFrame:
    """What each line of a process listing says, in columns in place of ``value``: ``server`` of a
    ``[server]`` header, limits, running processes and memory (NULL where it says nothing), and
    ``user_running`` 1 for a running process of ``user``, else 0."""
    v = F.col("value")
    f1, f2 = awk_field(v, 1), awk_field(v, 2)
    memory = F.coalesce(v.startswith("Mem:"), F.lit(False))
    return lines.select(
        *[c for c in lines.columns if c != "value"],
        F.when(v.contains("["), F.expr("substring(value, 2, length(value) - 2)")).alias("server"),
        F.when(v.contains("MaxProcessCount"), _num(f2)).alias("max_overall"),
        F.when(v.contains("procs running"), _num(f1)).alias("total_running"),
        F.when(v.contains("DefaultMaxClass"), _num(f2)).alias("max_user"),
        F.coalesce((f1 == user) & _positive(f2), F.lit(False)).cast("long").alias("user_running"),
        F.when(memory, _num(f2)).alias("total_mem"),
        F.when(memory, _num(awk_field(v, 4))).alias("free_mem"))


def flat_capacity(df: DataFrame) -> DataFrame:
    """Per-server variant of ``process_capacity`` (one row per server already):
    ``server, max_procs, running, total_mem, free_mem``; flags running at the
    limit and free memory under 20 %."""
    return (df.withColumn("flag_at_max", F.col("running") >= F.col("max_procs"))
            .withColumn("flag_low_mem", F.try_divide(F.col("free_mem"), F.col("total_mem")) < 0.2))


def resolve_sections(lines: DataFrame, labels: DataFrame, file: str = "file") -> DataFrame:
    """Lookup listing: ``[Label]:`` headers name a realm, indented rows are its sites.
    Each site row gets its realm label (forward fill) and code (label table); the
    last site row of each file is ``chosen`` (later matches overwrite earlier ones)."""
    v = F.col("value")
    hdr = F.when(v.startswith("["), F.expr("substring(value, 2, length(value) - 3)"))
    site = F.when(v.startswith(" "), F.col("seq"))
    filled = scan(lines, [Scan("label", hdr, "last"), Scan("_last", site, "all_max")], "seq", partition_by=file)
    return (filled.filter(v.startswith(" "))
            .select(file, "seq", "label", awk_field(v, 1).alias("site"), (F.col("seq") == F.col("_last")).alias("chosen"))
            .join(labels, "label", "left"))


def passive_or_active(df: DataFrame, file: str = "file") -> DataFrame:
    """Database to read from, per listing: the host row right after an ``active-db``
    row (the last such when several), else the active host itself.

    "Right after" is the successor among host rows, and successors grow with their
    row, so the last assignment is the successor of the last active row that has
    one (any active row before the listing's last host row).  That is three per-file
    aggregates (max / min by ``seq``) - no sort of the listing."""
    v = F.col("value")
    hosts = df.filter(v.rlike("^[a-z]+-[0-9]+")).select(file, "seq", awk_field(v, 1).alias("host"),
                                                       awk_field(v, 2).alias("role"))
    is_active = F.col("role") == "active-db"
    ends = hosts.groupBy(file).agg(F.max("seq").alias("_last"),
                                   F.max_by(F.when(is_active, F.col("host")), F.when(is_active, F.col("seq")))
                                   .alias("active"))
    with_end = join_same(hosts, ends, file)
    anchor = (with_end.filter(is_active & (F.col("seq") < F.col("_last")))
              .groupBy(file).agg(F.max("seq").alias("_anchor")))
    passive = (join_same(hosts, anchor, file).filter(F.col("seq") > F.col("_anchor"))
               .groupBy(file).agg(F.min_by("host", "seq").alias("passive")))
    return (join_same(ends, passive, file, "left").select(file, "passive", "active")
            .withColumn("chosen", F.coalesce("passive", "active")))


def select_hosts(df: DataFrame, include_marked: bool = False, file: str = "file") -> DataFrame:
    """Web servers of an application listing: web-like rows, out-of-rotation rows
    dropped unless ``include_marked``; once a ``web-`` row was seen, the first later
    ``ded-`` row switches the output off for the rest of the listing.

    The switch-off point is the first ``ded-`` row at or after the first ``web-`` row,
    so the output is every row before it: two per-file minima (partial aggregates)
    and a filter, with no sort of the listing."""
    v = F.col("value")
    rows = df.filter(v.rlike(WEB_LIKE))
    if not include_marked:
        rows = rows.filter(~v.rlike(OUT_OF_ROTATION))
    first_web = rows.filter(v.contains("web-")).groupBy(file).agg(F.min("seq").alias("_web"))
    off_at = (join_same(rows, first_web, file).filter(v.contains("ded-") & (F.col("seq") >= F.col("_web")))
              .groupBy(file).agg(F.min("seq").alias("_off")))
    return (join_same(rows, off_at, file, "left").filter(F.col("_off").isNull() | (F.col("seq") < F.col("_off")))
            .select(file, "seq", awk_field(v, 1).alias("host")))


def active_balancers(df: DataFrame) -> DataFrame:
    """Balancer rows (`` bal-``) whose third field is a positive number."""
    v = F.col("value")
    return (df.filter(v.contains(" bal-") & _positive(awk_field(v, 3)))
            .select("seq", awk_field(v, 1).alias("host")))


def domain_status(df: DataFrame, alerts: Sequence[str] = DOMAIN_ALERTS, status: str = "status") -> DataFrame:
    """Domain check ordered by status; domains not resolving to the platform flagged."""
    return df.withColumn("flag", matches_any(status, alerts)).orderBy(status, "domain")


def match_lists(names: DataFrame, lists: DataFrame) -> DataFrame:
    """Enabled names that appear exactly in a (severity, name) list."""
    return names.join(lists, "name").select("severity", "name")


def count_over(names: DataFrame, limit: int = MODULE_LIMIT) -> DataFrame:
    """How many names are enabled, flagged above ``limit``."""
    return names.agg(F.count(F.lit(1)).alias("n")).withColumn("flag", F.col("n") > limit)


def update_status(df: DataFrame, col: str = "status_msg") -> DataFrame:
    """Pending updates with security and unsupported-version rows flagged."""
    return flag_keywords(df, col, {name: [re.escape(text)] for name, text in UPDATE_ALERTS.items()},
                         ignore_case=False)


def cache_audit(lines: DataFrame, head: int = 10, file: str = "file") -> DataFrame:
    """Cache audit: the first ``head`` lines pass through; every ``Enabled`` line is
    shown, highlighted when a problem line occurred since the previous ``Enabled``
    line (itself included).

    The input is read twice.  A summary by chunk of lines (a partial aggregate) tells how many
    lines a file has before the chunk and what its last marked line (a problem or ``Enabled``)
    was; then only marked lines, and all lines of the chunks in which the head lies, go on to
    the window of their chunk."""
    v = F.col("value")
    enabled = F.coalesce(v.contains("Enabled"), F.lit(False))
    problem = F.coalesce(v.rlike(CACHE_PROBLEM), F.lit(False))
    marked = lines.select(file, "seq", "value", F.shiftright("seq", DEFAULT_CHUNK_BITS).alias("_chunk"), enabled.alias("_enabled"),
                          problem.alias("_problem"))
    # of a marked line: whether it leaves a problem to be shown by the next ``Enabled`` line
    marked = marked.withColumn("_leaves", F.when(F.col("_enabled") | F.col("_problem"), ~F.col("_enabled")))
    summary = marked.groupBy(file, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("_leaves", F.when(F.col("_leaves").isNotNull(), F.col("seq"))).alias("_left"))
    earlier = Window.partitionBy(file).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(file, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                             F.last("_left", ignorenulls=True).over(earlier).alias("_carry"))
    rows = join_same(marked, summary, [file, "_chunk"]).filter(F.col("_leaves").isNotNull() | (F.col("_before") < head))
    w = Window.partitionBy(file, "_chunk").orderBy("seq")
    carried = F.coalesce(F.last("_leaves", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"), F.lit(False))
    # where the head lies, all lines are there and are numbered
    place = F.when(F.col("_before") < head, F.col("_before") + F.row_number().over(w))
    rows = rows.withColumn("_shown", F.col("_problem") | carried).withColumn("_place", place)
    kinds = F.array_compact(F.array(F.when(F.col("_place") <= head, F.struct(F.lit("head").alias("kind"), F.lit(False).alias("highlight"))),
                                    F.when(F.col("_enabled"), F.struct(F.lit("enabled").alias("kind"), F.col("_shown").alias("highlight")))))
    return rows.select(file, "seq", "value", F.explode(kinds).alias("_k")).select(file, "seq", "value", "_k.kind", "_k.highlight")


def flag_overrides(df: DataFrame) -> DataFrame:
    """Setting lines, those overriding the default flagged."""
    return df.withColumn("flag", F.col("value").contains("overrides"))


def block_cache(df: DataFrame, col: str = "cache") -> DataFrame:
    """Block cache mode, ``undefined`` when empty (PHP ``empty``: NULL, '' and '0')."""
    c = F.col(col)
    return df.withColumn("cache_mode", F.when(c.isNull() | c.isin("", "0"), "undefined").otherwise(c))


def classify_version(df: DataFrame, col: str = "version", warn_major: str = "6", fork: str = "Pressflow") -> DataFrame:
    """``warn`` for major version 6 of the stock product (no performance fork), else ``ok``."""
    product = F.split_part(F.col(col), F.lit(" "), F.lit(1))
    major = F.split_part(F.split_part(F.col(col), F.lit(" "), F.lit(2)), F.lit("."), F.lit(1))
    return (df.withColumn("product", product).withColumn("major", major)
            .withColumn("status", F.when((major == warn_major) & (product != fork), "warn").otherwise("ok")))


def storage_by_engine(df: DataFrame, unit: int = GB, digits: int = 3) -> DataFrame:
    """Data, index and total bytes per storage engine plus a ``Total`` row (ROLLUP),
    system schemas and engine-less tables left out; sizes also in ``unit`` rounded."""
    rows = df.filter(~F.col("table_schema").isin(SYSTEM_SCHEMAS) & F.col("engine").isNotNull())
    agg = (rows.rollup("engine")
           .agg(F.sum("data").alias("data_bytes"), F.sum("index").alias("index_bytes"),
                F.sum(F.col("data") + F.col("index")).alias("total_bytes"),
                F.grouping("engine").alias("_g")))
    out = agg.select(F.when(F.col("_g") == 1, "Total").otherwise(F.col("engine")).alias("engine"),
                     "data_bytes", "index_bytes", "total_bytes",
                     *[F.round(F.col(f"{c}_bytes") / unit, digits).alias(f"{c}_gb") for c in ("data", "index", "total")])
    return out.orderBy("total_bytes")


def largest_tables(df: DataFrame, n: int = 10, big_bytes: int = BIG_TABLE_BYTES, big_rows: int = BIG_TABLE_ROWS) -> DataFrame:
    """The ``n`` largest tables (data + index); large ones (>= 100 MB, >= 10,000 rows) flagged."""
    return (df.withColumn("total", F.col("data") + F.col("index"))
            .orderBy(F.desc("total"), F.desc("table_name")).limit(n)
            .withColumn("flag_size", F.col("total") >= big_bytes)
            .withColumn("flag_rows", F.col("row_count") >= big_rows))


def large_payloads(df: DataFrame, limit: int = PAYLOAD_LIMIT, k: int = 5, key: str = "name", col: str = "value") -> DataFrame:
    """Cached payloads longer than ``limit`` bytes, size in MB, the k largest."""
    rows = df.select(F.col(key).alias("cid"), F.octet_length(col).alias("bytes"))
    return (rows.filter(F.col("bytes") > limit).withColumn("size_mb", F.col("bytes") / 1048576.0)
            .orderBy(F.desc("bytes"), F.desc("cid")).limit(k))


def variable_stats(df: DataFrame, col: str = "value") -> DataFrame:
    """Number of variables, largest and combined size in bytes, each flagged above
    the check's thresholds (1,000 variables, 10,000 B, 1,000,000 B)."""
    return (df.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length(col)).alias("max_len"),
                   F.sum(F.octet_length(col)).alias("total_len"))
            .withColumn("flag_n", F.col("n") >= 1_000)
            .withColumn("flag_max", F.col("max_len") >= 10_000)
            .withColumn("flag_total", F.col("total_len") >= 1_000_000))


def anonymous_sessions(df: DataFrame, n: int = 10, width: int = 80) -> DataFrame:
    """The ``n`` newest sessions of anonymous users (uid 0): time and the first
    ``width`` characters of the session data."""
    return (df.filter(F.col("uid") == 0)
            .orderBy(F.desc("timestamp"), F.desc("session")).limit(n)
            .select("uid", "hostname", "timestamp",
                    F.timestamp_seconds("timestamp").cast("timestamp_ntz").alias("ts"),
                    F.substring("session", 1, width).alias("session")))


def flush_ages(df: DataFrame, now: str) -> DataFrame:
    """``name: epoch`` lines -> time and age in seconds, oldest first; flushes of
    today and those 10..9,999 seconds old flagged."""
    v = F.col("value")
    epoch = F.trim(F.split_part(v, F.lit(":"), F.lit(2))).try_cast("long")
    now_ts = F.lit(now).cast("timestamp_ntz")
    now_s = F.unix_seconds(now_ts.cast("timestamp"))
    out = df.select(F.split_part(v, F.lit(":"), F.lit(1)).alias("name"), epoch.alias("epoch"))
    out = (out.withColumn("ts", F.timestamp_seconds("epoch").cast("timestamp_ntz"))
           .withColumn("age_s", now_s - F.col("epoch"))
           .withColumn("flag_today", F.to_date("ts") == F.to_date(now_ts))
           .withColumn("flag_recent", F.col("age_s").between(10, 9_999)))
    return out.orderBy("epoch")


def duplicate_modules(paths: DataFrame, system: DataFrame, path: str = "path") -> DataFrame:
    """Extensions whose ``.info`` base name exists at more than one path, for names
    where one of the paths is the enabled one; every path is listed with
    ``is_enabled``.  Enabled = system rows of module/theme/profile type, their file
    suffix rewritten to ``.info``.

    Names are found with a partial aggregate, the paths come back through semi joins
    (AQE splits a skewed name), so no name's paths are ever gathered in one task."""
    named = paths.select(F.col(path).alias("path"), F.substring_index(F.col(path), "/", -1).alias("name"))
    dups = (named.groupBy("name").agg(F.count_distinct("path").alias("_n"))
            .filter((F.col("_n") > 1) & ~F.col("name").rlike(DUPLICATE_TEST_FIXTURES)).select("name"))
    info = F.regexp_replace(F.regexp_replace(F.col("filename"), r"\.module", ".info"), r"\.theme", ".info")
    enabled = (system.filter(F.col("type").isin("module", "theme", "profile") & (F.col("status") == "enabled"))
               .select(info.alias("path")).distinct().withColumn("is_enabled", F.lit(True)))
    cand = (named.join(dups, "name", "left_semi").join(enabled, "path", "left")
            .withColumn("is_enabled", F.coalesce("is_enabled", F.lit(False))))
    with_enabled = cand.filter("is_enabled").select("name").distinct()
    return cand.join(with_enabled, "name", "left_semi").select("name", "path", "is_enabled")
