"""The registered query set: each entry renders its inputs from the driver tables with
Spark and runs one report.  Keys are the report function names.

Entries without a DuckDB oracle (see ``oracle_sql.py``) say why in their docstring."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import common, fleet, fleetlog, heavy, increments, inventory, patterns, review, traffic, watchdog
from ..session import shared_dir
from ..sources import lines as src_lines
from ..sources import discovery, drift, quality, store
from ..sources import tables as src_tables
from ..sources.parse import normalize_error, parse_access, parse_php_error, parse_watchdog, parse_watchdog_pipe
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed "now" arguments of the fixtures (never the wall clock).
EVENTS_NOW = "2024-01-30 23:30:00"
EVENTS_TODAY = "2024-01-15"
ORDERS_NOW = "2002-01-01 00:00:00"
REVIEW_SINCE = "2000-01-01 00:00:00"
REVIEWER = "user7"
PAYLOAD_TEST_LIMIT = 10_000
LARGE_TEST_LOG = 540_000
SPLIT_BRAIN_NOISE = "AH_SPLIT_BRAIN: Split brain detected: db=main"


def register(name: str | None = None):
    def deco(fn):
        QUERIES[name or fn.__name__] = fn
        return fn
    return deco


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_access(fx.access_lines(spark, sf_dir))


def php_errors(spark, sf_dir) -> DataFrame:
    return parse_php_error(fx.php_error_lines(spark, sf_dir))


def watchdog_log(spark, sf_dir) -> DataFrame:
    return parse_watchdog_pipe(fx.watchdog_lines(spark, sf_dir, "pipe"))


# ------------------------------------------------------------------ sources (OP-01..11)

@register()
def read_lines(spark, sf_dir):
    """F1 written per site to the shared folder (site2 gzip-compressed) and scanned back."""
    out = shared_dir(spark, "access")
    lines = fx.access_lines(spark, sf_dir)
    lines = lines.select(F.col("log_site").alias("site"), "value")
    lines.filter("site != 'site2'").write.partitionBy("site").text(out + "/plain")
    lines.filter("site = 'site2'").write.partitionBy("site").option("compression", "gzip").text(out + "/gz")
    df = src_lines.read_lines(spark, [out + "/plain", out + "/gz"], recursiveFileLookup="true")
    return df.select(F.regexp_extract("file", "site=([^/]+)", 1).alias("site"), "value")


@register()
def last_n_lines(spark, sf_dir):
    lines = fx.access_lines(spark, sf_dir).withColumn("file", F.concat(F.lit("access-"), "log_site", F.lit(".log")))
    return src_lines.last_n_lines(lines, 3000).select("file", "seq", "value")


@register()
def file_sizes(spark, sf_dir):
    """Plain-text F1 per site; sizes of the written files summed per site folder."""
    out = shared_dir(spark, "sizes")
    fx.access_lines(spark, sf_dir).select(F.col("log_site").alias("site"), "value").write.partitionBy("site").text(out)
    sizes = src_lines.file_sizes(spark, out + "/site=*/*.txt")
    per_site = (sizes.groupBy(F.regexp_extract("file", "site=([^/]+)", 1).alias("site"))
                .agg(F.sum("bytes").alias("bytes")))
    return (per_site.withColumn("size_mb", F.round(F.col("bytes") / 1048576.0, 1))
            .withColumn("flag_large", F.col("bytes") > LARGE_TEST_LOG))


@register()
def read_stats_csv(spark, sf_dir):
    out = shared_dir(spark, "stats")
    fx.stats_rows(spark, sf_dir).write.option("header", True).csv(out)
    return src_tables.read_stats_csv(spark, out)


@register()
def uncached_ratio(spark, sf_dir):
    return fleet.uncached_ratio(fx.stats_rows(spark, sf_dir), bad=0.2)


@register()
def flatten_inventory(spark, sf_dir):
    return inventory.flatten_inventory(fx.inventory_json(spark, sf_dir))


@register()
def hosts_by_role(spark, sf_dir):
    return inventory.hosts_by_role(inventory.flatten_inventory(fx.inventory_json(spark, sf_dir)))


@register()
def read_records(spark, sf_dir):
    """Issues saved as JSON pages of 100 records (one array per line), read back and
    flattened.  Pages are small bounded groups (100 records)."""
    out = shared_dir(spark, "pages")
    iss = fx.issues(spark, sf_dir)
    page = (iss.withColumn("page", F.expr("number div 100"))
            .groupBy("page").agg(F.to_json(F.collect_list(F.struct(*[c for c in iss.columns]))).alias("value")))
    page.select("value").write.text(out)
    recs = src_tables.read_records(spark, out, fx.ISSUE_SCHEMA, multi_line=False)
    return recs.select("repo", "number", "title", "updated_at", F.col("user.login").alias("login"),
                       F.size("labels").alias("n_labels"), F.col("pull_request.html_url").alias("html_url"))


@register()
def write_report(spark, sf_dir):
    """Hourly traffic written as parquet to the shared folder and read back."""
    out = shared_dir(spark, "report")
    src_tables.write_report(traffic.hourly_traffic(access(spark, sf_dir), "site1"), out)
    return spark.read.parquet(out)


@register("parse_access")
def _parse_access(spark, sf_dir):
    return access(spark, sf_dir).drop("value", "file", "log_site")


@register("parse_watchdog")
def _parse_watchdog(spark, sf_dir):
    df = parse_watchdog(fx.watchdog_lines(spark, sf_dir, "semicolon"))
    return df.select("seq", "head", F.col("epoch").try_cast("long").alias("epoch"), "type", "ip", "uri",
                     F.col("uid").try_cast("long").alias("uid"), "message")


@register("normalize_error")
def _normalize_error(spark, sf_dir):
    return fx.php_error_lines(spark, sf_dir).select("seq", normalize_error("value").alias("message"))


# ------------------------------------------------------------------ access / error reports

@register("hourly_traffic")
def _hourly_traffic(spark, sf_dir):
    return traffic.hourly_traffic(access(spark, sf_dir), "site1")


@register("top_slow")
def _top_slow(spark, sf_dir):
    return traffic.top_slow(access(spark, sf_dir), "site1")


@register("top_error_paths")
def _top_error_paths(spark, sf_dir):
    return traffic.top_error_paths(access(spark, sf_dir))


@register("top_error_paths_hourly")
def _top_error_paths_hourly(spark, sf_dir):
    return traffic.top_error_paths_hourly(access(spark, sf_dir))


@register("paged_hits_by_agent")
def _paged_hits(spark, sf_dir):
    return traffic.paged_hits_by_agent(access(spark, sf_dir))


@register("latest_matching")
def _latest_matching(spark, sf_dir):
    return traffic.latest_matching(access(spark, sf_dir), "GET /cron.php", 5)


@register("top_errors")
def _top_errors(spark, sf_dir):
    return traffic.top_errors(php_errors(spark, sf_dir))


@register("oom_paths")
def _oom_paths(spark, sf_dir):
    return traffic.oom_paths(php_errors(spark, sf_dir), access(spark, sf_dir))


@register("top_counts")
def _top_counts(spark, sf_dir):
    return common.top_counts(access(spark, sf_dir), ["status"], 5)


@register("ten_minute_times")
def _ten_minute_times(spark, sf_dir):
    ev = fx.events(spark, sf_dir).withColumn("exec_us", F.round(F.col("value") * 20000).cast("long"))
    return traffic.ten_minute_times(ev.withColumn("queue_us", F.expr("exec_us div 10")))


# ------------------------------------------------------------------ two-pass counts, id filter, store, increments

@register()
def heavy_hitters(spark, sf_dir):
    """Two-pass top-k over urls of which most carry a parameter of their own (almost all keys are distinct)."""
    rows = access(spark, sf_dir).select(F.when(F.col("seq") % 5 < 2, F.col("path")).otherwise(F.concat("path", F.lit("?id="), "request_id")).alias("url"), "status")
    return heavy.heavy_hitters(rows, ["url", "status"], 5)


@register()
def top_error_paths_heavy(spark, sf_dir):
    return traffic.top_error_paths(access(spark, sf_dir), counts=heavy.heavy_hitters)


@register()
def top_error_paths_hourly_heavy(spark, sf_dir):
    """Hour and path: flat counts, for which the bound proves nothing and the plain form answers."""
    return traffic.top_error_paths_hourly(access(spark, sf_dir), counts=heavy.heavy_hitters)


@register()
def paged_hits_by_agent_heavy(spark, sf_dir):
    return traffic.paged_hits_by_agent(access(spark, sf_dir), counts=heavy.heavy_hitters)


@register()
def top_errors_heavy(spark, sf_dir):
    return traffic.top_errors(php_errors(spark, sf_dir), counts=heavy.heavy_hitters)


@register()
def top_types_heavy(spark, sf_dir):
    return watchdog.top_types(watchdog_log(spark, sf_dir), alert=2010, counts=heavy.heavy_hitters)


@register()
def top_not_found_heavy(spark, sf_dir):
    return watchdog.top_not_found(watchdog_log(spark, sf_dir), alert=51, counts=heavy.heavy_hitters)


@register()
def oom_paths_filtered(spark, sf_dir):
    """``oom_paths`` with a bit filter of the ids on the raw access lines."""
    return traffic.oom_paths_filtered(php_errors(spark, sf_dir), fx.access_lines(spark, sf_dir))


@register()
def report_store(spark, sf_dir):
    """Parsed access lines stored by day; one day is delivered again; one site's hour of every day is read."""
    out = shared_dir(spark, "store")
    rows = access(spark, sf_dir).filter("ts is not null").select(
        F.to_date("ts").alias("day"), "site", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        "ts", "request_id", "method", "path", "status", "request_us")
    store.write_store(rows, out)
    store.write_store(rows.filter(F.col("day") == EVENTS_TODAY), out)
    return store.read_store(spark, out).filter((F.col("site") == "site1") & (F.hour("hour") == 7))


@register()
def parse_quality(spark, sf_dir):
    """Malformed lines counted while a report runs: every 50th access line is cut short, every 70th
    has no number for a status."""
    lines = fx.access_lines(spark, sf_dir)
    value = (F.when(F.col("seq") % 50 == 0, F.substring("value", 1, 9))
             .when(F.col("seq") % 70 == 0, F.regexp_replace("value", 'HTTP/1.1" [0-9]+', 'HTTP/1.1" -')).otherwise(F.col("value")))
    watched = quality.Quality("access")
    src_tables.write_report(traffic.top_error_paths(watched.watch(parse_access(lines.withColumn("value", value)))), shared_dir(spark, "watched"))
    return watched.report(spark)


@register()
def read_records_drift(spark, sf_dir):
    """``read_records`` over pages whose records differ in shape (a field more, one less, numbers as
    strings), with lines that are no JSON between them."""
    out = shared_dir(spark, "drifting")
    iss = fx.issues(spark, sf_dir)
    record = F.to_json(F.struct(*iss.columns))
    shape = F.col("number") % 4
    record = (F.when(shape == 1, F.regexp_replace(record, "^.", '{"extra":{"a":[1,null]},'))
              .when(shape == 2, F.regexp_replace(record, '"number":([0-9]+)', '"number":"$1"'))
              .when(shape == 3, F.regexp_replace(record, '"id":([0-9]+)', '"id":"u$1"')).otherwise(record))
    page = iss.withColumn("page", F.expr("number div 100")).withColumn("record", record).groupBy("page").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("value"))
    broken = page.select(F.substring("value", 1, 40).alias("value"))
    page.select("value").unionByName(broken).write.text(out)
    recs, _ = drift.read_drifting(spark, out, fx.ISSUE_SCHEMA)
    return recs.select("repo", "number", "title", "updated_at", F.col("user.login").alias("login"),
                       F.size("labels").alias("n_labels"), F.col("pull_request.html_url").alias("html_url"))


@register()
def newest_files_pruned(spark, sf_dir):
    """``newest_files`` without a list of paths: older files are pruned from the listing by their time."""
    out = shared_dir(spark, "rotated-pruned")
    lines = fx.watchdog_lines(spark, sf_dir, "pipe").join(
        fx.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.to_date("ts").alias("day")), "seq")
    (lines.repartition("day").sortWithinPartitions("seq").select("day", "value")
     .write.partitionBy("day").option("compression", "gzip").text(out))
    fs_touch_days(spark, out)
    df = discovery.read_newest(spark, out + "/day=*/*.txt.gz", 5)
    return watchdog.module_changes(parse_watchdog(df), EVENTS_TODAY).select("head", "message", "flag_today", "flag_costly")


@register()
def new_files(spark, sf_dir):
    """Access lines read in two runs, of which the second reads only the files that came after the first."""
    out = shared_dir(spark, "arrivals")
    lines = fx.access_lines(spark, sf_dir)
    base = increments.hourly_states(parse_access(lines.limit(0)), F.lit("")).drop("delivery")
    states = [base]
    for run in (0, 1):
        lines.filter(F.col("seq") % 3 == 0 if run == 0 else F.col("seq") % 3 > 0).select("value").write.text(f"{out}/in/run{run}")
        touch_in_order(spark, [f"{out}/in/run{r}" for r in range(run + 1)])
        fresh = parse_access(discovery.read_new(spark, out + "/in/*/*.txt", out + "/log"))
        states.append(spark.read.parquet(src_tables.write_report(increments.hourly_states(fresh, F.lit("")).drop("delivery"), f"{out}/states{run}")))
        discovery.mark_read(spark, out + "/in/*/*.txt", out + "/log")
    both = states[0].unionByName(states[1]).unionByName(states[2])
    return increments.merged(both.drop("slow_us"), increments.HOURLY_KEYS)


@register()
def phrase_matches(spark, sf_dir):
    """Phrases found in host logs by the index: a phrase for every part name's two first words and for every fifth request number, beside those of the report."""
    parts = fx.table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 2).alias("phrase"))
    numbers = fx.events(spark, sf_dir).filter("event_id % 5 = 0").select(F.concat(F.lit("process "), F.col("event_id").cast("string"), F.lit(" (php")).alias("phrase"))
    fixed = spark.createDataFrame([(p,) for p in ("Out of memory", "AH_SERIOUS_", "oad abov", "web-3", "kern", "no such phrase")], "phrase string")
    lines = fx.syslog_lines(spark, sf_dir).select("host", "seq", "value")
    return patterns.matches(lines, parts.union(numbers).union(fixed)).groupBy("phrase").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _in_deliveries(rows: DataFrame, fold, path: str) -> str:
    """States of all days, delivered in three calls: odd days, even days, and the first ten days again."""
    rows = rows.withColumn("delivery", F.to_date("ts"))
    day = F.dayofmonth("delivery")
    for part in (day % 2 == 1, day % 2 == 0, day <= 10):
        increments.deliver(fold(rows.filter(part)), path)
    return path


@register()
def hourly_traffic_increments(spark, sf_dir):
    """``hourly_traffic`` from the partial states of daily deliveries, some of which come twice."""
    path = _in_deliveries(access(spark, sf_dir), increments.hourly_states, shared_dir(spark, "hourly-states"))
    return increments.hourly_report(spark, path, "site1")


@register()
def ten_minute_increments(spark, sf_dir):
    """``ten_minute_times`` from the partial states of daily deliveries, some of which come twice."""
    ev = fx.events(spark, sf_dir).withColumn("exec_us", F.round(F.col("value") * 20000).cast("long"))
    path = _in_deliveries(ev.withColumn("queue_us", F.expr("exec_us div 10")), increments.ten_minute_states, shared_dir(spark, "ten-minute-states"))
    return increments.ten_minute_report(spark, path)


# ------------------------------------------------------------------ watchdog

@register("top_types")
def _top_types(spark, sf_dir):
    return watchdog.top_types(watchdog_log(spark, sf_dir), alert=2010)


@register("top_messages_per_type")
def _top_messages_per_type(spark, sf_dir):
    return watchdog.top_messages_per_type(watchdog_log(spark, sf_dir), alert=240)


@register("top_not_found")
def _top_not_found(spark, sf_dir):
    return watchdog.top_not_found(watchdog_log(spark, sf_dir), alert=51)


@register("recent_cron")
def _recent_cron(spark, sf_dir):
    return watchdog.recent_cron(watchdog_log(spark, sf_dir), 40)


@register("module_changes")
def _module_changes(spark, sf_dir):
    return watchdog.module_changes(watchdog_log(spark, sf_dir), EVENTS_TODAY)


@register("newest_files")
def _newest_files(spark, sf_dir):
    """OP-03 with OP-26: the watchdog log kept as rotated files, one gzip file per day
    (modification time = end of its day, set through the file system like ``touch``);
    the 5 newest files are read and scanned for module enable/disable lines."""
    out = shared_dir(spark, "rotated")
    lines = fx.watchdog_lines(spark, sf_dir, "pipe").join(
        fx.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.to_date("ts").alias("day")), "seq")
    # one file per day, as log rotation writes them (a day is one task's input)
    (lines.repartition("day").sortWithinPartitions("seq").select("day", "value")
     .write.partitionBy("day").option("compression", "gzip").text(out))
    fs_touch_days(spark, out)
    paths = src_lines.newest_files(spark, out + "/day=*/*.txt.gz", 5)
    df = src_lines.read_lines(spark, paths)
    return watchdog.module_changes(parse_watchdog(df), EVENTS_TODAY).select("head", "message", "flag_today",
                                                                          "flag_costly")


def fs_touch_days(spark, root: str) -> None:
    """Set each ``day=YYYY-MM-DD`` file's modification time to the end of that day
    (metadata only; one call per file, the number of files is the number of days)."""
    import datetime as dt

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    for st in fs.listStatus(base):
        name = st.getPath().getName()
        if not name.startswith("day="):
            continue
        day = dt.datetime.strptime(name[4:], "%Y-%m-%d").replace(tzinfo=dt.timezone.utc)
        mtime = int((day + dt.timedelta(days=1)).timestamp() * 1000) - 1
        for f in fs.listStatus(st.getPath()):
            fs.setTimes(f.getPath(), mtime, -1)


# ------------------------------------------------------------------ rotated files, read as text

def _rotated(spark, lines: DataFrame, name: str) -> DataFrame:
    """A log kept as rotated text files - the older ones hold a quarter of the lines, so the
    newer ones are larger - written with their own times and read back by ``read_lines``."""
    base = shared_dir(spark, name)
    quarter = lines.select(F.percentile_approx("seq", 0.25, 1000)).scalar()
    parts = [lines.filter(F.col("seq") <= quarter), lines.filter(F.col("seq") > quarter)]
    for i, part in enumerate(parts):
        # range partitions in line order: one file each, named in that order
        part.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(f"{base}/{1 - i}")
    touch_in_order(spark, [f"{base}/1", f"{base}/0"])
    return src_lines.read_lines(spark, [f"{base}/0", f"{base}/1"])


def touch_in_order(spark, folders: list[str]) -> None:
    """Give the files of these folders rising modification times, in the order of folders and
    names (metadata only, one call per file)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    time = 1_700_000_000_000
    for folder in folders:
        base = jvm.org.apache.hadoop.fs.Path(folder)
        fs = base.getFileSystem(conf)
        for st in sorted(fs.listStatus(base), key=lambda f: f.getPath().getName()):
            time += 1000
            fs.setTimes(st.getPath(), time, -1)


@register()
def latest_matching_files(spark, sf_dir):
    """``latest_matching`` over rotated text files, of which the newer are the larger."""
    lines = _rotated(spark, fx.access_lines(spark, sf_dir), "rotated-access")
    return traffic.latest_matching(parse_access(lines), "GET /cron.php", 5).select("value")


@register()
def top_slow_files(spark, sf_dir):
    """``top_slow`` with first and last times over rotated text files."""
    return traffic.top_slow(parse_access(_rotated(spark, fx.access_lines(spark, sf_dir), "rotated-slow")), "site1")


@register()
def recent_cron_files(spark, sf_dir):
    """``recent_cron`` over rotated text files; their layout is found from their first lines."""
    log = parse_watchdog(_rotated(spark, fx.watchdog_lines(spark, sf_dir, "semicolon"), "rotated-cron"))
    return watchdog.recent_cron(log, 40).drop("seq")


@register()
def mixed_layouts(spark, sf_dir):
    """Watchdog files of either layout, told apart per file: the ``|`` and the ``; `` one of the same log."""
    both = [fx.watchdog_lines(spark, sf_dir, layout).withColumn("file", F.lit(layout)) for layout in ("pipe", "semicolon")]
    parsed = parse_watchdog(both[0].unionByName(both[1]))
    return parsed.select("file", "seq", "head", "type", "uri", "message")


# ------------------------------------------------------------------ fleet logs

@register("mail_per_day")
def _mail_per_day(spark, sf_dir):
    return fleetlog.mail_per_day(fx.mail_lines(spark, sf_dir))


@register("syslog_events")
def _syslog_events(spark, sf_dir):
    return fleetlog.syslog_events(fx.syslog_lines(spark, sf_dir), EVENTS_NOW, exclude=[SPLIT_BRAIN_NOISE], n=100)


@register("literal_events")
def _literal_events(spark, sf_dir):
    return fleetlog.literal_events(fx.syslog_lines(spark, sf_dir, "daemon.log"), EVENTS_NOW)


@register("skip_spawns")
def _skip_spawns(spark, sf_dir):
    return fleetlog.skip_spawns(fx.pool_lines(spark, sf_dir), "fpm")


@register("skip_spawns_webserver")
def _skip_spawns_webserver(spark, sf_dir):
    return fleetlog.skip_spawns(fx.webserver_error_lines(spark, sf_dir), "webserver")


@register("count_literal_by_host")
def _count_literal_by_host(spark, sf_dir):
    return fleetlog.count_literal_by_host(fx.pool_lines(spark, sf_dir), fx.log_hosts(spark, sf_dir), "SIGSEGV")


@register("downtime_events")
def _downtime_events(spark, sf_dir):
    return fleetlog.downtime_events(fx.downtime_pages(spark, sf_dir), EVENTS_TODAY)


@register("flag_tasks")
def _flag_tasks(spark, sf_dir):
    return fleetlog.flag_tasks(fx.tasks(spark, sf_dir), EVENTS_NOW).drop("ts")


@register("audit_errors")
def _audit_errors(spark, sf_dir):
    return fleetlog.audit_errors(fx.audit_lines(spark, sf_dir))


@register("external_connections")
def _external_connections(spark, sf_dir):
    return fleetlog.external_connections(fx.sockets(spark, sf_dir), fx.log_hosts(spark, sf_dir))


@register("session_status")
def _session_status(spark, sf_dir):
    return fleetlog.session_status(fx.header_traces(spark, sf_dir))


@register("expand_urls")
def _expand_urls(spark, sf_dir):
    ok = fx.domain_rows(spark, sf_dir).filter(F.col("status").contains("ok") & ~F.col("domain").contains("*"))
    return fleetlog.expand_urls(ok.select("domain").distinct())


# ------------------------------------------------------------------ fleet tables

@register("threshold_flag")
def _threshold_flag(spark, sf_dir):
    return common.threshold_flag(fx.hosts(spark, sf_dir), "metric", hi=1000.0, hi_strict=True, keep_only=True)


@register("low_disk_space")
def _low_disk_space(spark, sf_dir):
    return fleetlog.low_disk_space(fx.disk_lines(spark, sf_dir))


@register("busy_cpu")
def _busy_cpu(spark, sf_dir):
    return fleetlog.busy_cpu(fx.cpu_lines(spark, sf_dir))


@register("connection_limits")
def _connection_limits(spark, sf_dir):
    return fleetlog.connection_limits(fx.connection_lines(spark, sf_dir))


@register("memory_limits")
def _memory_limits(spark, sf_dir):
    return fleetlog.memory_limits(fx.memory_lines(spark, sf_dir))


@register("drift")
def _drift(spark, sf_dir):
    return fleet.drift(fx.hosts(spark, sf_dir))


@register("version_drift")
def _version_drift(spark, sf_dir):
    return fleet.version_drift(fx.host_versions(spark, sf_dir))


@register("flat_capacity")
def _flat_capacity(spark, sf_dir):
    return fleet.flat_capacity(fx.server_capacity(spark, sf_dir))


@register("process_capacity")
def _process_capacity(spark, sf_dir):
    return fleet.process_capacity(fx.section_lines(spark, sf_dir), "site1")


@register("resolve_sections")
def _resolve_sections(spark, sf_dir):
    return fleet.resolve_sections(fx.realm_lines(spark, sf_dir), fx.realm_labels(spark))


@register("passive_or_active")
def _passive_or_active(spark, sf_dir):
    return fleet.passive_or_active(fx.db_listing(spark, sf_dir))


@register("select_hosts")
def _select_hosts(spark, sf_dir):
    return fleet.select_hosts(fx.host_listing(spark, sf_dir))


@register("select_hosts_raw")
def _select_hosts_raw(spark, sf_dir):
    return fleet.select_hosts(fx.host_listing(spark, sf_dir), include_marked=True)


@register("active_balancers")
def _active_balancers(spark, sf_dir):
    return fleet.active_balancers(fx.host_listing(spark, sf_dir))


@register("preview")
def _preview(spark, sf_dir):
    domains = fx.domain_rows(spark, sf_dir).select("domain").distinct()
    return common.preview(domains, 15, ["domain"])


@register("domain_status")
def _domain_status(spark, sf_dir):
    return fleet.domain_status(fx.domain_rows(spark, sf_dir))


@register("match_lists")
def _match_lists(spark, sf_dir):
    return fleet.match_lists(fx.enabled_modules(spark, sf_dir), fx.module_lists(spark))


@register("count_over")
def _count_over(spark, sf_dir):
    return fleet.count_over(fx.enabled_modules(spark, sf_dir))


@register("update_status")
def _update_status(spark, sf_dir):
    return fleet.update_status(fx.update_rows(spark, sf_dir))


@register("cache_audit")
def _cache_audit(spark, sf_dir):
    return fleet.cache_audit(fx.cache_audit_lines(spark, sf_dir))


@register("flag_overrides")
def _flag_overrides(spark, sf_dir):
    return fleet.flag_overrides(fx.ini_lines(spark, sf_dir))


@register("block_cache")
def _block_cache(spark, sf_dir):
    return fleet.block_cache(fx.block_rows(spark, sf_dir))


@register("classify_version")
def _classify_version(spark, sf_dir):
    return fleet.classify_version(fx.version_rows(spark, sf_dir))


@register("storage_by_engine")
def _storage_by_engine(spark, sf_dir):
    return fleet.storage_by_engine(fx.storage_tables(spark, sf_dir))


@register("largest_tables")
def _largest_tables(spark, sf_dir):
    return fleet.largest_tables(fx.storage_tables(spark, sf_dir), big_bytes=1_248_000_000, big_rows=228)


@register("large_payloads")
def _large_payloads(spark, sf_dir):
    return fleet.large_payloads(fx.variables(spark, sf_dir), PAYLOAD_TEST_LIMIT)


@register("variable_stats")
def _variable_stats(spark, sf_dir):
    return fleet.variable_stats(fx.variables(spark, sf_dir))


@register("anonymous_sessions")
def _anonymous_sessions(spark, sf_dir):
    return fleet.anonymous_sessions(fx.sessions(spark, sf_dir))


@register("flush_ages")
def _flush_ages(spark, sf_dir):
    return fleet.flush_ages(fx.flush_lines(spark, sf_dir), EVENTS_NOW)


@register("duplicate_modules")
def _duplicate_modules(spark, sf_dir):
    return fleet.duplicate_modules(fx.module_paths(spark, sf_dir), fx.system_table(spark, sf_dir))


# ------------------------------------------------------------------ review queue

def _pr_cols(df: DataFrame) -> DataFrame:
    return df.select("repo", "number", "title", F.col("pull_request.html_url").alias("html_url"))


@register("pull_requests")
def _pull_requests(spark, sf_dir):
    return _pr_cols(review.pull_requests(fx.issues(spark, sf_dir)))


@register("open_issues")
def _open_issues(spark, sf_dir):
    return review.open_issues(fx.issues(spark, sf_dir)).select("repo", "number", "title")


@register("recent")
def _recent(spark, sf_dir):
    return _pr_cols(review.recent(review.pull_requests(fx.issues(spark, sf_dir)), REVIEW_SINCE))


@register("review_state")
def _review_state(spark, sf_dir):
    return review.review_state(fx.requested_reviewers(spark, sf_dir), fx.reviews(spark, sf_dir))


@register("review_state_exact")
def _review_state_exact(spark, sf_dir):
    return review.review_state(fx.requested_reviewers(spark, sf_dir), fx.reviews(spark, sf_dir))


@register("review_state_fast")
def _review_state_fast(spark, sf_dir):
    return review.review_state(fx.requested_reviewers(spark, sf_dir), fx.reviews(spark, sf_dir, in_order=True), in_order=True)


def _states(spark, sf_dir):
    return review.review_state(fx.requested_reviewers(spark, sf_dir), fx.reviews(spark, sf_dir))


@register("not_approved_by")
def _not_approved_by(spark, sf_dir):
    prs = review.pull_requests(fx.issues(spark, sf_dir))
    return _pr_cols(review.not_approved_by(prs, _states(spark, sf_dir), REVIEWER))


@register("below_min_approvals")
def _below_min_approvals(spark, sf_dir):
    prs = review.pull_requests(fx.issues(spark, sf_dir))
    return _pr_cols(review.below_min_approvals(prs, _states(spark, sf_dir), 3))


@register("reviewer_summary")
def _reviewer_summary(spark, sf_dir):
    prs = review.pull_requests(fx.issues(spark, sf_dir))
    return review.reviewer_summary(prs, _states(spark, sf_dir))


@register("review_queue")
def _review_queue(spark, sf_dir):
    return review.review_queue(fx.issues(spark, sf_dir), fx.requested_reviewers(spark, sf_dir),
                               fx.reviews(spark, sf_dir), since=REVIEW_SINCE, me=REVIEWER, min_approvals=3)


@register("nearest_color")
def _nearest_color(spark, sf_dir):
    labels = fx.issues(spark, sf_dir).select("repo", "number", F.explode("labels").alias("label"))
    return review.nearest_color(labels.select("repo", "number", "label.name", "label.color"))


@register("outdated")
def _outdated(spark, sf_dir):
    return review.outdated(fx.commits(spark, sf_dir), ORDERS_NOW)


# ------------------------------------------------------------------ streaming

def _replay(spark, lines: DataFrame, name: str):
    """Write rendered lines as 8 time-ordered text files for a stream replay; returns
    (folder, base, flush) where ``flush(day)`` appends one line of another site
    dated ``day`` (it only moves event time)."""
    base = shared_dir(spark, name)
    src = base + "/in"
    lines.repartitionByRange(8, "seq").select("value").write.text(src)

    def flush(day: str) -> None:
        spark.range(1).select(F.format_string(
            '10.0.0.1 - - [%s +0000] "GET / HTTP/1.1" 200 100 "-" "-" hosting_site=__flush__ request_time=1 '
            'request_id="flush"', F.date_format(F.lit(day).cast("timestamp_ntz"), "dd/MMM/yyyy:HH:mm:ss"))
            .alias("value")).write.mode("append").text(src)

    return src, base, flush


def _windowed_replay(spark, lines, name, build):
    from ..streaming import live

    src, base, flush = _replay(spark, lines, name)
    query = build(live.read_line_stream(spark, src))
    flush("2100-01-01 00:00:00")
    out = live.run_bounded(query, base)
    # a bounded run ends without the closing no-data batch: one more line in a
    # second run evicts the windows the first run's final watermark closed
    flush("2100-01-02 00:00:00")
    live.run_bounded(query, base)
    return spark.read.parquet(out)


@register("hourly_traffic_stream")
def _hourly_traffic_stream(spark, sf_dir):
    """F1 written as 8 text files (contiguous time ranges), replayed as a stream with
    hourly windows emitted in append mode under a one-hour watermark.  One more file
    holds a line dated far after the data (another site, so it is filtered out); it
    moves the watermark past every real window, the usual way to flush a bounded
    replay; a second bounded run on the same checkpoint emits them."""
    from ..streaming import live

    return _windowed_replay(spark, fx.access_lines(spark, sf_dir), "stream-hourly",
                            lambda s: live.hourly_traffic_stream(s, "site1"))


@register("ten_minute_times_stream")
def _ten_minute_times_stream(spark, sf_dir):
    """F1 replayed as a stream; ten-minute windows (append mode, watermark).  The
    flush lines fall in windows of the year 2100, which are left out of the result."""
    from ..streaming import live

    df = _windowed_replay(spark, fx.access_lines(spark, sf_dir), "stream-tenmin",
                          lambda s: live.ten_minute_times_stream(s, F.expr("request_us div 10"), F.col("request_us")))
    return df.filter(F.col("bucket") < F.lit("2099-01-01").cast("timestamp_ntz"))


@register("top_errors_stream")
def _top_errors_stream(spark, sf_dir):
    """F2 replayed as a stream; message counts kept in complete mode and rewritten
    to parquet each micro-batch; the top 5 are read from that table."""
    from ..operators.common import top_counts
    from ..streaming import live

    base = shared_dir(spark, "stream-errors")
    src = base + "/in"
    fx.php_error_lines(spark, sf_dir).repartitionByRange(4, "seq").select("value").write.text(src)
    out = base + "/counts"
    q = live.start_complete_to_files(live.error_counts_stream(live.read_line_stream(spark, src)), out,
                                     base + "/checkpoint")
    q.awaitTermination()
    counts = spark.read.parquet(out)
    return (counts.orderBy(F.desc("n"), F.desc("message")).limit(5)
            .withColumn("flag_fatal", F.col("message").contains(traffic.FATAL_MARKER)))


@contextmanager
def _conf(spark: SparkSession, settings: dict[str, str]):
    """The session with these settings, which are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _segments(spark, lines: DataFrame, folder: str, schema: str, n: int = 4) -> None:
    """Lines as stored segments in line order (rising file times), and two later segments of another file,
    which only move event time and so end the idle files."""
    names = schema_columns(schema)
    lines.repartitionByRange(n, "seq").sortWithinPartitions("seq").select(*names).write.parquet(f"{folder}/lines")
    for i, day in enumerate(("2100-01-01", "2100-01-02")):
        end = spark.range(1).select(F.lit("__end__").alias("file"), F.lit(i).cast("long").alias("seq"), F.lit("").alias("value"),
                                    F.lit(day).cast("timestamp").alias("event_time"))
        end.select(*names).write.parquet(f"{folder}/end{i}")
    touch_in_order(spark, [f"{folder}/lines", f"{folder}/end0", f"{folder}/end1"])


def schema_columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


SEGMENT = "file string, seq long, value string, event_time timestamp"


def _live(spark, sf_dir, lines: DataFrame, name: str, build) -> DataFrame:
    """Replay lines, timed by their event, in micro-batches of one segment; two runs on one checkpoint."""
    from ..streaming import carry, live

    base = shared_dir(spark, name)
    timed = lines.join(fx.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_time")), "seq")
    with _conf(spark, carry.STATE_CONF):
        _segments(spark, timed, base + "/in", SEGMENT)
        for folders in ("{lines,end0}", "{lines,end0,end1}"):
            out = live.run_bounded(build(carry.read_segments(spark, f"{base}/in/{folders}", SEGMENT, late="1 hour")), base)
    return spark.read.parquet(out)


@register()
def process_capacity_stream(spark, sf_dir):
    """``process_capacity`` live: keyed state in small micro-batches, continued from its checkpoint."""
    from ..streaming import carry

    return _live(spark, sf_dir, fx.section_lines(spark, sf_dir), "live-procs", lambda s: carry.process_capacity_stream(s, "site1"))


@register()
def resolve_sections_stream(spark, sf_dir):
    """``resolve_sections`` live: the last header and the last site row are the state."""
    from ..streaming import carry

    return _live(spark, sf_dir, fx.realm_lines(spark, sf_dir), "live-realms", lambda s: carry.resolve_sections_stream(s, fx.realm_labels(spark)))


@register()
def cache_audit_stream(spark, sf_dir):
    """``cache_audit`` live: whether a problem is still to be shown is the state."""
    from ..streaming import carry

    return _live(spark, sf_dir, fx.cache_audit_lines(spark, sf_dir), "live-audit", carry.cache_audit_stream).filter("file != '__end__'")


@register()
def oom_paths_stream(spark, sf_dir):
    """``oom_paths`` live: both logs replayed side by side, joined within ten minutes under watermarks."""
    from ..streaming import correlate, live

    base = shared_dir(spark, "live-oom")
    for name, lines in (("access", fx.access_lines(spark, sf_dir)), ("errors", fx.php_error_lines(spark, sf_dir))):
        lines.repartitionByRange(4, "seq").sortWithinPartitions("seq").select("value").write.text(f"{base}/{name}")
        touch_in_order(spark, [f"{base}/{name}"])
    access_, errors = (live.read_line_stream(spark, f"{base}/{name}", max_files_per_trigger=1) for name in ("access", "errors"))
    hits = spark.read.parquet(live.run_bounded(correlate.oom_hits_stream(errors, access_, late="1 day"), base))
    return common.top_counts(hits, ["method", "path", "protocol", "status"], 10)
