"""Render the driver's tables into the log lines and audit tables the reports read.

The reference ships no sample logs, so test inputs are derived - deterministically and
by Spark, so their size follows the tables - from ``events``, ``supplier``,
``lineitem``, ``part``, ``pages``, ``documents``, ``orders``, ``nation`` and
``region``.  The DuckDB oracles compute the expected answers from the same raw
columns *without* going through text, so a parser bug shows up as a mismatch.
The rules are listed in FIXTURES.md; they are repeated here as code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` plus ``k`` = ``props.k`` as int."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def K() -> Column:
    return F.col("k")


def EID() -> Column:
    return F.col("event_id")


def UID() -> Column:
    return F.col("user_id")

# ---------------------------------------------------------------- F1 access log

LONG_PREFIX = "/files/" + "long-segment-" * 5


def access_columns(ev: DataFrame) -> DataFrame:
    """The F1 fields as columns (shared by the access, watchdog and review fixtures)."""
    path = (F.when(EID() % 97 == 0, F.lit("/cron.php"))
            .when(K() % 10 == 0, F.concat(F.lit("/list?page="), _s(F.expr("k div 10"))))
            .when(K() % 10 == 1, F.concat(F.lit(LONG_PREFIX), _s(K())))
            .otherwise(F.concat(F.lit("/node/"), _s(UID() % 40))))
    is_err = F.col("event_type") == "error"
    status = (F.when(is_err & (K() == 99), 511)
              .when(is_err & (K() % 4 == 0), 404)
              .when(is_err & (K() % 4 == 1), 403)
              .when(is_err, F.lit(500) + K() % 4)
              .when(K() % 7 == 0, 304)
              .otherwise(200))
    ua = (F.when(UID() % 4 == 0, "Mozilla/5.0").when(UID() % 4 == 1, "curl/8.0")
          .when(UID() % 4 == 2, "Drupal (+http://example.org/)").otherwise("bot/1.0"))
    rid = F.concat(F.when(EID() % 10 == 9, "x-").otherwise("v-"), _s(EID()))
    return ev.select(
        "*",
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("a_method"),
        path.alias("a_path"),
        status.alias("a_status"),
        F.round(F.col("value") * 20000).cast("long").alias("a_us"),
        F.concat(F.lit("site"), _s(UID() % 3)).alias("a_site"),
        ua.alias("a_ua"),
        rid.alias("a_rid"),
    )


def _render_access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, seq, value)``, one access-log line per event, line order = event_id."""
    a = access_columns(events(spark, sf_dir))
    line = F.format_string(
        '10.0.0.%d - - [%s +0000] "%s %s HTTP/1.1" %d 100 "-" "%s" hosting_site=%s request_time=%d request_id="%s"',
        UID(), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.col("a_method"), F.col("a_path"),
        F.col("a_status"), F.col("a_ua"), F.col("a_site"), F.col("a_us"), F.col("a_rid"))
    return a.select(F.lit("access.log").alias("file"), EID().alias("seq"), line.alias("value"),
                    F.col("a_site").alias("log_site"))


# ---------------------------------------------------------------- F2 PHP errors

def _render_php_error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one PHP error line per ``error`` event."""
    a = access_columns(events(spark, sf_dir)).filter(F.col("event_type") == "error")
    f = F.concat(F.lit("/app/f"), _s(K() % 5), F.lit(".php"))
    msg = (F.when(K() % 3 == 0, F.concat(
        F.lit("PHP Fatal error:  Allowed memory size of 134217728 bytes exhausted (tried to allocate "),
        _s(EID()), F.lit(" bytes) in "), f))
        .when(K() % 3 == 1, F.concat(F.lit("PHP Warning:  Division by zero in "), f))
        .otherwise(F.lit("PHP Notice:  Undefined index")))
    line = F.format_string('[%s UTC] %s request_id="%s"', F.date_format("ts", "dd-MMM-yyyy HH:mm:ss"), msg,
                           F.col("a_rid"))
    return a.select(F.lit("php-errors.log").alias("file"), EID().alias("seq"), line.alias("value"))


# ---------------------------------------------------------------- F3 watchdog

WATCHDOG_TYPES = {"view": "page not found", "click": "php", "signup": "user", "purchase": "cron", "error": "search"}


def watchdog_columns(ev: DataFrame) -> DataFrame:
    a = access_columns(ev)
    wtype = F.lit(None).cast("string")
    for src, dst in WATCHDOG_TYPES.items():
        wtype = F.when(F.col("event_type") == src, dst).otherwise(wtype)
    base = F.concat(F.lit("msg "), _s(K() % 8), F.when(K() % 8 == 3, " exception").otherwise(""))
    msg = (F.when((F.col("event_type") == "signup") & (K() % 10 == 0), F.lit("dblog module enabled."))
           .when((F.col("event_type") == "signup") & (K() % 10 == 5), F.lit("statistics module disabled."))
           .otherwise(base))
    head = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), _s(UID() % 5), F.lit(" "),
                    F.col("a_site"))
    return a.select(
        "*",
        head.alias("w_head"),
        F.concat(F.lit("http://"), F.col("a_site"), F.lit(".example.com")).alias("w_url"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("w_epoch"),
        wtype.alias("w_type"),
        F.concat(msg, F.lit(' request_id="'), F.col("a_rid"), F.lit('"')).alias("w_msg"),
    )


def _render_watchdog_lines(spark: SparkSession, sf_dir: str, layout: str = "pipe") -> DataFrame:
    """F3 in the ``|`` layout or the ``; `` layout (same rows, reordered)."""
    w = watchdog_columns(events(spark, sf_dir))
    ip = F.concat(F.lit("10.0.0."), _s(UID()))
    if layout == "pipe":
        line = F.concat_ws("|", F.concat(F.col("w_head"), F.lit(": "), F.col("w_url")), _s(F.col("w_epoch")),
                           F.col("w_type"), ip, F.col("a_path"), F.lit(""), _s(UID()), F.lit(""), F.col("w_msg"))
    else:
        line = F.concat_ws("; ", F.concat(F.col("w_head"), F.lit(": "), F.col("w_msg")), F.col("w_url"),
                           _s(F.col("w_epoch")), F.col("w_type"), ip, F.col("a_path"), F.lit("-"), _s(UID()))
    return w.select(F.concat(F.lit("drupal-watchdog-"), _s(UID() % 3), F.lit(".log")).alias("file"), EID().alias("seq"), line.alias("value"))


# ---------------------------------------------------------------- F4 host logs

def HOST() -> Column:
    return F.concat(F.lit("web-"), _s(UID() % 5))


def syslog_stamp(ts: str = "ts") -> Column:
    """``MMM _d HH:mm:ss`` (day padded with a blank, as syslog writes it)."""
    return F.concat(F.date_format(ts, "MMM"), F.lit(" "), F.lpad(_s(F.dayofmonth(ts)), 2, " "), F.lit(" "),
                    F.date_format(ts, "HH:mm:ss"))


def _render_mail_lines(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    tail = F.when(F.col("event_type") == "purchase", F.lit("Completed")).otherwise(
        F.concat(F.lit("<= user"), _s(UID()), F.lit("@example.org")))
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), _s(EID()), tail)
    return ev.select(F.concat(HOST(), F.lit("/mainlog")).alias("file"), HOST().alias("host"), EID().alias("seq"),
                     line.alias("value"))


def _render_syslog_lines(spark, sf_dir, name: str = "syslog") -> DataFrame:
    ev = events(spark, sf_dir)
    text = (F.when(K() % 5 == 0, F.concat(F.lit("kernel: Out of memory: Kill process "), _s(EID()),
                                        F.lit(" (php) score 900")))
            .when(K() % 5 == 1, F.concat(F.lit("kernel: Killed process "), _s(EID()), F.lit(" (php-fpm) total-vm:2048kB")))
            .when(K() % 5 == 2, F.lit("puppet-agent: Restarting php-fpm service"))
            .when((K() % 5 == 3) & (K() % 2 == 0), F.lit("hostwatch: AH_SPLIT_BRAIN: Split brain detected: db=main"))
            .when(K() % 5 == 3, F.lit("hostwatch: AH_SERIOUS_ load above limit"))
            .otherwise(F.lit("cron: session idle")))
    line = F.concat_ws(" ", syslog_stamp(), HOST(), text)
    return ev.select(F.concat(HOST(), F.lit("/" + name)).alias("file"), HOST().alias("host"), EID().alias("seq"),
                     line.alias("value"))


def _render_pool_lines(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    text = (F.when(K() % 4 == 0, F.lit("WARNING: [pool www] seems busy (you may need to increase pm.start_servers, "
                                     "or pm.min/max_spare_servers), spawning 8 children, there are 0 idle, "
                                     "and 10 total children"))
            .when(K() % 4 == 1, F.lit("WARNING: [pool www] server reached max_children setting (10), consider raising it"))
            .when(K() % 4 == 2, F.concat(F.lit("WARNING: [pool www] child "), _s(EID()),
                                       F.lit(" exited on signal 11 (SIGSEGV) after 2.5 seconds from start")))
            .otherwise(F.concat(F.lit("NOTICE: [pool www] child "), _s(EID()), F.lit(" started"))))
    line = F.concat(F.lit("["), F.date_format("ts", "dd-MMM-yyyy HH:mm:ss"), F.lit("] "), text)
    return ev.select(F.concat(HOST(), F.lit("/fpm-error.log")).alias("file"), HOST().alias("host"), EID().alias("seq"),
                     line.alias("value"))


def _render_webserver_error_lines(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    client = F.concat(F.lit("[client 10.0.0."), _s(UID()), F.lit("] "))
    text = F.when(K() % 3 == 0, F.concat(F.lit("[error] "), client,
                                       F.lit("mod_fcgid: can't apply process slot for /app/index.php, "
                                             "skip the spawn request"))) \
        .otherwise(F.concat(F.lit("[notice] "), client, F.lit("child pid "), _s(EID()), F.lit(" exit signal")))
    line = F.concat(F.lit("["), F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy"), F.lit("] "), text)
    return ev.select(F.concat(HOST(), F.lit("/error.log")).alias("file"), HOST().alias("host"), EID().alias("seq"),
                     line.alias("value"))


SOCKET_PORTS = [3306, 11211, 443, 80, 8080]


def _render_sockets(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    port = F.element_at(F.array(*[F.lit(p) for p in SOCKET_PORTS]), (K() % 5 + 1).cast("int"))
    return ev.select(HOST().alias("host"), EID().alias("seq"),
                     F.when(K() % 3 == 0, "nginx").otherwise("php-fpm").alias("process"),
                     F.when(K() % 2 == 0, "TCP").otherwise("UDP").alias("protocol"),
                     port.alias("port"))


TASK_TEXTS = ["code-push to Prod", "db-migrate site", "reboot web", "cache clear", "commit deployed", "file copy"]


def _render_tasks(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    text = F.element_at(F.array(*[F.lit(t) for t in TASK_TEXTS]), (K() % 6 + 1).cast("int"))
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), HOST(), text)
    return ev.select("ts", HOST().alias("host"), EID().alias("seq"), line.alias("value"))


def _render_audit_lines(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    err = F.concat(F.lit("\x1b[31m[error]\x1b[0m Module "), _s(K()), F.lit(" check failed   "),
                   F.when(K() % 2 == 0, "\r").otherwise(""))
    ok = F.concat(F.lit("[ok] Module "), _s(K()), F.lit(" check passed"))
    return ev.select(HOST().alias("host"), EID().alias("seq"),
                     F.when(F.col("event_type") == "error", err).otherwise(ok).alias("value"))


def log_hosts(spark, sf_dir) -> DataFrame:
    """Host list for per-host checks: ``web-`` + s_suppkey % 7 (two of them log nothing)."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("web-"), _s(F.col("s_suppkey") % 7)).alias("host")).distinct()


# ---------------------------------------------------------------- F5 fleet tables

HOST_ROLES = ["web", "db", "bal", "ded"]


def _render_hosts(spark, sf_dir) -> DataFrame:
    """One row per supplier; ``folders`` = distinct parts it ships in lineitem."""
    s = table(spark, sf_dir, "supplier")
    li = table(spark, sf_dir, "lineitem")
    folders = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count_distinct("l_partkey").alias("folders"))
    role = F.element_at(F.array(*[F.lit(r) for r in HOST_ROLES]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return (s.join(folders, "s_suppkey", "left")
            .select(F.concat(F.lit("web-"), _s(F.col("s_suppkey"))).alias("host"), role.alias("role"),
                    F.col("s_acctbal").alias("metric"), F.coalesce("folders", F.lit(0)).alias("folders"),
                    F.col("s_suppkey").alias("seq")))


def _render_server_capacity(spark, sf_dir) -> DataFrame:
    """One row per supplier server: pool limit, running processes (its lineitems of
    open orders, mod 25), memory."""
    s = table(spark, sf_dir, "supplier")
    li = table(spark, sf_dir, "lineitem")
    running = li.filter(F.col("l_linestatus") == "O").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("n"))
    sk = F.col("s_suppkey")
    return (s.join(running, "s_suppkey", "left")
            .select(F.concat(F.lit("web-"), _s(sk)).alias("server"), (sk % 20 + 1).alias("max_procs"),
                    (F.coalesce("n", F.lit(0)) % 25).alias("running"), F.lit(4096).cast("long").alias("total_mem"),
                    F.round(F.abs(F.col("s_acctbal")) / 2.5).cast("long").alias("free_mem")))


def host_versions(spark, sf_dir) -> DataFrame:
    """Release version per host: ``1.<folders mod 3>`` (the hosts table's folder count)."""
    return hosts(spark, sf_dir).select("host", F.concat(F.lit("1."), _s(F.col("folders") % 3)).alias("version"))


def _render_stats_rows(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    return (ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"),
                       F.concat(F.lit("site"), _s(UID() % 3)).alias("site"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("uncached"))
            .select("day", "site", F.lit("hits").alias("c3"), "total", "uncached"))


def _render_section_lines(spark, sf_dir) -> DataFrame:
    """Process listing: ``[srv-N]`` header every 20 events (names repeat), then user rows
    (some with fractions), counts (missing in every 5th section), limits, memory and a
    defunct row."""
    ev = events(spark, sf_dir)
    r = EID() % 20
    site = F.concat(F.lit("site"), _s(UID() % 3))
    section = F.expr("event_id div 20")
    used = F.when(K() % 6 == 0, F.lit("0.7")).otherwise(_s(K() % 3))
    line = (F.when(r == 0, F.concat(F.lit("[srv-"), _s(section % 40), F.lit("]")))
            .when(r <= 14, F.concat_ws(" ", site, used, F.lit("php-cgi")))
            .when((r == 15) & (section % 5 == 0), F.lit("nothing to count"))
            .when(r == 15, F.concat(_s(K()), F.lit(" procs running")))
            .when(r == 16, F.concat(F.lit("MaxProcessCount "), _s(K() + 20)))
            .when(r == 17, F.concat(F.lit("DefaultMaxClass "), _s(K() % 10)))
            .when(r == 18, F.concat_ws(" ", F.lit("Mem:"), _s(K() * 10 + 4000), _s(UID() * 10),
                                       _s(F.round(F.col("value") * 10).cast("long"))))
            .otherwise(F.concat(F.lit("zombie "), _s(K()), F.lit(" defunct"))))
    return ev.select(F.lit("procs.txt").alias("file"), EID().alias("seq"), line.alias("value"))


REALM_LABELS = ["Enterprise", "Standard", "Network", "Gardens", "Legacy"]
REALM_CODES = {"Enterprise": "ent", "Standard": "std", "Network": "net", "Gardens": "gdn"}


def _render_realm_lines(spark, sf_dir) -> DataFrame:
    """Domain lookup listing: ``[<label>]:`` header every 10 events, then `` <site>.<env> <k>``."""
    ev = events(spark, sf_dir)
    label = F.element_at(F.array(*[F.lit(x) for x in REALM_LABELS]),
                         (F.expr("event_id div 10") % len(REALM_LABELS) + 1).cast("int"))
    env = F.when(K() % 2 == 0, "prod").otherwise("test")
    line = F.when(EID() % 10 == 0, F.concat(F.lit("["), label, F.lit("]:"))).otherwise(
        F.concat(F.lit(" site"), _s(UID() % 3), F.lit("."), env, F.lit(" "), _s(K())))
    return ev.select(F.concat(F.lit("realms-"), _s(F.expr("event_id div 1000"))).alias("file"), EID().alias("seq"), line.alias("value"))


def realm_labels(spark) -> DataFrame:
    return spark.createDataFrame(sorted(REALM_CODES.items()), "label string, code string")


def _render_db_listing(spark, sf_dir) -> DataFrame:
    """Per nation one listing of database hosts; every 10th supplier is the active one."""
    s = table(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    line = (F.when(sk % 9 == 0, F.concat(F.lit("  (standby pool) "), _s(sk)))
            .otherwise(F.concat(F.lit("db-"), _s(sk), F.lit(" "),
                                F.when(sk % 10 == 3, "active-db").otherwise("db"))))
    return s.select(F.concat(F.lit("nation-"), _s(F.col("s_nationkey"))).alias("file"), sk.alias("seq"),
                    line.alias("value"))


HOST_PREFIXES = ["srv", "web", "ded", "staging", "managed", "bal", "db"]


def _render_host_listing(spark, sf_dir) -> DataFrame:
    """Application server listing: ``<prefix>-<suppkey> <state> <n>``, out-of-rotation rows marked ``*``."""
    s = table(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    prefix = F.element_at(F.array(*[F.lit(p) for p in HOST_PREFIXES]), (sk % 7 + 1).cast("int"))
    line = F.concat(F.lit(" "), prefix, F.lit("-"), _s(sk), F.lit(" "), F.when(sk % 2 == 0, "up").otherwise("idle"),
                    F.lit(" "), _s(sk % 3), F.when(sk % 11 == 0, " *").otherwise(""))
    return s.select(F.concat(F.lit("servers-"), _s(F.col("s_nationkey"))).alias("file"), sk.alias("seq"), line.alias("value"))


def url_host(col: str = "url") -> Column:
    return F.regexp_extract(col, r"^[a-z]+://([^/?#]+)", 1)


def header_traces(spark, sf_dir) -> DataFrame:
    """One captured fetch per page: domain, curl exit code, response header lines."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    hdrs = F.array_compact(F.array(
        F.lit("> GET / HTTP/1.1"),
        F.when(pid % 3 == 0, "< HTTP/1.1 301 Moved Permanently").otherwise("< HTTP/1.1 200 OK"),
        F.when(pid % 5 == 0, F.concat(F.lit("< Set-Cookie: SESS"), _s(pid), F.lit("=abc; path=/"))),
        F.when(pid % 3 == 0, F.concat(F.lit("< Location: https://"), url_host(), F.lit("/"))),
        F.when(pid % 6 == 0, F.lit("< Location: https://example.org/second")),
        F.when(pid % 4 == 0, F.lit("* Location: not a header")),
        F.lit("< Cache-Control: no-cache"),
    ))
    return p.select(url_host().alias("domain"), pid.alias("seq"),
                    F.when(pid % 13 == 0, 28).otherwise(0).alias("exit"), hdrs.alias("headers"))


def _render_storage_tables(spark, sf_dir) -> DataFrame:
    """Table catalog: one table per (return flag, supplier); sizes in integer bytes."""
    li = table(spark, sf_dir, "lineitem")
    rf = F.col("l_returnflag")
    engine = F.when(rf == "A", "InnoDB").when(rf == "N", "MyISAM")
    return (li.groupBy("l_returnflag", "l_suppkey")
            .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("data"),
                 F.sum(F.round(F.col("l_quantity")).cast("long") * 1024).alias("index"),
                 F.count(F.lit(1)).alias("row_count"))
            .select(F.when(F.col("l_suppkey") % 10 == 0, "mysql").otherwise("site").alias("table_schema"),
                    F.concat(F.lit("t_"), rf, F.lit("_"), _s(F.col("l_suppkey"))).alias("table_name"),
                    engine.alias("engine"), "data", "index", "row_count"))


def variables(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("-"), _s(F.col("doc_id"))).alias("name"),
                    F.col("text").alias("value"))


def _render_sessions(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    sess = F.concat(F.lit("uid|"), _s(EID()), F.lit("|"), F.col("event_type"), F.lit("|"), F.col("props"),
                    F.lit("|"), F.repeat(F.lit("ab"), 40))
    return ev.select((UID() % 3).alias("uid"), F.concat(F.lit("10.0.0."), _s(UID())).alias("hostname"),
                     F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), sess.alias("session"))


def _url_path(col: str = "url") -> Column:
    no_q = F.regexp_replace(col, r"[?#].*$", "")
    return F.regexp_replace(no_q, r"^[a-z]+://[^/]*", "")


def module_paths(spark, sf_dir) -> DataFrame:
    """Module info files found on disk: one per distinct page path."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("sites/all/modules"), _url_path(), F.lit(".info")).alias("path")).distinct()


def system_table(spark, sf_dir) -> DataFrame:
    """Registered extensions: file name with its real suffix, type and status."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    suffix = F.when(pid % 3 == 0, ".module").when(pid % 3 == 1, ".theme").otherwise(".info")
    typ = F.element_at(F.array(F.lit("module"), F.lit("theme"), F.lit("profile"), F.lit("theme_engine")),
                       (pid % 4 + 1).cast("int"))
    return p.select(F.concat(F.lit("sites/all/modules"), _url_path(), suffix).alias("filename"), typ.alias("type"),
                    F.when(pid % 2 == 0, "enabled").otherwise("disabled").alias("status"))


INVENTORY_SCHEMA = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(
    T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("type", T.ArrayType(T.StringType()))])))))


def inventory_json(spark, sf_dir) -> DataFrame:
    """One JSON document per supplier: ``{region: {nation: {zone: {host: {"type": [role, ...]}}}}}``."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    sk = F.col("s_suppkey")
    role = F.element_at(F.array(*[F.lit(x) for x in HOST_ROLES]), (sk % 4 + 1).cast("int"))
    leaf = F.struct(F.array(role, F.lit("managed")).alias("type"))
    doc = F.create_map(F.col("r_name"), F.create_map(F.col("n_name"), F.create_map(
        F.concat(F.lit("zone-"), _s(sk % 3)), F.create_map(F.col("s_name"), leaf))))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(sk.alias("seq"), F.to_json(doc).alias("json")))


def _render_cache_audit_lines(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    texts = ["page_cache_maximum_age  0", "block  cache  0", "Enabled  none", "Enabled  yes",
             "DRUPAL_NO_CACHE  views", "Disabled  foo"]
    line = F.element_at(F.array(*[F.lit(t) for t in texts]), (K() % 6 + 1).cast("int"))
    return ev.select(F.concat(HOST(), F.lit("/cacheaudit")).alias("file"), EID().alias("seq"), line.alias("value"))


def _render_flush_lines(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    line = F.concat(F.lit("cache_flush_"), F.col("event_type"), F.lit("_"), _s(EID()), F.lit(": "),
                    _s(F.unix_seconds(F.col("ts").cast("timestamp"))))
    return ev.select(EID().alias("seq"), line.alias("value"))


# The two module lists of the module check.
INCOMPATIBLE_MODULES = [
    "autoslave", "backup_migrate", "bean_entitycache", "boost", "cas", "civicrm", "db_maintenance", "fbconnect",
    "filecache", "filter_harmonizer", "fupload", "hierarchical_select", "imagefield_crop", "ip_geoloc",
    "mobile_tools", "pubdlcnt", "recaptcha", "role_memory_limit", "session_api", "session_cache", "serial",
    "textsize", "varnish",
]
CAUTION_MODULES = [
    "adaptive_image", "bean", "cdn", "contact_importer", "context_show_regions", "dblog", "ds", "elysia_cron",
    "fivestar", "honeypot", "htmlpurifier", "httprl", "ldap", "ligthbox2", "linkchecker", "menu_minipanels",
    "migrate", "multicron", "performance", "plupload", "poormanscron", "quicktabs", "radioactivity", "robotstxt",
    "search404", "statistics", "supercron", "taxonomy_menu", "tcpdf", "workbench_moderation", "wurfl",
    "wysiwig_ckfinder",
]


def module_lists(spark) -> DataFrame:
    rows = [("Incompatible", m) for m in INCOMPATIBLE_MODULES] + [("Use-with-caution", m) for m in CAUTION_MODULES]
    return spark.createDataFrame(rows, "severity string, name string")


def enabled_modules(spark, sf_dir) -> DataFrame:
    """Enabled module names: every 3rd part names a listed module, the rest a p_name word."""
    p = table(spark, sf_dir, "part")
    listed = F.array(*[F.lit(m) for m in INCOMPATIBLE_MODULES + CAUTION_MODULES])
    n_listed = len(INCOMPATIBLE_MODULES) + len(CAUTION_MODULES)
    pk = F.col("p_partkey")
    name = F.when(pk % 3 == 0, F.element_at(listed, (F.expr("p_partkey div 3") % n_listed + 1).cast("int"))) \
        .otherwise(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)))
    return p.select(name.alias("name")).distinct()


UPDATE_STATES = ["SECURITY UPDATE available", "Update available", "Installed version not supported", "Up to date"]


def update_rows(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select(
        F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit("_"), _s(pk)).alias("name"),
        F.concat(F.lit("7.x-1."), _s(F.col("p_size") % 10)).alias("existing_version"),
        F.concat(F.lit("7.x-1."), _s(F.col("p_size") % 10 + 1)).alias("candidate_version"),
        F.element_at(F.array(*[F.lit(s) for s in UPDATE_STATES]), (pk % 4 + 1).cast("int")).alias("status_msg"))


def ini_lines(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    line = F.when(pk % 5 == 0, F.concat(F.lit("session.gc_probability => "), _s(pk % 3), F.lit(" => 0 (overrides)"))) \
        .otherwise(F.concat(F.lit("session.gc_maxlifetime => "), _s(F.col("p_size") * 100), F.lit(" => "),
                            _s(F.col("p_size") * 100)))
    return p.select(pk.alias("seq"), line.alias("value"))


BLOCK_CACHE_VALUES = ["", "0", "1", "-1", "8", None]


def block_rows(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    cache = F.element_at(F.array(*[F.lit(v).cast("string") for v in BLOCK_CACHE_VALUES]), (pk % 6 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("module"), pk.alias("delta"), cache.alias("cache"),
                    F.col("p_name").alias("info"))


def version_rows(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    product = F.when(pk % 3 == 0, "Pressflow").otherwise("Drupal")
    major = F.when(pk % 2 == 0, 6).otherwise(7)
    return p.select(pk.alias("site_id"),
                    F.concat(product, F.lit(" "), _s(major), F.lit("."), _s(F.col("p_size"))).alias("version"))


def domain_rows(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    status = F.when(pid % 3 == 0, "ok").when(pid % 3 == 1, "not pointing at provider").otherwise("No DNS entry")
    return p.select(url_host().alias("domain"), F.concat(F.lit("10.1.0."), _s(pid % 256)).alias("ip"),
                    status.alias("status"))


def downtime_pages(spark, sf_dir) -> DataFrame:
    """Downtime notices per page, lines broken by ``<br>`` and by newlines."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    body = F.concat(F.lit("Downtime<br>Host\n2024-01-"), F.lpad(_s(pid % 28 + 1), 2, "0"), F.lit(" web-"), _s(pid % 5),
                    F.lit(" down<br>"), url_host(), F.lit(" checked\n2024-01-15 web-"), _s(pid % 3), F.lit(" up"))
    return p.select("page_id", body.alias("html"))


def disk_lines(spark, sf_dir) -> DataFrame:
    """``df -k`` of every supplier host: two disks and a memory file system."""
    s = table(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    free = F.round(F.abs(F.col("s_acctbal")) * 2).cast("long")
    rows = F.array(F.concat_ws(" ", F.lit("Filesystem 1K-blocks Used Available Use% Mounted on")),
                   F.concat(F.lit("/dev/sda1   50000000  49000000 "), _s(free), F.lit("  98% /")),
                   F.concat(F.lit("/dev/sdb1 50000000 1000 "), _s(free * 3), F.lit(" 1% /mnt")), F.lit("tmpfs 100 0 100 0% /run"))
    return s.select(F.concat(F.lit("web-"), _s(sk)).alias("host"), F.posexplode(rows).alias("pos", "value")).select(
        "host", F.col("pos").cast("long").alias("seq"), "value")


def cpu_lines(spark, sf_dir) -> DataFrame:
    """``pidstat`` lines, one per event."""
    ev = events(spark, sf_dir)
    line = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit("  "), _s(EID()), F.lit("  "), _s(K()), F.lit(".25  php-fpm"))
    return ev.select(HOST().alias("host"), EID().alias("seq"), line.alias("value"))


def connection_lines(spark, sf_dir) -> DataFrame:
    """``max_conn`` settings of balancers, one per part."""
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select(pk.alias("seq"), F.concat(F.lit("server 10.0.0."), _s(pk % 250), F.lit(":80 max_conn="), _s(F.col("p_size") * 20),
                                              F.when(pk % 10 == 0, "").otherwise(";")).alias("value"))


def memory_lines(spark, sf_dir) -> DataFrame:
    """``memory_limit`` settings, one per part."""
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select(pk.alias("seq"), F.concat(F.lit("memory_limit => "), _s(F.col("p_size") * 8), F.lit("M => "),
                                              _s(F.col("p_size") * 8), F.lit("M")).alias("value"))


# ---------------------------------------------------------------- F6 review queue

def _repo(col: Column) -> Column:
    return F.concat(F.lit("repo-"), _s(col % 7))


def _hex6(col: Column) -> Column:
    return F.lpad(F.lower(F.hex(col)), 6, "0")


ISSUE_SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("number", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("user", T.StructType([T.StructField("id", T.LongType()), T.StructField("login", T.StringType())])),
    T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", T.StringType()),
                                                      T.StructField("color", T.StringType())]))),
    T.StructField("pull_request", T.StructType([T.StructField("html_url", T.StringType())])),
])


def _render_issues(spark, sf_dir) -> DataFrame:
    """Open issues and pull requests: one per order; every 5th order is a plain issue."""
    o = table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    author = F.col("o_custkey") % 50
    labels = F.array(
        F.struct(F.col("o_orderstatus").alias("name"), _hex6((F.col("o_custkey") * 99991) % 16777216).alias("color")),
        F.struct(F.col("o_orderpriority").alias("name"), _hex6((ok * 7919) % 16777216).alias("color")))
    pr = F.when(ok % 5 != 0, F.struct(F.concat(F.lit("https://example.org/"), _repo(ok), F.lit("/pull/"),
                                               _s(ok)).alias("html_url")))
    return o.select(_repo(ok).alias("repo"), ok.alias("number"),
                    F.concat(F.lit("Order "), _s(ok), F.lit(" "), F.col("o_orderpriority")).alias("title"),
                    F.col("o_orderdate").alias("updated_at"),
                    F.struct(author.alias("id"), F.concat(F.lit("user"), _s(author)).alias("login")).alias("user"),
                    labels.alias("labels"), pr.alias("pull_request"))


def _render_requested_reviewers(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 5 != 0)
    ok = F.col("o_orderkey")
    uid = (ok * 3) % 50
    return o.select(_repo(ok).alias("repo"), ok.alias("number"), uid.alias("user_id"),
                    F.concat(F.lit("user"), _s(uid)).alias("login"))


REVIEW_STATES = {"click": "COMMENTED", "purchase": "APPROVED", "error": "CHANGES_REQUESTED", "view": "PENDING",
                 "signup": "DISMISSED"}


def _render_reviews(spark, sf_dir, in_order: bool = False) -> DataFrame:
    ev = events(spark, sf_dir)
    number = K() * 4 + UID() % 4
    state = F.lit(None).cast("string")
    for src, dst in REVIEW_STATES.items():
        state = F.when(F.col("event_type") == src, dst).otherwise(state)
    uid = UID() % 50
    # some reviews have no time, some are dated before the ones they follow
    time = F.when(K() % 31 == 7, None).when(K() % 9 == 4, F.col("ts") - F.expr("interval 12 days")).otherwise(F.col("ts"))
    return ev.select(EID().alias("seq"), _repo(number).alias("repo"), number.cast("long").alias("number"),
                     uid.alias("user_id"), F.concat(F.lit("user"), _s(uid)).alias("login"), state.alias("state"),
                     (F.col("ts") if in_order else time).alias("submitted_at"))


def _render_commits(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(_repo(F.col("o_orderkey")).alias("repo"), F.col("o_orderdate").alias("committed_at"))


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_access_lines(spark, sf_dir)


def php_error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_php_error_lines(spark, sf_dir)


def mail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_mail_lines(spark, sf_dir)


def pool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_pool_lines(spark, sf_dir)


def webserver_error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_webserver_error_lines(spark, sf_dir)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_tasks(spark, sf_dir)


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_audit_lines(spark, sf_dir)


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_section_lines(spark, sf_dir)


def realm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_realm_lines(spark, sf_dir)


def cache_audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_cache_audit_lines(spark, sf_dir)


def flush_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_flush_lines(spark, sf_dir)


def syslog_lines(spark: SparkSession, sf_dir: str, name: str = "syslog") -> DataFrame:
    return _render_syslog_lines(spark, sf_dir, name)


def watchdog_lines(spark: SparkSession, sf_dir: str, layout: str = "pipe") -> DataFrame:
    return _render_watchdog_lines(spark, sf_dir, layout)


def host_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_host_listing(spark, sf_dir)


def db_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_db_listing(spark, sf_dir)


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_issues(spark, sf_dir)


def requested_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_requested_reviewers(spark, sf_dir)


def reviews(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    return _render_reviews(spark, sf_dir, in_order)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_commits(spark, sf_dir)


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_hosts(spark, sf_dir)


def storage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_storage_tables(spark, sf_dir)


def server_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_server_capacity(spark, sf_dir)


def stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_stats_rows(spark, sf_dir)


def sockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_sockets(spark, sf_dir)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _render_sessions(spark, sf_dir)
