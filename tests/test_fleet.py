import datetime as dt


from fleetlens.operators import common, fleet, fleetlog


def test_select_hosts_switches_off_after_ded(lines):
    vals = [" srv-1 up 1", " web-2 up 1 *", " web-3 up 1", " bal-4 up 1", " ded-5 up 1", " web-6 up 1"]
    assert [r.host for r in fleet.select_hosts(lines(vals)).orderBy("seq").collect()] == ["srv-1", "web-3"]
    raw = fleet.select_hosts(lines(vals), include_marked=True).orderBy("seq").collect()
    assert [r.host for r in raw] == ["srv-1", "web-2", "web-3"]


def test_ded_before_web_does_not_switch_off(lines):
    vals = [" ded-1 up", " web-2 up", " ded-3 up", " web-4 up"]
    assert [r.host for r in fleet.select_hosts(lines(vals)).orderBy("seq").collect()] == ["ded-1", "web-2"]


def test_passive_or_active(lines):
    r = fleet.passive_or_active(lines(["db-1 db", "db-2 active-db", "note", "db-3 db", "db-4 db"])).first()
    assert (r.passive, r.active, r.chosen) == ("db-3", "db-2", "db-3")
    r = fleet.passive_or_active(lines(["db-1 db", "db-2 active-db"])).first()
    assert (r.passive, r.chosen) == (None, "db-2")
    r = fleet.passive_or_active(lines(["db-1 active-db", "db-2 active-db", "db-3 db"])).first()
    assert r.chosen == "db-3"  # the row after the last active one wins


def test_cache_audit_carry(lines):
    vals = ["h%d" % i for i in range(10)] + ["block cache  0", "x", "Enabled  yes", "y", "Enabled  yes",
                                               "Enabled  none"]
    r = fleet.cache_audit(lines(vals)).filter("kind = 'enabled'").orderBy("seq").collect()
    assert [x.highlight for x in r] == [True, False, True]
    assert fleet.cache_audit(lines(vals)).filter("kind = 'head'").count() == 10


def test_process_capacity(lines):
    vals = ["[srv-a]", "site1 2", "site1 0", "site2 5", "7 procs running", "MaxProcessCount 9", "DefaultMaxClass 1",
            "Mem: 1000 900 100", "x 1 defunct", "[srv-b]", "site1 1", "MaxProcessCount 5", "DefaultMaxClass 4",
            "Mem: 1000 100 900"]
    r = {x.server: x for x in fleet.process_capacity(lines(vals), "site1").collect()}
    a, b = r["srv-a"], r["srv-b"]
    assert (a.user_running, a.total_running, a.max_overall, a.max_user) == (1, 7, 9, 1)
    assert a.flag_user_at_max and a.flag_low_mem
    assert b.user_running == 1 and not b.flag_user_at_max and not b.flag_low_mem


def test_resolve_sections_last_wins(spark, lines):
    labels = spark.createDataFrame([("Alpha", "a"), ("Beta", "b")], "label string, code string")
    vals = ["[Alpha]:", " s1.prod x", "[Beta]:", " s2.test y", "[Gamma]:", " s3.dev z"]
    r = fleet.resolve_sections(lines(vals), labels).orderBy("seq").collect()
    assert [(x.label, x.code, x.site, x.chosen) for x in r] == [
        ("Alpha", "a", "s1.prod", False), ("Beta", "b", "s2.test", False), ("Gamma", None, "s3.dev", True)]


def test_drift_and_threshold(spark):
    df = spark.createDataFrame([("w1", 5), ("w2", 5), ("w3", 4)], "host string, folders long")
    r = {x.host: x for x in fleet.drift(df).collect()}
    assert r["w3"].flag_below_max and not r["w1"].flag_below_max and r["w1"].problem
    same = spark.createDataFrame([("w1", 5), ("w2", 5)], "host string, folders long")
    assert not fleet.drift(same).first().problem
    m = spark.createDataFrame([(10239.0,), (10240.0,)], "free double")
    assert common.threshold_flag(m, "free", hi=10240, hi_strict=True, keep_only=True).count() == 1
    assert common.threshold_flag(m, "free", lo=10240).filter("flag").count() == 1


def test_uncached_ratio_no_data(spark):
    from fleetlens.sources.tables import STATS_SCHEMA
    empty = spark.createDataFrame([], STATS_SCHEMA)
    r = fleet.uncached_ratio(empty).collect()
    assert len(r) == 1 and r[0].status == "no data"
    df = spark.createDataFrame([("d", "s", "c", 1000, 75), ("d", "s", "c", 1000, 76), ("d", "s", "c", 0, 5)],
                               STATS_SCHEMA)
    assert [x.status for x in fleet.uncached_ratio(df).orderBy("uncached").collect()] == ["ok", "high"]


def test_block_cache_php_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("0",), ("0.0",), ("1",)], "cache string")
    assert [r.cache_mode for r in fleet.block_cache(df).collect()] == ["undefined", "undefined", "undefined", "0.0", "1"]


def test_storage_rollup_excludes_system_and_null(spark):
    df = spark.createDataFrame([("site", "t1", "InnoDB", 1 << 30, 0, 1), ("site", "t2", "MyISAM", 1 << 29, 1 << 29, 1),
                                ("mysql", "t3", "InnoDB", 99, 0, 1), ("site", "t4", None, 77, 0, 1)],
                               "table_schema string, table_name string, engine string, data long, index long, row_count long")
    r = {x.engine: x for x in fleet.storage_by_engine(df).collect()}
    assert set(r) == {"InnoDB", "MyISAM", "Total"}
    assert r["Total"].total_bytes == (1 << 30) + (1 << 30) and r["Total"].total_gb == 2.0


def test_flush_ages_flags(spark):
    now = "2024-01-30 12:00:00"
    base = int(dt.datetime(2024, 1, 30, 12, tzinfo=dt.timezone.utc).timestamp())
    df = spark.createDataFrame([(f"a: {base - 9}",), (f"b: {base - 10}",), (f"c: {base - 9999}",), (f"d: {base - 10000}",)],
                               "value string")
    r = fleet.flush_ages(df, now).collect()
    assert [x.flag_recent for x in r] == [False, True, True, False]
    assert all(x.flag_today for x in r)


def test_duplicate_modules(spark):
    paths = spark.createDataFrame([("a/x.info",), ("b/x.info",), ("a/y.info",), ("b/y.info",), ("c/z.info",),
                                   ("a/drupal_system_listing_compatible_test.info",),
                                   ("b/drupal_system_listing_compatible_test.info",)], "path string")
    system = spark.createDataFrame([("a/x.module", "module", "enabled"), ("b/y.theme", "theme_engine", "enabled"),
                                    ("a/drupal_system_listing_compatible_test.module", "module", "enabled")],
                                   "filename string, type string, status string")
    r = sorted((x.name, x.path, x.is_enabled) for x in fleet.duplicate_modules(paths, system).collect())
    assert r == [("x.info", "a/x.info", True), ("x.info", "b/x.info", False)]


def test_large_payloads_limit(spark):
    df = spark.createDataFrame([("a", "x" * 11), ("b", "é" * 6), ("c", "x" * 5)], "name string, value string")
    r = fleet.large_payloads(df, limit=10).collect()
    assert [(x.cid, x.bytes) for x in r] == [("b", 12), ("a", 11)]


def test_syslog_and_literal_events(lines):
    vals = ["Jan 30 23:01:00 web-1 kernel: Out of memory: Kill process 1 (php) score 1",
            "Jan 30 22:01:00 web-1 ah: AH_SPLIT_BRAIN: Split brain detected: db=main",
            "Jan  3 23:01:00 web-1 x: Restarting php",
            "Jan 30 23:02:00 web-1 x: AH_SERIOUS_ thing",
            "Jan 30 23:03:00 web-1 cron: idle"]
    df = lines(vals, host="web-1")
    r = fleetlog.syslog_events(df, "2024-01-30 23:30:00", exclude=["db=main"]).orderBy("seq").collect()
    assert [x.seq for x in r] == [0, 2, 3]
    assert [(x.flag_today, x.flag_hour, x.flag_severe) for x in r] == [(True, True, True), (False, False, False),
                                                                        (True, True, False)]
    assert fleetlog.syslog_events(df, "2024-01-03 23:30:00").filter("flag_today").count() == 1
    assert [x.seq for x in fleetlog.literal_events(df, "2024-01-30 00:00:00").collect()] == [3]


def test_skip_spawns_keys(lines):
    fpm = lines(["[05-Jan-2024 10:11:12] WARNING: server reached max_children setting (5)",
                 "[05-Jan-2024 10:59:00] WARNING: you may need to increase pm.start_servers", "[05-Jan-2024 11:00:00] x"],
                host="h")
    assert [(r.hour_key, r.n) for r in fleetlog.skip_spawns(fpm, "fpm").collect()] == [("[05-Jan-2024 10:XX:XX", 2)]
    web = lines(["[Fri Jan 05 10:11:12 2024] [error] skip the spawn request"], host="h")
    assert fleetlog.skip_spawns(web, "webserver").first().hour_key == "Fri Jan 05 10:XX"


def test_audit_errors_strip(lines):
    df = lines(["\x1b[31m[error]\x1b[0m  Bad thing \t \r", "[ok] fine"], host="h")
    assert [r.message for r in fleetlog.audit_errors(df).collect()] == ["  Bad thing"]


def test_session_status_and_urls(spark):
    df = spark.createDataFrame([
        ("a", 1, 0, ["< Set-Cookie: SESSx=1", "< Location: y"]),
        ("b", 2, 0, ["< Location: y"]),
        ("c", 3, 0, ["< Location: y", "< Location: z"]),
        ("d", 4, 7, []),
    ], "domain string, seq long, exit int, headers array<string>")
    assert [r.status for r in fleetlog.session_status(df).orderBy("seq").collect()] == [
        "anonymous session", "redirect", "ok", "timeout"]
    d = spark.createDataFrame([("x.org",), ("https://y.org",)], "domain string")
    assert sorted(r.url for r in fleetlog.expand_urls(d).collect()) == ["http://x.org", "https://x.org", "https://y.org"]


def test_mail_per_day_counts_every_date(lines):
    df = lines(["2024-01-05 10:00:00 1 Completed", "2024-01-05 11:00:00 2 x", "2024-1-6 2024-01-05 Completed"])
    assert sorted((r.day, r.n) for r in fleetlog.mail_per_day(df).collect()) == [("2024-01-05", 2), ("2024-1-6", 1)]


def test_count_literal_and_connections(spark, lines):
    hosts = spark.createDataFrame([("h1",), ("h2",)], "host string")
    df = lines(["a SIGSEGV", "b"], host="h1")
    assert sorted((r.host, r.n) for r in fleetlog.count_literal_by_host(df, hosts).collect()) == [("h1", 1), ("h2", 0)]
    socks = spark.createDataFrame([("h1", "php-fpm", "TCP", 443), ("h1", "php-fpm", "TCP", 3306), ("h1", "nginx", "TCP", 80)],
                                  "host string, process string, protocol string, port int")
    r = sorted((x.host, x.port, x.status) for x in fleetlog.external_connections(socks, hosts).collect())
    assert r == [("h1", 443, "open"), ("h2", None, "none")]


def test_preview_total(spark):
    df = spark.range(40).withColumnRenamed("id", "d")
    r = common.preview(df, 15, ["d"]).collect()
    assert len(r) == 15 and r[0].total == 40 and r[-1].d == 14
