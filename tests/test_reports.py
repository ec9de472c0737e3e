import os

from fleetlens.plans import reports


def _w(path, rows):
    with open(path, "w") as f:
        f.write("\n".join(rows) + "\n")


def test_access_report_bundle_and_sink(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    _w(logs / "access.log", [
        f'10.0.0.1 - - [05/Jan/2024:10:{i:02d}:00 +0000] "GET {p} HTTP/1.1" {s} 1 "-" "ua" hosting_site=s1 '
        f'request_time={us} request_id="v-{i}"'
        for i, (p, s, us) in enumerate([("/a", 200, 10), ("/cron.php", 200, 4_000_000), ("/b", 503, 5)])])
    _w(logs / "php-errors.log", ['[05-Jan-2024 10:02:00 UTC] PHP Fatal error:  Allowed memory size of 1 bytes '
                                 'exhausted (tried to allocate 9 bytes) request_id="v-2"'])
    disk = spark.createDataFrame([("web-1", "/dev/sda1 100 90 10 90% /"), ("web-1", "tmpfs 1 1 0 100% /run")], "host string, value string")
    rep = reports.access_log_report(spark, str(logs), "s1", disk=disk)
    assert [r.filesystem for r in rep["low_disk_space"].collect()] == ["/dev/sda1"]
    assert rep["hourly_traffic"].first().n_requests == 3
    assert rep["oom_paths"].first().path == "/b"
    out = reports.write_reports(rep, str(tmp_path / "out"))
    assert set(out) == set(rep) and spark.read.parquet(out["top_slow"]).first().path == "/cron.php"


def test_check_registry_only_and_skip(spark, lines):
    df = lines(["2024-01-05 10:00:00 1 Completed"])
    got = reports.run_checks({"email_volume": (df,), "audit": (df.withColumn("host", df.file),)},
                             only=["email_volume", "audit", "dns"], skip=["audit"])
    assert list(got) == ["email_volume"] and got["email_volume"].first().n == 1


def test_cli_watchdog(spark, tmp_path):
    from fleetlens.__main__ import main
    p = tmp_path / "drupal-watchdog.log"
    _w(p, ["Jan 05 10:00:00 h s: http://s|1|cron|ip|/c||1||run 1",
           'Jan 05 10:00:00 h s: http://s|1|user|ip|/u||1||dblog module enabled. request_id="v-1"'])
    assert main(["watchdog-report", str(p), "2024-01-05", str(tmp_path / "out"), "--master", "local[2]"]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "module_changes")).first().flag_costly
    assert os.path.isdir(tmp_path / "out" / "top_types")
