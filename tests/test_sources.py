import gzip
import json
import os
import time

from pyspark.sql import functions as F

from fleetlens.operators import inventory, traffic
from fleetlens.operators.common import last_n_by
from fleetlens.sources import lines as sl
from fleetlens.sources import tables as st
from fleetlens.sources.parse import parse_access


def _write(path, rows, gz=False):
    data = ("\n".join(rows) + "\n").encode()
    if gz:
        with gzip.open(path, "wb") as f:
            f.write(data)
    else:
        with open(path, "wb") as f:
            f.write(data)


def test_read_lines_plain_gzip_and_order_across_splits(spark, tmp_path):
    rows = [f"line {i:05d} " + "x" * 40 for i in range(3000)]
    _write(tmp_path / "a.log", rows)
    _write(tmp_path / "b.log.gz", rows[:500], gz=True)
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits per file
    try:
        df = sl.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = df.select("file", "seq", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    by = {}
    for r in got:
        by.setdefault(os.path.basename(r.file), []).append((r.seq, r.value))
    assert [v for _, v in sorted(by["a.log"])] == rows
    assert [v for _, v in sorted(by["b.log.gz"])] == rows[:500]


def test_last_n_lines(spark, tmp_path):
    _write(tmp_path / "small.log", [f"s{i}" for i in range(5)])
    _write(tmp_path / "big.log", [f"b{i:04d}" for i in range(2000)])
    df = sl.read_lines(spark, str(tmp_path))
    out = sl.last_n_lines(df, n=10)
    counts = {os.path.basename(r.file): r.n for r in out.groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert counts == {"small.log": 5, "big.log": 10}
    assert sorted(r.value for r in out.filter(F.col("file").endswith("big.log")).collect())[0] == "b1990"


def test_last_n_by_cuts_inside_and_between_chunks(spark):
    rows = spark.range(300_000).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file"), F.col("id").alias("seq"))
    for n in (1, 1000, 40_000, 100_000, 200_000):
        got = last_n_by(rows, n, "file").groupBy("file").agg(F.count("*").alias("n"), F.min("seq").alias("lo")).collect()
        assert {(r.n, r.lo // 2) for r in got} == {(min(n, 150_000), max(0, 150_000 - n))}


def test_last_n_of_a_host_over_rotated_files(spark):
    rows = [("h", "b.log", 1, i, f"old{i}") for i in range(5)] + [("h", "a.log", 2, i, f"new{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "host string, file string, file_time int, seq long, value string")
    assert sorted(r.value for r in last_n_by(df, 4, "host").collect()) == ["new0", "new1", "new2", "old4"]


def test_long_values_are_kept_whole(spark):
    """No text is cut: a method of 2 MiB comes back whole."""
    line = '1.1.1.1 - - [01/Jan/2024:00:00:00 +0000] "' + "G" * (2 << 20) + ' /x HTTP/1.1" 200 1 "-" "a"'
    assert len(parse_access(spark.createDataFrame([(line,)], "value string")).first().method) == 2 << 20


def test_newest_lines_over_rotated_files(spark, tmp_path):
    """A newer, larger file comes after the older one whatever Spark's scan order is."""
    stamp = '10.0.0.1 - - [%02d/Jan/2024:00:00:00 +0000] "GET /cron.php HTTP/1.1" 200 1 "-" "a" hosting_site=s request_time=9000000'
    _write(tmp_path / "access.log.1", [stamp % 1] * 20)
    _write(tmp_path / "access.log", [stamp % 2] * 2000)
    os.utime(tmp_path / "access.log.1", (1000, 1000))
    os.utime(tmp_path / "access.log", (2000, 2000))
    log = parse_access(sl.read_lines(spark, str(tmp_path / "access.log*")))
    assert {r.value[:30] for r in traffic.latest_matching(log).collect()} == {(stamp % 2)[:30]}
    slow = traffic.top_slow(log, "s").first()
    assert (slow.first_ts.day, slow.last_ts.day) == (1, 2)


def test_file_sizes_and_newest(spark, tmp_path):
    for i, name in enumerate(["a.log", "b.log", "c.log"]):
        _write(tmp_path / name, ["x" * (10 * (i + 1))])
        os.utime(tmp_path / name, (time.time() - 100 + i * 10, time.time() - 100 + i * 10))
    sizes = {os.path.basename(r.file): (r.bytes, r.flag_large) for r in
             sl.file_sizes(spark, str(tmp_path / "*.log"), warn_bytes=20).collect()}
    assert sizes == {"a.log": (11, False), "b.log": (21, True), "c.log": (31, True)}
    newest = sl.newest_files(spark, str(tmp_path / "*.log"), n=2)
    assert [os.path.basename(p) for p in newest] == ["b.log", "c.log"]


def test_read_records_pages_and_single_object(spark, tmp_path):
    schema = "number long, title string"
    (tmp_path / "p1.json").write_text(json.dumps([{"number": 1, "title": "a"}, {"number": 2, "title": "b"}]))
    (tmp_path / "p2.json").write_text(json.dumps({"number": 3, "title": "c"}))
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    sch = StructType([StructField("number", LongType()), StructField("title", StringType())])
    r = st.read_records(spark, str(tmp_path), sch).orderBy("number").collect()
    assert [x.number for x in r] == [1, 2, 3]


def test_stats_csv_header_only(spark, tmp_path):
    (tmp_path / "s.csv").write_text("day,site,c3,total,uncached\n")
    from fleetlens.operators.fleet import uncached_ratio
    r = uncached_ratio(st.read_stats_csv(spark, str(tmp_path / "s.csv"))).collect()
    assert [x.status for x in r] == ["no data"]


def test_write_report_roundtrip(spark, tmp_path):
    df = spark.range(5)
    path = st.write_report(df, str(tmp_path / "rep"))
    assert spark.read.parquet(path).count() == 5


def test_flatten_inventory(spark):
    docs = [json.dumps({"realm": {"prod": {"z1": {"web-1": {"type": ["web", "x"]}, "db-1": {"type": ["db"]}}}}}),
            json.dumps({"realm": {"prod": {"z2": {"bal-1": {"type": ["bal"]}, "ded-1": {"type": ["ded"]}}}}})]
    df = spark.createDataFrame([(d,) for d in docs], "json string")
    flat = inventory.flatten_inventory(df)
    assert flat.count() == 4
    assert [(r.role, r.host) for r in inventory.hosts_by_role(flat).collect()] == [
        ("bal", "bal-1"), ("db", "db-1"), ("web", "web-1")]


def test_read_records_page_per_line(spark, tmp_path):
    (tmp_path / "pages.json").write_text(json.dumps([{"number": 1}, {"number": 2}]) + "\n"
                                         + json.dumps({"number": 3}) + "\n")
    from pyspark.sql.types import LongType, StructField, StructType
    sch = StructType([StructField("number", LongType())])
    r = st.read_records(spark, str(tmp_path), sch, multi_line=False).orderBy("number").collect()
    assert [x.number for x in r] == [1, 2, 3]


def test_line_order_reports_are_split_invariant(spark, tmp_path):
    """Section fill and carry flags give the same answer with one split or many."""
    from fleetlens.operators import fleet
    rows = []
    for s in range(60):
        rows += [f"[srv-{s}]", "site1 2 x", "site1 0 x", f"{s} procs running", f"MaxProcessCount {s + 3}",
                 f"DefaultMaxClass {s % 4}", f"Mem: 1000 10 {s * 7}", "Enabled  none" if s % 3 else "Enabled  yes"]
    _write(tmp_path / "procs.log", rows)
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = []
    for size in ["134217728", "2048"]:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = sl.read_lines(spark, str(tmp_path))
            cap = sorted(tuple(r) for r in fleet.process_capacity(df, "site1").drop("file").collect())
            aud = sorted((r.value, r.kind, r.highlight) for r in fleet.cache_audit(df).collect())
            out.append((cap, aud, df.rdd.getNumPartitions()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    assert out[1][2] > 1
    assert out[0][:2] == out[1][:2]


def test_access_reports_are_split_invariant(spark, tmp_path):
    """top_slow first/last, latest matches and recent cron runs follow line order
    across many splits of one file."""
    from fleetlens.operators import traffic, watchdog
    from fleetlens.sources.parse import parse_access, parse_watchdog
    acc = []
    for i in range(400):
        path = "/cron.php" if i % 7 == 0 else f"/node/{i % 3}"
        acc.append(f'10.0.0.1 - - [05/Jan/2024:{(i * 7) % 24:02d}:{i % 60:02d}:00 +0000] "GET {path} HTTP/1.1" 200 1 '
                   f'"-" "ua" hosting_site=site1 request_time={3_000_001 + i} request_id="v-{i}"')
    wd = [f"Jan 05 {(i * 5) % 24:02d}:00:00 h s: http://s|{i}|{'cron' if i % 3 else 'php'}|ip|/p||1||run {i}"
          for i in range(400)]
    _write(tmp_path / "access.log", acc)
    (tmp_path / "wd").mkdir()
    _write(tmp_path / "wd" / "watchdog.log", wd)
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    res = []
    for size in ["134217728", "1024"]:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            a = parse_access(sl.read_lines(spark, str(tmp_path / "access.log")))
            w = parse_watchdog(sl.read_lines(spark, str(tmp_path / "wd")))
            res.append((
                sorted(tuple(r) for r in traffic.top_slow(a, "site1").collect()),
                [r.value for r in traffic.latest_matching(a, "GET /cron.php", 5).collect()],
                [r.message for r in watchdog.recent_cron(w).collect()],
                a.rdd.getNumPartitions()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    assert res[1][3] > 1
    assert res[0][:3] == res[1][:3]
    assert res[0][2][0] == "run 398" and res[0][1][0].endswith('request_id="v-399"')


def test_cluster_conf_applies(spark):
    from fleetlens.session import apply_conf, cluster_conf
    conf = cluster_conf(100 * 10**12, 8000)
    assert conf["spark.sql.shuffle.partitions"] == str(100 * 10**12 // (256 << 20))
    saved = {k: spark.conf.get(k, None) for k in conf}
    try:
        apply_conf(spark, conf)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(256 << 20)
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
