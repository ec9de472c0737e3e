"""Lines of an unknown host or file are a group of their own, in every line-order report."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import fleet, fleetlog
from fleetlens.operators.common import join_same, last_n_by
from fleetlens.operators.sequence import Scan, forward_fill, previous_value, running_any, running_count, scan


def test_join_same_keeps_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert sorted(map(tuple, join_same(left, right, "k").collect()), key=str) == [("a", 2, 20), (None, 1, 10)]
    assert join_same(left, right, "k", "left").count() == 3


@pytest.mark.parametrize("n", [1, 3, 1500])
def test_last_lines_of_a_null_host(spark, n):
    rows = [(h, i, f"{h}{i}") for i in range(3000) for h in [(None, "a", None, "b")[i % 4]]]
    got = last_n_by(spark.createDataFrame(rows, "host string, seq long, value string").repartition(4), n, "host").collect()
    want = []
    for h in (None, "a", "b"):
        want += [r for r in rows if r[0] == h][-n:]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_last_lines_over_files_and_chunks(spark):
    rows = [(t, f"f{t}", i + (t << 17), f"{t}-{i}") for t in range(3) for i in range(0, 70_000, 35)]
    df = spark.createDataFrame([("h", *r) for r in rows], "host string, file_time long, file string, seq long, value string")
    for n in (700, 2500, 4500):
        got = {r["value"] for r in last_n_by(df, n, "host").collect()}
        assert got == {r[3] for r in rows[-n:]}


def test_running_values_of_a_null_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "f"]), i, rng.choice([None, None, "a", "b"]), rng.random() < 0.3) for i in range(60)]
    df = spark.createDataFrame(rows, "file string, seq long, v string, x boolean")
    for bits in (1, 3):
        got = forward_fill(df, "v", "seq", "ff", "file", bits)
        got = previous_value(got, "v", "seq", "pv", "file", bits)
        got = running_count(got, "x", "seq", "n", "file", True, bits)
        got = running_any(got, "x", "seq", "any", "file", False, bits)
        one = scan(df, [Scan("ff", "v", "last"), Scan("pv", "v", "prev"), Scan("n", F.col("x").cast("long"), "sum"), Scan("end", "seq", "all_max")],
                   "seq", "file", bits)
        got, one = ({r["seq"]: r for r in d.collect()} for d in (got, one))
        for f in (None, "f"):
            last = prev = None
            n, seen = 0, False
            mine = [r for r in rows if r[0] == f]
            for r in mine:
                last, n = r[2] or last, n + r[3]
                g, o = got[r[1]], one[r[1]]
                assert (g["ff"], g["pv"], g["n"], g["any"]) == (last, prev, n, seen)
                assert (o["ff"], o["pv"], o["n"], o["end"]) == (last, prev, n, mine[-1][1])
                prev, seen = r[2], seen or r[3]


def _both(spark, values, report):
    """The report of one file under a name and without one: the same rows."""
    named = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, seq long, value string")
    unnamed = named.withColumn("file", F.lit(None).cast("string"))
    a, b = (sorted((str(r) for r in report(d).drop("file").collect())) for d in (named, unnamed))
    assert a == b and a
    both = report(named.union(unnamed)).collect()
    assert len(both) == 2 * len(a) and {r["file"] for r in both} == {"f", None}


def test_fleet_reports_of_a_null_file(spark):
    labels = spark.createDataFrame([("A", "a")], "label string, code string")
    _both(spark, ["[A]:", " s1.prod 1", " s2.test 2", "[B]:", " s3.prod 1"], lambda d: fleet.resolve_sections(d, labels))
    _both(spark, ["[srv-a]", "site1 2", "7 procs running", "Mem: 100 1 2", "[srv-b]", "MaxProcessCount 9"], lambda d: fleet.process_capacity(d, "site1"))
    _both(spark, ["x"] * 12 + ["cache 0", "Enabled 1", " cache  0", "y", "Enabled ok", "Enabled none"], fleet.cache_audit)
    _both(spark, ["db-1 active-db", "db-2 x", "db-3 y"], fleet.passive_or_active)
    _both(spark, ["web-1 a", "srv-2 b", "ded-3 c", "web-4 d"], fleet.select_hosts)


@pytest.mark.parametrize("n,window", [(None, None), (2, None), (None, 8), (2, 8), (2, 2000), (None, 1001)])
def test_syslog_of_a_null_host(spark, n, window):
    rows = [(h, i, f"Jan  5 10:00:0{i % 10} {h} " + ("kernel: Out of memory" if i % 3 == 0 else "idle")) for i in range(30) for h in (None, "web-1")]
    got = fleetlog.syslog_events(spark.createDataFrame(rows, "host string, seq long, value string"), "2024-01-05 10:00:00", n=n, window=window)
    want = []
    for h in (None, "web-1"):
        mine = [r for r in rows if r[0] == h][-(window or 99):]
        want += [r[:2] for r in mine if "memory" in r[2]][-(n or 99):]
    assert sorted(((r["host"], r["seq"]) for r in got.collect()), key=str) == sorted(want, key=str)
