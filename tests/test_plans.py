"""Plan lint: properties every registered query's physical plan must keep at scale."""

import os
import re

import pytest

from fleetlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
STREAMS = {"hourly_traffic_stream", "ten_minute_times_stream", "top_errors_stream", "process_capacity_stream", "resolve_sections_stream",
           "cache_audit_stream", "oom_paths_stream"}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
             "MapInPandas"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(fn(spark, SF)) for name, fn in QUERIES.items() if name not in STREAMS}


def test_no_cartesian_or_python(plans):
    bad = {n: [f for f in FORBIDDEN if f in p] for n, p in plans.items()}
    assert {n: f for n, f in bad.items() if f} == {}


def test_windows_never_partition_by_file_or_host_alone(plans):
    """Line-order windows include the chunk key (or scan the per-chunk summary, one
    row per chunk); per-group top-k windows are bounded by WindowGroupLimit."""
    for name, p in plans.items():
        for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", p):
            keys, order = m.group(1), m.group(2)
            if re.fullmatch(r"(file|host)#\d+L?", keys.strip()):
                assert "_chunk" in order or "WindowGroupLimit" in p, (name, keys, order)


def test_group_limits_run_before_the_shuffle(plans):
    for name in ["top_messages_per_type"]:
        p = plans[name]
        assert p.count("WindowGroupLimit") >= 2, name  # partial (map side) and final


def test_explicit_broadcasts_are_bounded(spark):
    """Only the chosen top types, and the candidates of a two-pass count, are broadcast by hint."""
    import inspect

    from fleetlens.operators import common, fleet, fleetlog, heavy, idfilter, increments, inventory, review, sequence, traffic, watchdog
    hinted = []
    for mod in (common, fleet, fleetlog, heavy, idfilter, increments, inventory, review, sequence, traffic, watchdog):
        src = inspect.getsource(mod)
        hinted += [(mod.__name__, line.strip()) for line in src.splitlines() if "F.broadcast(" in line]
    assert sorted(m for m, _ in hinted) == ["fleetlens.operators.heavy", "fleetlens.operators.watchdog"]


def test_last_n_never_sorts_a_whole_file(spark):
    from fleetlens.operators.common import last_n_by

    rows = spark.range(10).selectExpr("'f' AS file", "id AS seq", "'v' AS value")
    p = _plan(last_n_by(rows, 200_000, "file"))
    for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", p):
        assert "_chunk" in m.group(1) or "_chunk" in m.group(2), m.group(0)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Stored lines, so that a plan shows how often it reads its input."""
    path = str(tmp_path_factory.mktemp("lines") / "t")
    spark.range(100).selectExpr("'f' AS file", "'h' AS host", "id AS seq", "' site Enabled Out of memory' AS value").write.parquet(path)
    return spark.read.parquet(path)


def _reads(df) -> int:
    return _plan(df).count("FileScan parquet")


def test_reads_of_the_input(spark, stored):
    """Line-order reports read their lines at most twice: for the chunk summary and for the rows."""
    from fleetlens.operators import fleet, fleetlog
    from fleetlens.operators.common import last_n_by

    assert _reads(last_n_by(stored, 100, "host")) == 1
    assert _reads(last_n_by(stored, 200_000, "host")) == 2
    now = "2024-01-01 00:00:00"
    assert _reads(fleetlog.syslog_events(stored, now, n=100)) == 1
    assert _reads(fleetlog.syslog_events(stored, now, window=3000)) == 2
    assert _reads(fleetlog.syslog_events(stored, now, n=100, window=3000)) == 2
    assert _reads(fleet.process_capacity(stored, "u")) == 2
    assert _reads(fleet.cache_audit(stored)) == 2
    assert _reads(fleet.resolve_sections(stored, spark.createDataFrame([("a", "b")], "label string, code string"))) == 2


def test_review_fold_shuffles_each_input_once(plans):
    assert plans["review_state"].count("Exchange hashpartitioning") <= 3


def test_inputs_are_the_given_tables(plans):
    """No query reads a stored copy of its rendered input (those that test a source or sink do read what they wrote)."""
    files = {"read_lines", "file_sizes", "read_stats_csv", "read_records", "write_report", "newest_files", "latest_matching_files",
             "top_slow_files", "recent_cron_files", "report_store", "hourly_traffic_increments", "ten_minute_increments",
             "new_files", "parse_quality", "newest_files_pruned", "read_records_drift"}
    counted = {n for n in QUERIES if "heavy" in n}  # the k rows that two passes over the tables gave
    assert {n for n, p in plans.items() if SF.rsplit("/", 1)[0] not in p and "LocalTableScan" not in p} <= files | counted


def test_flags_take_both_values():
    """A wrong threshold must be able to fail: flags of the oracles are not constant at sf0.01."""
    import duckdb

    from fleetlens.plans.oracle_sql import ORACLES
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    # one verdict for the whole input, or a clock hour without events
    single = {("drift", "problem"), ("version_drift", "problem"), ("count_over", "flag"), ("variable_stats", "flag_n"),
              ("variable_stats", "flag_max"), ("variable_stats", "flag_total"), ("literal_events", "flag_hour"), ("newest_files", "flag_today"), ("newest_files_pruned", "flag_today")}
    constant = set()
    for name, sql in ORACLES.items():
        out = con.sql(sql).df()
        constant |= {(name, c) for c in out.columns if (c.startswith("flag") or c in ("status", "problem", "highlight", "chosen"))
                     and out[c].nunique(dropna=False) < 2}
    constant = {(n, c) for n, c in constant if c != "chosen"}
    assert constant <= single
