"""Two-pass top-k counts against the plain form, and what they shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import heavy, traffic, watchdog
from fleetlens.operators.common import top_counts


def _same(df, keys, k, **more):
    want = [tuple(r) for r in top_counts(df, keys, k).collect()]
    got = heavy.heavy_hitters(df, keys, k, **more)
    assert got.columns == top_counts(df, keys, k).columns
    assert [tuple(r) for r in got.collect()] == want
    return want


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_the_plain_form_with_ties_and_nulls(spark, seed):
    rng = random.Random(seed)
    kinds = rng.choice([3, 30, 3000])
    rows = [(rng.choice([None, "a", "b", f"u{int(rng.paretovariate(0.7)) % kinds}"]), rng.choice([None, 1, 2])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "u string, s int").repartition(5)
    for keys, k in ((["u"], 5), (["u", "s"], 7), (["s"], 10), ("u", 1)):
        _same(df, keys, k, tracked=(16, 64))


def test_all_kinds_of_keys_and_no_rows(spark):
    df = spark.range(3000).selectExpr("id % 7 AS a", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id % 3) AS t",
                                      "cast(id % 2 AS decimal(9,2)) AS d", "array(id % 2) AS x")
    for keys in (["a"], ["t", "d"], ["x", "a"]):
        _same(df, keys, 3)
    assert heavy.heavy_hitters(df.filter("a > 9"), ["a"], 3).collect() == []


def test_flat_counts_fall_back_to_the_plain_form(spark):
    df = spark.range(20_000).selectExpr("id % 10000 AS u")
    assert len(_same(df, ["u"], 5, tracked=(16,))) == 5


def test_colliding_hashes_do_not_change_the_answer(spark, monkeypatch):
    """All keys that end alike share a hash: estimates are of several keys, the counts are not."""
    real = heavy.F.xxhash64
    monkeypatch.setattr(heavy.F, "xxhash64", lambda *cols: real(F.substring(F.col(cols[0]), -1, 1)))
    rng = random.Random(9)
    df = spark.createDataFrame([(f"k{int(rng.paretovariate(0.8)) % 500}",) for _ in range(5000)], "u string")
    _same(df, ["u"], 5)


def test_candidates_hold_everything_that_can_be_among_the_first():
    s = heavy.Summary(1000, 10, [(1, 100), (2, 90), (3, 80), (4, 71), (5, 69), (6, 20)])
    assert s.candidates(3) == ([1, 2, 3, 4], 69)
    assert s.candidates(7) == ([1, 2, 3, 4, 5, 6], 10)


def _shuffled(df) -> int:
    """Rows written to shuffles by the executed plan."""
    df.collect()
    total = 0

    def walk(node):
        nonlocal total
        m = node.metrics()
        if m.contains("shuffleRecordsWritten"):
            total += m.apply("shuffleRecordsWritten").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return total


def test_shuffled_rows_do_not_follow_the_distinct_keys(spark):
    """Plain counts shuffle a row a distinct key; the passes of the two-pass form only candidates."""
    def keys(distinct):
        return spark.range(200_000, numPartitions=4).selectExpr(f"if(id % 4 = 0, cast(id % 20 AS string), concat('x', id % {distinct})) AS u")

    seen, plain = {}, {}
    for distinct in (20_000, 150_000):
        df = keys(distinct)
        hashed = df.withColumn("_key", F.xxhash64("u"))
        chosen, bound = heavy.summarise(hashed.select("_key"), 4096).candidates(5)
        wanted = F.broadcast(spark.createDataFrame([(h,) for h in chosen], "_key long"))
        counted = top_counts(hashed.join(wanted, "_key", "left_semi").select("u"), ["u"], 5)
        assert counted.collect()[-1]["n"] > bound
        seen[distinct] = _shuffled(counted)
        plain[distinct] = _shuffled(top_counts(df, ["u"], 5))
        assert [tuple(r) for r in heavy.heavy_hitters(df, ["u"]).collect()] == [tuple(r) for r in top_counts(df, ["u"]).collect()]
    assert plain[150_000] > 100_000 and max(seen.values()) < 500 and abs(seen[20_000] - seen[150_000]) < 100


def test_reports_with_either_count(spark, lines):
    from fleetlens.sources.parse import parse_access, parse_php_error, parse_watchdog_pipe

    ln = '1.1.1.1 - - [05/Jan/2024:10:00:00 +0000] "GET {} HTTP/1.1" 503 1 "-" "agent{}" hosting_site=s request_time=1 request_id="v-1"'
    access = parse_access(lines([ln.format(f"/list?page={i % 3}", i % 2) for i in range(60)]))
    errors = parse_php_error(lines([f'[05-Jan-2024 10:00:00 UTC] PHP Fatal error: {i % 4} request_id="v-{i}"' for i in range(40)]))
    dog = parse_watchdog_pipe(lines([f"h|1|page not found|ip|/u{i % 6}|r|0|l|m" for i in range(50)]))
    for report, df in ((traffic.top_error_paths, access), (traffic.top_error_paths_hourly, access), (traffic.paged_hits_by_agent, access),
                       (traffic.top_errors, errors), (watchdog.top_types, dog), (watchdog.top_not_found, dog)):
        assert report(df, counts=heavy.heavy_hitters).collect() == report(df).collect() != []
    assert re.match("/list", traffic.top_error_paths(access, counts=heavy.heavy_hitters).first().path)
