from pyspark.sql import functions as F

from fleetlens.operators import traffic
from fleetlens.operators.common import top_counts
from fleetlens.sources.parse import parse_access, parse_php_error


def line(i, status=200, us=1000, site="site1", path="/node/1", method="GET", rid=None, ua="Mozilla/5.0", hour=10):
    rid = rid or f"v-{i}"
    return (f'10.0.0.1 - - [05/Jan/2024:{hour:02d}:00:{i % 60:02d} +0000] "{method} {path} HTTP/1.1" {status} 100 "-" '
            f'"{ua}" hosting_site={site} request_time={us} request_id="{rid}"')


def test_hourly_boundaries(lines):
    # 20 requests: exactly 3 s is not slow; 1 of 20 slow = 5 % is not flagged (strict >)
    vals = [line(i, us=3_000_000) for i in range(19)] + [line(19, us=3_000_001)]
    vals += [line(20, site="site10")]  # other site, prefix of the name: not counted
    r = traffic.hourly_traffic(parse_access(lines(vals)), "site1").collect()
    assert len(r) == 1
    assert r[0].n_requests == 20 and r[0].n_slow == 1 and r[0].flag_slow is False
    assert r[0].max_s == 3.000001


def test_hourly_status_classes(lines):
    vals = [line(0, 200), line(1, 302), line(2, 404), line(3, 511), line(4, 503)]
    r = traffic.hourly_traffic(parse_access(lines(vals)), "site1").first()
    assert (r.n_2xx, r.n_3xx, r.n_4xx, r.n_5xx) == (1, 1, 1, 2)
    assert r.flag_4xx and r.flag_5xx


def test_error_paths_use_50_prefix_and_cut(lines):
    long = "/files/" + "x" * 60
    vals = [line(0, 511), line(1, 503, path=long), line(2, 502, path=long), line(3, 500, site="other")]
    r = traffic.top_error_paths(parse_access(lines(vals))).collect()
    assert r[0].path == long[:50] + "..." and r[0].n == 2
    assert {x.path for x in r} == {long[:50] + "...", "/node/1"}


def test_top_counts_ties_go_to_larger_key(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    assert [r.k for r in top_counts(df, ["k"], 2).collect()] == ["c", "b"]


def test_paged_hits_ignore_page_zero(lines):
    vals = [line(0, path="/list?page=0"), line(1, path="/list?page=3", ua="Drupal x"), line(2, path="/list?page=05")]
    r = traffic.paged_hits_by_agent(parse_access(lines(vals))).collect()
    assert len(r) == 1 and r[0].n == 1 and r[0].flag_marker


def test_latest_matching_is_last_in_line_order(lines):
    vals = [line(i, path="/cron.php") for i in range(8)]
    r = traffic.latest_matching(parse_access(lines(vals)), "GET /cron.php", 5).collect()
    assert [x.seq for x in r] == [7, 6, 5, 4, 3]


def test_oom_ids_match_by_equality(lines):
    errs = lines(['[05-Jan-2024 10:00:00 UTC] PHP Fatal error:  Allowed memory size of 1 bytes exhausted '
                  '(tried to allocate 5 bytes) request_id="v-1"',
                  '[05-Jan-2024 10:00:00 UTC] PHP Fatal error:  Allowed memory size of 1 bytes exhausted '
                  '(tried to allocate 5 bytes) request_id="x-2"'], file="php-errors.log")
    acc = parse_access(lines([line(0, rid="v-1"), line(1, rid="v-12", path="/other"), line(2, rid="x-2")]))
    r = traffic.oom_paths(parse_php_error(errs), acc).collect()
    assert [(x.path, x.n) for x in r] == [("/node/1", 1)]


def test_top_slow_first_last_follow_line_order(lines):
    vals = [line(0, us=4_000_000, hour=12), line(1, us=5_000_000, hour=9), line(2, us=4_000_000, hour=11)]
    r = traffic.top_slow(parse_access(lines(vals)), "site1").first()
    assert r.n == 3 and r.first_ts.hour == 12 and r.last_ts.hour == 11 and r.max_s == 5.0


def test_ten_minute_buckets(spark):
    df = spark.createDataFrame([("2024-01-01 00:09:59", 10, 100), ("2024-01-01 00:10:00", 30, 300)],
                               "t string, q long, e long").select(F.col("t").cast("timestamp_ntz").alias("ts"),
                                                                  F.col("q").alias("queue_us"), F.col("e").alias("exec_us"))
    r = traffic.ten_minute_times(df).collect()
    assert [x.n for x in r] == [1, 1] and r[1].max_exec_s == 0.0003


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=60), st.integers(1, 8))
def test_top_counts_is_prefix_of_full_order(spark, keys, k):
    df = spark.createDataFrame([(x,) for x in keys], "key string")
    full = [(r.key, r.n) for r in top_counts(df, ["key"], None).collect()]
    assert [(r.key, r.n) for r in top_counts(df, ["key"], k).collect()] == full[:k]
    assert full == sorted(full, key=lambda t: (-t[1], [-ord(c) for c in t[0]]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([200, 301, 404, 500, 511, 99]), st.integers(0, 9_000_000)), min_size=1,
                max_size=30))
def test_class_counts_never_exceed_total(spark, reqs):
    from pyspark.sql import Row
    vals = [line(i, status=s, us=u) for i, (s, u) in enumerate(reqs)]
    df = spark.createDataFrame([Row(file="f", seq=i, value=v) for i, v in enumerate(vals)])
    for r in traffic.hourly_traffic(parse_access(df), "site1").collect():
        assert r.n_2xx + r.n_3xx + r.n_4xx + r.n_5xx <= r.n_requests
        assert r.n_slow <= r.n_requests
