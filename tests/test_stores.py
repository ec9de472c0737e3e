"""Id filter, report store and increments."""

import datetime as dt
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import idfilter, increments, traffic
from fleetlens.sources import store
from fleetlens.sources.parse import parse_access, parse_php_error

LINE = '1.1.1.1 - - [05/Jan/2024:10:00:00 +0000] "GET /p{} HTTP/1.1" 200 1 "-" "ua" hosting_site=s request_time=1 request_id="v-{}"'


# id filter


def test_filter_never_misses_and_rarely_errs(spark):
    ids = spark.range(20_000).selectExpr("concat('v-', id * 7) AS request_id").union(spark.createDataFrame([(None,)], "request_id string"))
    words = idfilter.words_for(20_001)
    probe = spark.range(200_000).selectExpr("concat('v-', id) AS id", "id % 7 = 0 and id < 140000 AS wanted")
    hit = idfilter.might_contain(idfilter.build(ids, words), words, F.col("id"))
    got = probe.withColumn("hit", hit).groupBy("wanted").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n")).collect()
    by = {r["wanted"]: r for r in got}
    assert by[True]["hits"] == by[True]["n"] == 20_000
    assert by[False]["hits"] / by[False]["n"] < 0.002


def test_filters_merge_and_stay_within_their_limit(spark):
    parts = [spark.range(i * 500, i * 500 + 500).selectExpr("cast(id AS string) AS request_id") for i in range(3)]
    words = idfilter.words_for(1500)
    whole = idfilter.build(parts[0].union(parts[1]).union(parts[2]), words)
    merged = idfilter.merge(*[idfilter.build(p, words) for p in reversed(parts)])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    assert idfilter.words_for(0) == 64 and idfilter.words_for(10 ** 12) == idfilter.MOST_WORDS and idfilter.words_for(10 ** 12, most_words=1000) == 512
    tiny = idfilter.build(parts[0], 64)  # far too small: lets much through, misses nothing
    hit = idfilter.might_contain(tiny, 64, F.col("request_id"))
    assert parts[0].filter(hit).count() == 500
    empty = idfilter.might_contain(idfilter.build(parts[0].limit(0), 64), 64, F.col("request_id"))
    assert parts[0].filter(empty).count() == 0


def test_rows_that_reach_the_shuffle(spark, lines):
    """At most 1.1 rows are parsed and shuffled for every row that matches."""
    rng = random.Random(1)
    oom = rng.sample(range(60_000), 900)
    errs = parse_php_error(lines([f'[05-Jan-2024 10:00:00 UTC] PHP Fatal error: Allowed memory size of 1 request_id="v-{i}"' for i in oom]))
    access = lines([LINE.format(i % 30, i) for i in range(60_000)] + ["broken line", None, 'no id request_id=""'])
    kept = traffic.oom_candidates(errs, access)
    assert 900 <= kept.count() <= 990
    want = traffic.oom_paths(errs, parse_access(access)).collect()
    assert traffic.oom_paths_filtered(errs, access).collect() == want != []
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "try_to_timestamp" not in plan  # lines are tested before they are parsed


def test_no_out_of_memory_errors(spark, lines):
    errs = parse_php_error(lines(['[05-Jan-2024 10:00:00 UTC] PHP Notice: x request_id="v-1"']))
    assert traffic.oom_paths_filtered(errs, lines([LINE.format(1, 1)])).collect() == []


# report store


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "t")
    rows = spark.range(120_000, numPartitions=6).selectExpr(
        "date_add(date'2024-01-01', cast(id % 3 AS int)) AS day", "concat('site', if(id % 3 = 0, 0, id % 8)) AS site",
        "cast((id div 7) % 24 AS int) AS hour", "concat('v-', uuid()) AS request_id", "id")
    store.write_store(rows, path, row_group_bytes=64 << 10)
    return rows, path


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_day_is_replaced_and_the_others_keep_their_files(spark, stored):
    rows, path = stored
    before = _files(path)
    again = store.read_store(spark, path).filter("day = '2024-01-02' and id % 2 = 0")
    kept = again.collect()
    store.write_store(spark.createDataFrame(kept, again.schema), path, row_group_bytes=64 << 10)
    after = _files(path)
    other = {f: t for f, t in before.items() if "day=2024-01-02" not in f}
    assert {f: t for f, t in after.items() if "day=2024-01-02" not in f} == other
    assert not set(f for f in before if "day=2024-01-02" in f) & set(after)
    got = store.read_store(spark, path).groupBy("day").count().collect()
    assert {str(r["day"]): r["count"] for r in got} == {"2024-01-01": 40_000, "2024-01-02": 20_000, "2024-01-03": 40_000}


def test_row_groups_are_skipped(spark, stored):
    """Row groups whose minima and maxima can hold one site's hour are few, in the files' own metadata."""
    _, path = stored
    total = fit = 0
    for f in _files(path):
        if "day=2024-01-03" not in f:
            continue
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            stats = {c: meta.row_group(g).column(names.index(c)).statistics for c in ("site", "hour")}
            total += 1
            fit += stats["site"].min <= "site5" <= stats["site"].max and stats["hour"].min <= 7 <= stats["hour"].max
    assert total >= 20 and 1 <= fit <= total / 5


def test_lookup_by_id_reads_one_row_group_at_most(spark, stored):
    _, path = stored
    one = store.read_store(spark, path).filter("id = 99").first()

    def read(request_id):
        df = store.read_store(spark, path).filter(F.col("request_id") == request_id)
        found = df.collect()
        node, rows = df._jdf.queryExecution().executedPlan(), 0
        stack = [node]
        while stack:
            n = stack.pop()
            if n.nodeName().startswith("Scan parquet"):
                rows += n.metrics().apply("numOutputRows").value()
            stack += [n.children().apply(i) for i in range(n.children().size())]
        return found, rows

    found, rows = read(one["request_id"])
    assert [r["id"] for r in found] == [99] and rows < 10_000
    none, rows = read(one["request_id"][:-1] + "g")  # within the minima and maxima, in no Bloom filter
    assert none == [] and rows < 10_000


# increments


def _access(spark, rows):
    """(day, hour, minute, us, status, site) as parsed lines with their delivery."""
    text = ('1.1.1.1 - - [{:02d}/Jan/2024:{:02d}:{:02d}:00 +0000] "GET /x HTTP/1.1" {} 1 "-" "ua" hosting_site={} request_time={} request_id="v"')
    df = spark.createDataFrame([(i, text.format(d, h, m, st, site, us), deliv) for i, (d, h, m, us, st, site, deliv) in enumerate(rows)],
                               "seq long, value string, delivery string")
    return parse_access(df)


def _random_rows(n=600, seed=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        day = rng.randint(1, 6)
        late = rng.random() < 0.1  # a line that comes with the next day's delivery
        rows.append((day, rng.randint(0, 23), rng.randint(0, 59), rng.choice([10, 2_000_000, 5_000_000]), rng.choice([200, 304, 404, 503]),
                     rng.choice(["a", "a", "b"]), f"2024-01-{day + late:02d}"))
    return rows


def test_days_in_any_order_equal_one_run(spark, tmp_path):
    rows = _random_rows()
    df = _access(spark, rows)
    days = sorted({r[6] for r in rows})
    random.Random(5).shuffle(days)
    path = str(tmp_path / "states")
    increments.deliver(increments.hourly_states(_access(spark, rows[:50]).filter(F.col("delivery") == days[0])), path)  # cut short, comes again
    for d in [*days, days[2], days[0]]:
        increments.deliver(increments.hourly_states(df.filter(F.col("delivery") == d)), path)
    for site in ("a", "b", "none"):
        assert increments.hourly_report(spark, path, site).collect() == traffic.hourly_traffic(df, site).collect()
    files = [f for f in _files(path)]
    assert len(files) == len(days)


def test_an_empty_delivery_clears_what_it_had(spark, tmp_path):
    path = str(tmp_path / "states")
    df = _access(spark, _random_rows(60))
    days = sorted(r["delivery"] for r in df.select("delivery").distinct().collect())
    increments.deliver(increments.hourly_states(df), path, days)
    none = increments.hourly_states(df.filter("false"))
    increments.deliver(none, path, days[1:])
    want = traffic.hourly_traffic(df.filter(F.col("delivery") == days[0]), "a").collect()
    assert increments.hourly_report(spark, path, "a").collect() == want
    increments.deliver(none, path, days[:1])
    assert increments.hourly_report(spark, path, "a").collect() == []


def test_states_of_another_bound_are_refused(spark, tmp_path):
    path = str(tmp_path / "states")
    increments.deliver(increments.hourly_states(_access(spark, _random_rows(20)), slow_s=1), path)
    assert increments.hourly_report(spark, path, "a", slow_s=1).count() > 0
    with pytest.raises(Exception, match="another slow_s"):
        increments.hourly_report(spark, path, "a").collect()


def test_ten_minute_increments(spark, tmp_path):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=rng.randint(0, 4000)), rng.randint(0, 99), rng.randint(0, 9999)) for _ in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, queue_us long, exec_us long").withColumn("delivery", F.to_date("ts"))
    path = str(tmp_path / "states")
    for d in (3, 1, 2, 1):
        increments.deliver(increments.ten_minute_states(df.filter(F.dayofmonth("ts") == d)), path)
    assert increments.ten_minute_report(spark, path).collect() == traffic.ten_minute_times(df).collect()


def test_an_id_is_made_once_a_line(spark):
    """A filter written out down to the scan made the id, and what the line is rendered from, a dozen times."""
    raw = spark.createDataFrame([(i, f"k{i}") for i in range(300)] + [(None, None)], "n long, key string")
    lines = raw.select("n", F.concat(F.lit('x request_id="v-'), F.substring("key", 2, 9), F.lit('"')).alias("value"))
    ids = spark.range(0, 300, 7).select(F.concat(F.lit("v-"), F.col("id")).alias("request_id"))
    words = idfilter.words_for(100)
    kept = idfilter.matching(lines, idfilter.build(ids, words), words, F.regexp_extract("value", 'request_id="([^"]*)"', 1))
    assert kept.columns == lines.columns
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    assert {r["n"] for r in kept.collect()} >= set(range(0, 300, 7)) and kept.count() < 100
