"""Parse quality, file discovery, drifting records and phrase indexes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import patterns, traffic, watchdog
from fleetlens.operators.common import top_counts
from fleetlens.sources import discovery, drift, quality
from fleetlens.sources.parse import parse_access, parse_php_error, parse_watchdog_pipe

GOOD = '1.1.1.1 - - [05/Jan/2024:10:00:00 +0000] "GET /p HTTP/1.1" 503 1 "-" "ua" hosting_site=s request_time=1 request_id="v-1"'


# parse quality

def test_figures_equal_a_count_and_cost_no_scan(spark, tmp_path):
    rng = random.Random(1)
    texts = [rng.choice([GOOD, GOOD, "broken", GOOD.replace("503", "abc"), GOOD.replace("05/Jan", "99/Foo"), ""]) for _ in range(300)]
    spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, seq long, value string").write.parquet(str(tmp_path / "l"))
    lines = spark.read.parquet(str(tmp_path / "l"))
    watched = quality.Quality("access")
    report = traffic.top_error_paths(watched.watch(parse_access(lines)))
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert report.collect() == traffic.top_error_paths(parse_access(lines)).collect()
    got, all_ = watched.figures(), parse_access(lines)
    bad = "ts is null or coalesce(method, '') = '' or coalesce(path, '') = '' or status_code is null"
    assert got["lines"] == 300 and got["malformed"] == all_.filter(bad).count() > 50
    assert got["no_status_code"] == all_.filter("status_code is null").count()
    row = watched.report(spark).first()
    assert (row["log"], row["lines"], row["malformed_share"]) == ("access", 300, got["malformed"] / 300)


def test_figures_of_other_logs_and_of_no_lines(spark, lines):
    errors = quality.Quality("errors", quality.ERROR_NEEDS)
    errors.watch(parse_php_error(lines(["[05-Jan-2024 10:00:00 UTC] x", "no time", None]))).collect()
    assert errors.figures() == {"lines": 3, "malformed": 2, "no_ts": 2}
    dog = quality.Quality("watchdog", quality.WATCHDOG_NEEDS)
    watchdog.top_types(dog.watch(parse_watchdog_pipe(lines(["a|1|t|i|u|r|0|l|m", "a|1|t"])))).collect()
    assert dog.figures()["malformed"] == 1
    none = quality.Quality("none")
    none.watch(parse_access(lines([]))).collect()
    assert none.figures()["lines"] == 0 and none.report(spark).first()["malformed_share"] is None


# discovery

def _land(folder, name, text, time):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (time, time))


def test_newest_files_are_pruned_from_the_listing(spark, tmp_path):
    d = tmp_path / "logs"
    for i in range(8):
        _land(d, f"a {i}.log", f"line {i}\n", 1_700_000_000 + (i // 2) * 100)  # pairs of equal times
    for n in (1, 3, 5, 8, 20):
        df = discovery.read_newest(spark, str(d), n)
        assert sorted(r["value"] for r in df.collect()) == [f"line {i}" for i in range(8)][-n:]
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().apply(0)
        read = plan.metrics().apply("numFiles").value()
        assert read <= min(8, n + 1)
    assert discovery.read_newest(spark, str(d / "a 0.log"), 3).count() == 1


def test_a_second_run_reads_only_new_files(spark, tmp_path):
    d, log = tmp_path / "logs", str(tmp_path / "log")
    seen = []

    def run():
        got = sorted(r["value"] for r in discovery.read_new(spark, str(d), log).collect())
        discovery.mark_read(spark, str(d), log)
        seen.extend(got)
        return got

    _land(d, "a.log", "a1\na2\n", 1_700_000_000)
    _land(d, "b c.log", "b\n", 1_700_000_100)
    assert run() == ["a1", "a2", "b"] and run() == []
    _land(d, "d.log", "d\n", 1_700_000_100)  # the same tick as the newest one
    _land(d, "e%20.log", "e\n", 1_700_000_200)
    assert run() == ["d", "e"] and run() == []
    _land(d, "f.log", "f\n", 1_700_000_200)
    assert run() == ["f"] and run() == [] and sorted(seen) == ["a1", "a2", "b", "d", "e", "f"]
    assert spark.read.parquet(log).count() < 30


# drifting records

SCHEMA = T.StructType([T.StructField("number", T.LongType()), T.StructField("title", T.StringType()),
                       T.StructField("user", T.StructType([T.StructField("id", T.LongType()), T.StructField("login", T.StringType())])),
                       T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
                       T.StructField("hits", T.MapType(T.StringType(), T.LongType()))])


def test_an_added_a_missing_and_a_retyped_field(spark, tmp_path):
    plain = {"number": 1, "title": "t", "user": {"id": 7, "login": "u"}, "labels": [{"name": "a"}, {"name": "b"}], "hits": {"x": 1}}
    page = [plain, plain | {"number": "2", "extra": [1, {"a": None}]}, {k: v for k, v in plain.items() if k not in ("title", "hits")} | {"number": 3},
            plain | {"number": 4, "user": None, "labels": "none"}, plain | {"number": "five", "user": "u", "title": 12}, 17, None, "text", [1]]
    texts = [json.dumps(page), json.dumps(plain | {"number": 6}), "{broken", "", "  ", json.dumps([]), '"only text"']
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text("\n".join(texts) + "\n")
    recs, odd = drift.read_drifting(spark, str(tmp_path / "p"), SCHEMA)
    got = {(r["number"], r["title"]): r for r in recs.collect()}
    assert recs.schema.names == SCHEMA.names and set(got) == {(1, "t"), (2, "t"), (3, None), (4, "t"), (None, "12"), (6, "t")}
    assert got[2, "t"]["user"]["id"] == 7 and [x["name"] for x in got[2, "t"]["labels"]] == ["a", "b"] and got[1, "t"]["hits"] == {"x": 1}
    assert got[3, None]["hits"] is None and got[4, "t"]["user"] is None and got[4, "t"]["labels"] is None and got[None, "12"]["user"] is None
    assert sorted(r["text"] for r in odd.collect()) == ['"only text"', '"text"', "17", "[1]", "null", "{broken"]


def test_plain_pages_read_as_with_a_schema(spark, tmp_path):
    from fleetlens.sources.tables import read_records

    rows = [{"number": i, "title": f"t{i}", "user": {"id": i, "login": f"u{i}"}, "labels": [{"name": str(k)} for k in range(i % 3)], "hits": {}} for i in range(20)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text("\n".join(json.dumps(rows[i:i + 5]) for i in range(0, 20, 5)) + "\n")
    want = read_records(spark, str(tmp_path / "p"), SCHEMA, multi_line=False)
    got, odd = drift.read_drifting(spark, str(tmp_path / "p"), SCHEMA)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and odd.count() == 0


# phrases

@pytest.mark.parametrize("seed", range(3))
def test_phrases_equal_the_alternation(spark, seed):
    rng = random.Random(seed)
    words = ["out", "of", "memory", "kill", "process", "AH_X", "a.b", "é", "x|y", "(php)", "mem", "or"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(200)] + [None, "", "out of memory" * 400]
    phrases = {t[a:a + rng.randint(1, 14)] for t in texts if t for a in [rng.randrange(len(t))]} | {"of", "zz", " ", "no such", ".", "|"}
    phrases = sorted(p for p in phrases if p)
    lines = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "seq long, value string, key string")
    table = spark.createDataFrame([(p,) for p in [*phrases, phrases[0], "", None]], "phrase string")
    got = patterns.matches(lines, table)
    assert got.columns == ["seq", "value", "key", "phrase"]
    want = sorted((i, p) for i, t in enumerate(texts) for p in phrases if t and p in t)
    assert sorted((r["seq"], r["phrase"]) for r in got.collect()) == want
    some = patterns.matching_lines(lines, table, ["seq"])
    assert sorted(r["seq"] for r in some.collect()) == sorted({i for i, _ in want})
    assert patterns.matches(lines, table.filter("false")).count() == 0 and patterns.matches(lines.filter("false"), table).count() == 0


def test_cost_does_not_follow_the_number_of_phrases(spark):
    """Line keys that meet the index: as many with 20,000 more phrases of other words."""
    lines = spark.range(5000).selectExpr("id AS seq", "concat('host ', id % 50, ' kernel: event ', id % 700, ' of kind ', id % 7) AS value")
    few = spark.range(5).selectExpr("concat(' event ', id, ' of') AS phrase")
    many = few.union(spark.range(20_000).selectExpr("concat(' other', id, ' of kind') AS phrase"))

    def joined(phrases):
        filed = patterns.file_phrases(phrases, lines)
        cut = lines.select(F.explode(patterns._line_keys(F.col("value"), False)).alias("k"))
        return cut.join(filed, F.col("k") == F.col("key")).count()

    assert joined(many) == joined(few) > 0
    assert top_counts(patterns.matches(lines, many), ["phrase"], 3).collect() == top_counts(patterns.matches(lines, few), ["phrase"], 3).collect()


def test_lines_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    """Few bytes on disk, many keys: their rows, one for each line and key, were sent to every executor."""
    spark.range(3000).selectExpr("id AS seq", "concat(repeat('abcd efgh ', 20), id) AS value").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    phrases = spark.range(300).selectExpr("concat('d efgh ', id) AS phrase")
    found = patterns.matches(lines, phrases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_filed" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert found.count() == sum(str(s).startswith(str(p)) for s in range(3000) for p in range(300))
