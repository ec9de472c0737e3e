import datetime as dt


from fleetlens.functions.text import awk_field, cut_field, cut_from, replace_first, strip_request_id
from fleetlens.sources.parse import normalize_error, parse_access, parse_php_error, parse_watchdog

GOOD = ('10.0.0.7 - - [05/Jan/2024:10:11:12 +0000] "GET /node/3 HTTP/1.1" 200 100 "-" '
        '"Drupal (+http://example.org/)" hosting_site=site1 request_time=3000001 request_id="v-12"')


def test_parse_access_good_line(lines):
    r = parse_access(lines([GOOD])).collect()[0]
    assert r.ts == dt.datetime(2024, 1, 5, 10, 11, 12)
    assert (r.method, r.path, r.protocol, r.status, r.status_code) == ("GET", "/node/3", "HTTP/1.1", "200", 200)
    assert r.user_agent == "Drupal (+http://example.org/)"
    assert (r.site, r.request_us, r.request_id) == ("site1", 3000001, "v-12")


def test_parse_access_keeps_malformed_rows(lines):
    bad = [
        "",
        "no quotes at all here",
        GOOD.replace(" request_time=3000001", ""),
        GOOD.replace("05/Jan/2024", "99/Foo/2024"),
        GOOD.replace('" 200 100', '" abc 100'),
        GOOD.replace("request_time=3000001", "request_time=xyz"),
    ]
    rows = parse_access(lines(bad)).orderBy("seq").collect()
    assert len(rows) == len(bad)
    assert rows[0].ts is None and rows[0].request_us is None
    assert rows[1].user_agent == "no quotes at all here"  # cut returns the whole line
    assert rows[2].request_us is None
    assert rows[3].ts is None and rows[3].path == "/node/3"
    assert rows[4].status == "abc" and rows[4].status_code is None
    assert rows[5].request_us == 0  # awk coerces non-numeric to 0


def test_field_helpers(spark):
    df = spark.createDataFrame([("  a  b c",), ("x|y|z",), ("nodelim",)], "v string")
    r = df.select(awk_field("v", 2).alias("f2"), awk_field("v", 9).alias("f9"),
                  cut_field("v", "|", 2).alias("c2"), cut_from("v", "|", 2).alias("c2p")).collect()
    assert [x.f2 for x in r] == ["b", None, None]
    assert all(x.f9 is None for x in r)
    assert [x.c2 for x in r] == ["  a  b c", "y", "nodelim"]
    assert [x.c2p for x in r] == ["  a  b c", "y|z", "nodelim"]


def test_replace_first_only_first(spark):
    df = spark.createDataFrame([('m request_id="a" n request_id="b"',)], "v string")
    assert df.select(strip_request_id("v")).first()[0] == 'm n request_id="b"'
    df2 = spark.createDataFrame([("x1 x2 x3",)], "v string")
    assert df2.select(replace_first("v", "x[0-9]", "Y")).first()[0] == "Y x2 x3"


def test_normalize_error(lines):
    ln = ('[05-Jan-2024 10:11:12 UTC] PHP Fatal error:  Allowed memory size of 1 bytes exhausted '
          '(tried to allocate 12345 bytes) in /a.php request_id="v-1"')
    df = parse_php_error(lines([ln, "no bracket line"]))
    r = df.orderBy("seq").collect()
    assert r[0].message_key == " PHP Fatal error:  Allowed memory size of 1 bytes exhausted " \
                               "(tried to allocate [number] bytes) in /a.php"
    assert r[0].request_id == "v-1" and r[0].ts == dt.datetime(2024, 1, 5, 10, 11, 12)
    assert r[1].message_key == "no bracket line"
    assert lines(["]x tried to allocate 1 tried to allocate 2"]).select(normalize_error("value")).first()[0] == \
        "x tried to allocate [number] tried to allocate 2"


PIPE = 'Jan 05 10:11:12 host1 site1: http://site1.example.com|1704449472|cron|10.0.0.1|/cron.php||7||msg 3 exception request_id="v-9"'
SEMI = ('Jan 05 10:11:12 host1 site1: msg 3 exception request_id="v-9"; http://site1.example.com; 1704449472; cron; '
        '10.0.0.1; /cron.php; -; 7')


def test_watchdog_layouts_parse_equal(lines):
    cols = ["head", "epoch", "type", "ip", "uri", "referer", "uid", "link", "message"]
    a = parse_watchdog(lines([PIPE], file="a")).select(*cols).collect()
    b = parse_watchdog(lines([SEMI], file="b")).select(*cols).collect()
    assert a == b
    assert a[0].type == "cron" and a[0].message == 'msg 3 exception request_id="v-9"'


def test_watchdog_message_with_colons_kept_whole(lines):
    semi = SEMI.replace("msg 3 exception", "error: disk: full")
    r = parse_watchdog(lines([semi])).first()
    assert r.message == 'error: disk: full request_id="v-9"'


def test_watchdog_detection_is_per_file(lines):
    df = lines([PIPE], file="a").unionByName(lines([SEMI], file="b"))
    r = parse_watchdog(df).select("file", "type").orderBy("file").collect()
    assert [x.type for x in r] == ["cron", "cron"]


def test_lines_are_not_shuffled_by_file(spark):
    """All lines of a file met in one task, where each got its file's layout."""
    lines = spark.range(500).selectExpr("if(id % 9 = 0, null, concat('f', id % 2)) AS file", "id AS seq", "concat('a|', id) AS value")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        parsed = parse_watchdog(lines)
        plan = parsed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r["seq"] for r in parsed.collect()) == list(range(500))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
