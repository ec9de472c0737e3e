import os

from fleetlens.operators import traffic
from fleetlens.sources.parse import parse_access
from fleetlens.streaming import live


def _line(day, hh, mm, site="site1", us=1000, status=200):
    return (f'10.0.0.1 - - [{day:02d}/Jan/2024:{hh:02d}:{mm:02d}:00 +0000] "GET /x HTTP/1.1" {status} 100 "-" "ua" '
            f'hosting_site={site} request_time={us} request_id="v-1"')


def test_stream_windows_equal_batch_and_late_rows_dropped(spark, tmp_path, lines):
    src = tmp_path / "in"
    src.mkdir()
    first = [_line(5, 10, m) for m in range(0, 60, 7)] + [_line(5, 11, 5, us=4_000_000, status=503)]
    (src / "a.log").write_text("\n".join(first) + "\n")
    query = live.hourly_traffic_stream(live.read_line_stream(spark, str(src)), "site1")
    base = str(tmp_path / "run")
    out = live.run_bounded(query, base)
    # later file: one late line (two hours behind the watermark) and the flush marker
    (src / "b.log").write_text(_line(5, 8, 0) + "\n" + _line(6, 0, 0, site="other") + "\n")
    live.run_bounded(query, base)
    (src / "c.log").write_text(_line(7, 0, 0, site="other") + "\n")
    live.run_bounded(query, base)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    exp = sorted(tuple(r) for r in traffic.hourly_traffic(parse_access(lines(first)), "site1").collect())
    assert got == exp and len(got) == 2
    assert os.path.isdir(os.path.join(base, "checkpoint"))


def test_error_counts_stream_complete(spark, tmp_path):
    src = tmp_path / "err"
    src.mkdir()
    (src / "e.log").write_text('[05-Jan-2024 10:00:00 UTC] PHP Notice:  x request_id="v-1"\n'
                               '[05-Jan-2024 10:00:01 UTC] PHP Notice:  x request_id="v-2"\n')
    q = (live.error_counts_stream(live.read_line_stream(spark, str(src))).writeStream.outputMode("complete")
         .format("memory").queryName("errcounts").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.sql("SELECT * FROM errcounts").collect()
    assert [(x.message, x.n) for x in r] == [(" PHP Notice:  x", 2)]
