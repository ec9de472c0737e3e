"""Live checks with carried state and the live correlation, replayed in small batches against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import fleet, traffic
from fleetlens.sources.parse import parse_access, parse_php_error
from fleetlens.streaming import carry, correlate, live

SCHEMA = "file string, seq long, value string, event_time timestamp"
START = dt.datetime(2024, 1, 5, 10)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = {k: spark.conf.get(k, None) for k in carry.STATE_CONF}
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for k, v in carry.STATE_CONF.items():
        spark.conf.set(k, v)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Replay:
    """Segments land one after another; every ``run`` is a restart from the checkpoint."""

    def __init__(self, spark, folder, build):
        self.spark, self.folder, self.build, self.n = spark, folder, build, 0
        (folder / "in").mkdir()

    def land(self, rows):
        """One more segment of (file, seq, value, minute) rows, its file the newest."""
        frame = self.spark.createDataFrame([(f, s, v, START + dt.timedelta(minutes=m)) for f, s, v, m in rows], SCHEMA).coalesce(1)
        out = self.folder / f"part{self.n}"
        frame.write.parquet(str(out))
        import os
        import shutil
        for f in out.glob("*.parquet"):
            to = self.folder / "in" / f"{self.n:04d}.parquet"
            shutil.copy(f, to)
            os.utime(to, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def run(self):
        stream = carry.read_segments(self.spark, str(self.folder / "in"), SCHEMA, late="10 minutes")
        return self.spark.read.parquet(live.run_bounded(self.build(stream), str(self.folder)))

    def finish(self):
        """Move event time on twice: the first closes idle files, the second shows them."""
        for i in (5000, 9000):
            self.land([("__end__", i, "", i)])
            out = self.run()
        return out.filter("file != '__end__'")


def _lines(seed, texts, files=3, n=150):
    """Interleaved lines of several files in several segments; a line's time grows with its number."""
    rng = random.Random(seed)
    rows = [(f"f{rng.randrange(files)}", i, rng.choice(texts), i / 2) for i in range(n)]
    cuts = sorted(rng.sample(range(1, n), 4))
    return rows, [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n])]


def _batch(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], "file string, seq long, value string")


def _same(got, want, cols):
    return sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


PROCS = ["[srv-a]", "[srv-b]", "site1 2", "site1 0.7", "site2 5", "7 procs running", "MaxProcessCount 9", "DefaultMaxClass 1", "Mem: 1000 900 100", "x 1 defunct", "noise"]
REALMS = ["[A]:", "[B]:", "[C]:", " s1.prod 1", " s2.test 2", " s3.prod 3", "noise"]
AUDIT = ["page_cache_maximum_age 0", " cache  0", "Enabled  none", "Enabled ok", "fine", "more"]


def test_process_capacity_live(spark, tmp_path):
    rows, parts = _lines(1, PROCS)
    replay = Replay(spark, tmp_path, lambda s: carry.process_capacity_stream(s, "site1"))
    for k, part in enumerate(parts):
        rng = random.Random(k)
        replay.land(rng.sample(part, len(part)))  # lines of one batch in any order
        if k in (1, 3):
            replay.run()
    got, want = replay.finish(), fleet.process_capacity(_batch(spark, rows), "site1")
    assert sorted(got.columns) == sorted(want.columns) and want.count() > 5
    assert _same(got, want, sorted(want.columns))


def test_resolve_sections_live(spark, tmp_path):
    labels = spark.createDataFrame([("A", "a"), ("B", "b")], "label string, code string")
    rows, parts = _lines(2, REALMS)
    replay = Replay(spark, tmp_path, lambda s: carry.resolve_sections_stream(s, labels))
    for part in parts:
        replay.land(part)
        replay.run()
    want = fleet.resolve_sections(_batch(spark, rows), labels)
    assert _same(replay.finish(), want, sorted(want.columns)) and want.filter("chosen").count() == 3


@pytest.mark.parametrize("head", [10, 0])
def test_cache_audit_live(spark, tmp_path, head):
    rows, parts = _lines(3 + head, AUDIT)
    replay = Replay(spark, tmp_path, lambda s: carry.cache_audit_stream(s, head=head))
    replay.land(parts[0])
    replay.run()
    for part in parts[1:]:
        replay.land(part)
    got = replay.run().filter("file != '__end__'")
    want = fleet.cache_audit(_batch(spark, rows), head=head)
    assert _same(got, want, sorted(want.columns)) and want.filter("highlight").count() > 3


def test_an_idle_file_leaves_the_state(spark, tmp_path):
    """State follows the files in use: an idle file's section is put out and its state dropped."""
    replay = Replay(spark, tmp_path, lambda s: carry.process_capacity_stream(s, "site1", idle_ms=600_000))
    replay.land([(f"f{i}", i, "[srv-a]", 0) for i in range(20)] + [(f"f{i}", 100 + i, "site1 2", 1) for i in range(20)])
    assert replay.run().count() == 0
    replay.land([("late", 500, "[srv-b]", 200)])
    replay.run()
    replay.land([("late", 501, "Mem: 10 1 9", 201)])
    out = replay.run()
    assert out.count() == 20 and {r["user_running"] for r in out.collect()} == {1}
    # one of them again: nothing is carried over from before
    replay.land([("f1", 600, "site1 5", 202), ("f1", 601, "[srv-c]", 202), ("f1", 602, "site1 1", 202)])
    got = {(r["file"], r["server"], r["user_running"]) for r in replay.finish().collect()}
    assert {g for g in got if g[1] != "srv-a"} == {("late", "srv-b", 0), ("f1", "srv-c", 1)}


def test_lines_that_come_after_later_ones_are_left_out(spark, tmp_path):
    replay = Replay(spark, tmp_path, lambda s: carry.cache_audit_stream(s, head=0))
    replay.land([("f", 10, " cache  0", 0), ("f", 20, "Enabled ok", 1)])
    replay.run()
    replay.land([("f", 15, "Enabled late", 2), ("f", 30, "Enabled ok", 3)])
    assert sorted((r["seq"], r["highlight"]) for r in replay.run().collect()) == [(20, True), (30, False)]


# ---------------------------------------------------------------- correlation of two streams

def _access(i, m):
    return (f'1.1.1.1 - - [{START + dt.timedelta(minutes=m):%d/%b/%Y:%H:%M:%S} +0000] "GET /p{i % 4} HTTP/1.1" 500 1 "-" "ua" '
            f'hosting_site=s request_time=1 request_id="v-{i}"')


def _error(i, m):
    return f'[{START + dt.timedelta(minutes=m):%d-%b-%Y %H:%M:%S} UTC] PHP Fatal error: Allowed memory size of 1 request_id="v-{i}"'


def test_oom_paths_live(spark, tmp_path):
    """Two logs whose lines arrive late within the allowance and in different batches; the state shrinks."""
    rng = random.Random(6)
    for d in ("access", "errors"):
        (tmp_path / d).mkdir()
    access = [(i, i / 5) for i in range(600)]
    errors = [(i, i / 5 + rng.choice([-3, 0, 2])) for i in range(0, 600, 7)] + [(i, i / 5) for i in range(0, 600, 21)]  # some twice

    def run():
        streams = [live.read_line_stream(spark, str(tmp_path / d), max_files_per_trigger=1) for d in ("errors", "access")]
        q = live.start_to_files(correlate.oom_hits_stream(*streams, within="5 minutes", late="15 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
        return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]

    import os
    sizes, n = [], 0
    for lo in range(0, 120, 20):
        for d, rows, text in (("access", access, _access), ("errors", errors, _error)):
            # a line may come up to 10 minutes after its time
            here = [r for r in rows if lo <= r[1] + (r[0] % 3) * 5 - 0 < lo + 20 or (lo == 100 and r[1] + (r[0] % 3) * 5 >= 120) or (lo == 0 and r[1] < 0)]
            f = tmp_path / d / f"{n:03d}.log"
            f.write_text("\n".join(text(*r) for r in rng.sample(here, len(here))) + "\n")
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
            n += 1
        sizes += run()
    for d, text in (("access", _access), ("errors", _error)):
        for m in (9000, 9001):
            f = tmp_path / d / f"{n:03d}.log"
            f.write_text(text(10 ** 6 + n, m) + "\n")
            os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
            n += 1
    sizes += run()
    hits = spark.read.parquet(str(tmp_path / "out"))
    frames = [spark.createDataFrame([("f", k, t(*r)) for k, r in enumerate(rows)], "file string, seq long, value string")
              for rows, t in ((errors, _error), (access, _access))]
    want = traffic.oom_paths(parse_php_error(frames[0]), parse_access(frames[1]))
    from fleetlens.operators.common import top_counts
    assert {r["request_id"] for r in hits.collect()} == {f"v-{i}" for i, _ in errors}
    assert top_counts(hits, ["method", "path", "protocol", "status"], 10).collect() == want.collect()
    assert hits.count() == hits.select("request_id").distinct().count() == len({i for i, _ in errors})
    assert max(sizes) > 100 and sizes[-1] < 10  # all that waited is gone
    assert hits.filter(F.col("event_time").isNull()).count() == 0


def test_sections_are_folded_without_a_loop_over_lines(monkeypatch):
    """All lines of a file pass one worker: a loop over them took most of a replay."""
    import pandas as pd

    def stop(*_, **__):
        raise AssertionError("line by line")

    monkeypatch.setattr(pd.DataFrame, "itertuples", stop)
    fold, carry_ = carry._Sections(), dict.fromkeys(f.name for f in carry._Sections.carried.fields)
    rows = pd.DataFrame({"server": [None, "a", None, None, "b", "a", None], "user_running": [1, 0, 1, 1, 0, 0, 1],
                         "max_overall": [9, None, 3, 4, None, None, None], "total_running": [9, None, None, 2, None, None, 7],
                         "max_user": [None] * 7, "total_mem": [None] * 7, "free_mem": [None] * 7})
    out = fold.step(carry_, rows)
    assert out[["server", "max_overall", "total_running", "user_running"]].values.tolist() == [["a", 4, 2, 2], ["b", None, 0, 0]]
    assert carry_["server"] == "a" and carry_["user_running"] == 1 and carry_["total_running"] == 7 and carry_["max_overall"] is None
    more = fold.step(carry_, rows.iloc[:2])
    assert more[["server", "max_overall", "total_running", "user_running"]].values.tolist() == [["a", 9, 9, 2]]
