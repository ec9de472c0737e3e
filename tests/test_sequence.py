"""The chunked prefix scans against a plain Python loop, with tiny chunks so that
carries cross many chunk boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.sequence import forward_fill, previous_value, running, running_any, running_count


def _frame(spark, n=300, files=3, seed=7, gaps=True):
    rnd = random.Random(seed)
    rows, seq = [], 0
    for i in range(n):
        seq += rnd.choice([1, 1, 2, 5]) if gaps else 1
        rows.append((f"f{rnd.randrange(files)}", seq, rnd.choice([None, None, "a", "b", "c"]), rnd.randrange(3)))
    return rows, spark.createDataFrame(rows, "file string, seq long, v string, x int")


def _by_file(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("bits", [0, 2, 4, 20])
def test_forward_fill_and_prev(spark, bits):
    rows, df = _frame(spark)
    got = {(r.file, r.seq): (r.ff, r.pv) for r in
           previous_value(forward_fill(df, "v", "seq", "ff", "file", bits), "v", "seq", "pv", "file", bits).collect()}
    for f, rs in _by_file(rows).items():
        last, prev = None, None
        for i, r in enumerate(rs):
            if r[2] is not None:
                last = r[2]
            assert got[(f, r[1])] == (last, prev), (f, r)
            prev = r[2]


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_count_and_any(spark, inclusive):
    rows, df = _frame(spark, seed=11)
    got = running_count(df, F.col("x") == 2, "seq", "c", "file", inclusive, chunk_bits=2)
    got = running_any(got, F.col("x") == 1, "seq", "a", "file", inclusive, chunk_bits=3)
    res = {(r.file, r.seq): (r.c, r.a) for r in got.collect()}
    for f, rs in _by_file(rows).items():
        c, a = 0, False
        for r in rs:
            if inclusive:
                c += r[3] == 2
                a = a or r[3] == 1
                assert res[(f, r[1])] == (c, a)
            else:
                assert res[(f, r[1])] == (c, a)
                c += r[3] == 2
                a = a or r[3] == 1


def test_running_without_partition(spark):
    rows, df = _frame(spark, files=1, seed=3)
    got = [r.s for r in running(df, F.col("x"), "sum", "seq", "s", None, True, 1).orderBy("seq").collect()]
    acc, exp = 0, []
    for r in sorted(rows, key=lambda r: r[1]):
        acc += r[3]
        exp.append(acc)
    assert got == exp
