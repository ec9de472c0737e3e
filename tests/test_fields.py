"""Field helpers against plain-Python awk / cut semantics on random lines."""

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.functions.text import awk_field, cut_field, cut_from

ALPHABET = st.sampled_from(list("ab|\"  \t-=x1"))


def py_awk(line, n):
    f = line.replace("\t", " ").split()
    return f[n - 1] if n <= len(f) else None


def py_cut(line, delim, n):
    if delim not in line:
        return line
    parts = line.split(delim)
    return parts[n - 1] if n <= len(parts) else ""


def py_cut_from(line, delim, n):
    if delim not in line:
        return line
    return delim.join(line.split(delim)[n - 1:])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=1, max_size=40))
def test_field_helpers_match_awk_and_cut(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, v string")
    cols = [awk_field("v", n).alias(f"a{n}") for n in (1, 2, 6, 9)]
    cols += [cut_field("v", '"', n).alias(f"q{n}") for n in (1, 2, 6)]
    cols += [cut_field("v", "|", 3).alias("p3"), cut_from("v", "|", 2).alias("pf2")]
    got = {r.i: r for r in df.select("i", *cols).collect()}
    for i, line in enumerate(lines):
        r = got[i]
        assert [r[f"a{n}"] for n in (1, 2, 6, 9)] == [py_awk(line, n) for n in (1, 2, 6, 9)], line
        assert [r[f"q{n}"] for n in (1, 2, 6)] == [py_cut(line, '"', n) for n in (1, 2, 6)], line
        assert r.p3 == py_cut(line, "|", 3) and r.pf2 == py_cut_from(line, "|", 2), line
