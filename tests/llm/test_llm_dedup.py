"""Exact, substring and near-duplicate operators against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import exact_dedup as exact_module
from fleetlens.llm.components import connected_components
from fleetlens.llm.exact_dedup import exact_dedup
from fleetlens.llm.jaccard_join import Similar, near_groups
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("id", F.lit("x")).withColumn("n", F.lit(1.5)).withColumn("size", F.col("doc_id")).withColumn("uid", F.lit(None).cast("int"))


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, sha))
            first = first and i != keep
    return sorted(out, key=str)


EDGES = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (4, "a b"), (5, "A b"), (6, "a  b"), (None, "a b"), (None, "only"), (None, "only"),
         (7, "é\x00\n"), (8, "w " * 60_000), (9, "w " * 60_000), (10, " ")]


@pytest.mark.parametrize("local, bucket", [(1 << 25, 1 << 26), (200, 500)])
def test_exact_dedup(spark, local, bucket):
    rng = random.Random(1)
    rows = EDGES + [(100 + i, f"text {rng.randrange(60)} " * rng.randrange(1, 4)) for i in range(300)] + [(500 + i, "hot") for i in range(200)]
    found = exact_dedup(table(spark, rows).repartition(5), Scratch(spark, "t"), local_bytes=local, bucket_bytes=bucket)
    got = [tuple(r) for r in found.decisions.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute_exact(rows)
    kept = found.survivors
    assert kept.columns == table(spark, rows).columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({t or "" for _, t in rows})


def test_exact_dedup_tells_equal_hashes_apart():
    t = exact_module._Table()
    for uid, (i, text) in enumerate([(1, b"x"), (5, b"y"), (3, b"x")]):
        t.add(42, text, uid, i, 1)
    assert sorted(r[:4] for r in t.rows()) == [(0, 2, 3, 2), (1, 1, 5, 1), (2, 2, 3, 2)]


def test_empty_tables(spark):
    empty = table(spark, [])
    assert exact_dedup(empty, Scratch(spark, "t")).decisions.count() == 0
    assert substring_dedup(empty, Scratch(spark, "t")).count() == 0
    assert near_groups(empty, Scratch(spark, "t")).count() == 0


def brute_substrings(rows, window):
    first, out = {}, []
    words = {k: WORD.findall(t or "") for k, (_, t) in enumerate(rows)}
    for k, (i, _) in enumerate(rows):
        for s in range(len(words[k]) - window + 1):
            key = tuple(words[k][s:s + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for k, (i, _) in enumerate(rows):
        w = words[k]
        gone = {j for s in range(len(w) - window + 1) if i is not None and first[tuple(w[s:s + window])] < i for j in range(s, s + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("index_words, split", [(1 << 20, 4096), (300, 3)])
def test_substring_dedup(spark, index_words, split):
    rng = random.Random(2)
    vocabulary = ["a", "b", "Ä", "c,", "d", "e"] + [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))] for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "De " * 500), (4, "De " * 700), (5, "De " * 30 + "x"), (None, " ".join(passages[0])), (5, "De " * 30 + "x")]
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((10 + i, rng.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(200 + i, " ".join(passages[3])) for i in range(50)]
    rng.shuffle(rows)
    found = substring_dedup(table(spark, rows).repartition(4), Scratch(spark, "t"), window=12, gram=4, index_words=index_words, split=split)
    got = sorted([tuple(r)[:4] for r in found.collect()], key=str)
    assert got == brute_substrings(rows, 12)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None and s], 2):
        if den * len(s & t) >= num * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize("k, num, hot", [(3, 90, 64), (5, 80, 64), (3, 80, 2), (2, 60, 4)])
def test_near_groups(spark, k, num, hot):
    rng = random.Random(k * num + hot)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 80))] for _ in range(8)]
    rows = EDGES[:7] + [(8, "a"), (9, "A"), (None, "a b c d e f"), (10, "a b c d e f"), (11, "a b c d e f g")]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((20 + i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    rng.shuffle(rows)
    found = near_groups(table(spark, rows).repartition(4), Scratch(spark, "t"), how=Similar(k, num, 100), hot=hot)
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute_near(rows, k, num, 100)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(50)] + [(200, 200), (None, 3), (301, 300), (300, 301)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"))
    want = {i: 1 for i in range(1, 61)} | {100 + i: 100 for i in range(50)} | {300: 300, 301: 300}
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_entries_of_long_lists_do_not_meet_their_cells_one_by_one(spark, monkeypatch):
    """Near copies in long lists: groups met their components in every entry of their prefix."""
    common = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*common[:20], f"x{i}", f"y{i}", f"z{i}", *common[20:40 + i % 2 * 20]])) for i in range(60)]
    plans, write = {}, Scratch.write

    def spied(self, df, name, *args):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, df, name, *args)

    monkeypatch.setattr(Scratch, "write", spied)
    how = Similar(3, 60, 100)
    found = near_groups(table(spark, rows).repartition(4), Scratch(spark, "t"), how=how, hot=8)
    sets = {i: {tuple(t.split()[a:a + 3]) for a in range(len(t.split()) - 2)} for i, t in rows}
    component = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]):
                old, to = max(component[a], component[b]), min(component[a], component[b])
                component = {k: to if v == old else v for k, v in component.items()}
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == component
    assert "spanning1" in plans and "Generate inline" in plans["spanning1"]
