"""Registered queries on the smallest tables: against their SQL, and whole tables in and out."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm.oracle import ORACLES
from fleetlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["op4_quality", "op7_langid", "op11_passage_quality"])
def test_one_row_per_document(spark, con, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == [r[0] for r in con.execute("select doc_id from documents order by 1").fetchall()]


def test_pipeline_stages_act_on_what_is_kept(spark):
    """Each stage against plain Python on the previous stage's rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(
        [(9000, None, "en", "src0", 0), (9001, "12 34 !!", "en", "src0", 8), (9002, "12 34 !!", "en", "src1", 8)],
        "doc_id long, text string, lang string, source string, n_chars long"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else None
        n_before = docs.count()
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.collect()
        seen[name] = rows
        if name == "language":
            assert {r["doc_id"] for r in rows} == set(before) - {9000, 9001, 9002}
        elif name == "exact":
            best = {}
            for r in before.values():
                best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
            assert {r["doc_id"] for r in rows} == set(best.values()) and len(rows) == len(best)
        elif name == "near":
            words = {i: r["text"].lower().split() for i, r in before.items()}
            sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
            root = {i: i for i in sets}
            for a in sorted(sets):
                for b in sorted(sets):
                    if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = root[a], root[b]
                        root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
            assert {r["doc_id"] for r in rows} == set(root.values())
        elif name == "sources":
            taken = {}
            for r in rows:
                taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
            share = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted({r["source"] for r in before.values()}))}
            total = sum(len(r["text"].split()) for r in before.values())
            free = {s for s in taken if taken[s] < 3 * sum(len(r["text"].split()) for r in before.values() if r["source"] == s)}
            level = max(taken[s] / share[s] for s in free)
            assert all(abs(taken[s] - level * share[s]) <= share[s] + 1 for s in free) and abs(sum(taken.values()) - total) <= len(taken)
        else:
            assert n_before <= len(rows) and {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            filled = {}
            for r in rows:
                filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert all(sum(n for _, n in p) <= 2048 for p in filled.values())
            assert len(filled) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
        docs = spark.createDataFrame(rows, out.schema) if name != "packing" else out
    assert corpus_pipeline.ORACLE_SQL is None
    whole = corpus_pipeline.run(spark, SF)
    assert whole.select(F.count("*")).first()[0] > 0
