"""Stages of the pipeline on rows that share an id or have none, empty tables, and further columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)
BASE = " ".join(f"word{i}" for i in range(200))
NEAR = BASE.replace("word100", "other")


def docs(spark, rows, parts=1):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(parts)


def kept(df):
    return sorted(((str(r["doc_id"]), r["text"][:40] if r["text"] else r["text"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 4])
def test_near_judges_rows_not_ids(spark, parts):
    """Unlike rows of one id stay, near copies of one id or without any go but for one."""
    rows = [(3, BASE, "a"), (7, NEAR, "a"), (7, "quite another text of its own", "a"), (None, NEAR + " end", "a"), (None, "no id one two three four", "b"),
            (None, "no id one two three four", "b"), (9, "nine " * 30, "b"), (9, "nine " * 30, "b"), (10, "", "b"), (11, None, "b"), (12, "", "b")]
    out = STAGE["near"](spark, docs(spark, rows, parts), "")
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    want = [(3, BASE), (7, "quite another text of its own"), (None, "no id one two three four"), (9, "nine " * 30), (10, ""), (11, None), (12, "")]
    assert kept(out) == sorted(((str(i), t[:40] if t else t) for i, t in want), key=str)


def test_near_over_many_rows_and_stored_files(spark, tmp_path):
    """Groups of copies in many partitions of stored files: one row of each stays, others all."""
    rows = [(i % 90, f"{BASE} tail{i % 40}" if i % 3 else f"alone number {i} of its kind {i * 7} {i * 11}", "a") for i in range(600)]
    docs(spark, rows, 7).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    got = STAGE["near"](spark, stored, "").collect()
    assert sum(r["text"].startswith("word0") for r in got) == 1
    assert sorted(r["text"] for r in got if r["text"].startswith("alone")) == sorted(t for _, t, _ in rows if t.startswith("alone"))


def test_language_and_exact_judge_rows(spark):
    rows = [(1, "the and of one", "a"), (1, "12 34", "a"), (None, "the of and two", "a"), (None, None, "a"), (2, "the and of one", "a"), (2, "the and of one", None)]
    out = STAGE["language"](spark, docs(spark, rows, 3), "")
    assert kept(out) == sorted(((str(i), t) for i, t, _ in rows if t and not t[0].isdigit()), key=str)
    out = STAGE["exact"](spark, docs(spark, rows, 3), "")
    assert kept(out) == sorted([("1", "12 34"), ("None", "the of and two"), ("None", None), ("2", "the and of one")], key=str)


def test_packing_takes_all_rows(spark):
    rows = [(1, "a b", "a"), (1, "c d e", "a"), (None, "f", "a"), (None, None, "b"), (3, "long " * 5000, "b")]
    out = STAGE["packing"](spark, docs(spark, rows, 2), "").collect()
    assert sorted(str(r["doc_id"]) for r in out if r["start"] == 0) == ["1", "1", "3", "None", "None"]
    assert sum(r["length"] for r in out if r["doc_id"] == 3) > 5000 and all(r["length"] <= 2048 for r in out)


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_tables(spark, name):
    assert STAGE[name](spark, docs(spark, [(1, "x", "a")]).where("false"), "").collect() == []


@pytest.mark.parametrize("name", ["language", "exact", "near", "sources"])
def test_further_columns_are_carried_along(spark, name):
    clash = ["id", "n", "digest", "component_id", "size", "taken", "score", "lang_pred", "body", "kept", "c0", "gid", "bucket", "word"]
    rows = [(i, f"the and of text number {i} " + "more " * i, "a") for i in range(12)]
    df = docs(spark, rows, 3)
    for c in clash:
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    out = STAGE[name](spark, df, "")
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in clash)


def test_folders_of_earlier_stages_go(spark, tmp_path):
    """A stage's tables stay while documents depend on them, and go when the next stage reads written ones."""
    import os

    df = docs(spark, [(i, f"the and of {BASE} {i}" if i % 2 else f"the own text {i} {i * i}", "a") for i in range(20)], 2)
    first = STAGE["exact"](spark, df, "")
    root = corpus_pipeline._open[-1].root
    second = STAGE["near"](spark, first, "")  # not written: still needs the first one's tables
    assert os.path.isdir(root) and second.count() == 11
    second.write.parquet(str(tmp_path / "near"))
    assert STAGE["sources"](spark, spark.read.parquet(str(tmp_path / "near")), "").count() > 0
    assert not os.path.isdir(root)
    scratch = Scratch(spark, "t")
    stored = scratch.write(df, "d")
    assert scratch.stored(stored, "again") is stored and scratch.stored(stored.repartition(3), "again") is not stored


def test_copies_of_one_text_are_spilled_once(tmp_path, monkeypatch):
    """Grace buckets of a single hash are not partitioned again; others are."""
    from fleetlens.llm import exact_dedup

    written = []
    spill = exact_dedup._Bucket.spill
    monkeypatch.setattr(exact_dedup._Bucket, "spill", lambda self: (written.extend(len(r[1]) for r in self.rows), spill(self)))
    hot = [(77, b"x" * 1000, uid, uid, 1) for uid in range(3000)]
    out = list(exact_dedup._buckets(iter(hot), 0, 200_000, str(tmp_path)))
    assert len(out) == 3000 and {(r[1], r[3]) for r in out} == {(2999, 3000)} and sum(written) <= 3_000_000
    written.clear()
    mixed = [(h << 3, bytes([h % 251]) * 1000 + str(h).encode(), h, h, 1) for h in range(3000)]
    out = list(exact_dedup._buckets(iter(hot + mixed), 0, 200_000, str(tmp_path)))
    assert len(out) == 6000 and sum(r[3] == 1 for r in out) == 3000 and len({r[4] for r in out}) == 3001
