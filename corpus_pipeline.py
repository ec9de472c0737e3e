"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, source mixing, packing.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame.
``run`` applies them to the documents table and writes every stage's result as Parquet to the
shared folder, where the next one reads it, so that a lost executor costs a stage at most.

Stages judge rows, not ids: rows that share an id, or have none, are judged by their own texts.
A null text is rejected by the language stage, like an empty one; each later stage also takes it (as an
empty text).  Near copies with equal ids are settled by row number.  Long texts are read whole, ties
are settled as the operators' docstrings say, empty tables pass through all stages, and further
columns are carried along whatever their names (those that begin with ``_`` and the packing columns of the last stage apart).

A stage's own tables stay until the next stage is given documents that no longer depend on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.llm import langid
from fleetlens.llm.exact_dedup import exact_dedup
from fleetlens.llm.jaccard_join import Similar, near_groups
from fleetlens.llm.mixing import ROW, mixed, numbered_rows
from fleetlens.llm.packing import pack
from fleetlens.llm.queries import tokenizer_path
from fleetlens.llm.scratch import Scratch, delete
from fleetlens.operators import idfilter

#: documents whose language is less certain than this are rejected
LEAST_SCORE = 0.35


#: tables of the stages that ran last, by their folders
_open: list[Scratch] = []


def _scratch(spark: SparkSession, docs: DataFrame, name: str) -> Scratch:
    """A stage's folder; folders of earlier stages that ``docs`` does not read go."""
    files = docs.inputFiles()
    for scratch in list(_open):
        if scratch.spark is not spark:
            _open.remove(scratch)
        elif not any(scratch.root in f for f in files):
            delete(spark, scratch.root)
            _open.remove(scratch)
    _open.append(Scratch(spark, f"pipeline-{name}"))
    return _open[-1]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: those without a letter, or of uncertain language, go."""
    scratch = _scratch(spark, docs, "language")
    model = langid.fit(docs, scratch)
    judged = langid.predict(docs, model, {f"c{i}": F.col(c) for i, c in enumerate(docs.columns)} | {"body": F.col("text")})
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    scratch.drop(*list(scratch.tables))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup(docs, _scratch(spark, docs, "exact")).survivors


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    Rows are told apart by numbers of their own.  Only the rows that go are listed: a bit filter of
    their numbers keeps nearly all others without a join, so texts are not shuffled."""
    rows = numbered_rows(_scratch(spark, docs, "near").stored(docs, "rows"))
    _open.append(scratch := Scratch(spark, "pipeline-near-groups"))
    groups = near_groups(rows, scratch, id_col=ROW, how=Similar(5, 80, 100))
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    members = groups.join(several, "component_id").join(rows.select(ROW, "doc_id"), ROW).select(
        "component_id", ROW, F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", ROW).alias("rank"))
    members = scratch.write(members, "members")
    first = members.groupBy("component_id").agg(F.min("rank").alias("first"))
    gone = scratch.finish(members.join(first, "component_id").where(F.col(ROW) != F.col(f"first.{ROW}")).select(ROW))
    words = idfilter.words_for(gone.count())
    may = idfilter.might_contain(idfilter.build(gone, words, ROW), words, F.col(ROW))
    told = rows.withColumn("_may", may)
    return told.where(~F.col("_may")).select(*docs.columns).union(
        told.where("_may").join(gone, ROW, "left_anti").select(*docs.columns))


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to weights 5, 2, 1 in turn: documents as often as they are taken."""
    return mixed(docs, _scratch(spark, docs, "sources"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens."""
    scratch = _scratch(spark, docs, "packing")
    packed = pack(docs, scratch, tokenizer_path(spark))
    return packed.joined().withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("exact", exact), ("near", near), ("sources", sources), ("packing", packing)]

#: training, connected components and tokenising are not for SQL; the tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = ""
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(last)
        last = name
    return docs
