"""Mixing sources to target weights with DataFrame functions only.

Every document gets a hash-random key.  Within its source, documents are taken in the order
of their keys until the source's budget is used up: whole epochs first, then the last one up
to the exact word.  The order is cut in two steps that never sort a source in one place: the
key's leading digits are a bucket, bucket sums are pre-aggregated and prefix-summed per
source, and only the one bucket per source that holds the cut is sorted row by row.

Rows are repeated by their own decision, so that rows may share an id, or have none.  ``mixed`` needs
only its source's plan (one row a source) for almost every row; rows of the bucket that
holds a cut are numbered, and meet their decision by that number.

Defined results: a null text has size 0; a null source is a source of its own, the last one;
rows with the same id have the same key, and which of them comes first makes no difference;
sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.ranks import bucket_starts
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import WORD

#: hexadecimal digits of a bucket: 4096 buckets a source
DIGITS = 3
#: column of the rows' own numbers
ROW = "_mix_row"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above ``most`` times its source.

    Sources take the weights in turn, in code-point order with null last.  Handing the excess of
    capped sources to the others by weight, until none is above, is finding the level at which
    the uncapped sources stand: with sources ordered by cap / weight, the first k are capped for
    the smallest k whose level does not exceed the next source's.  One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("turn", F.row_number().over(by_name) - 1).withColumn("weight", turn)
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("total", F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("at", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def numbered_rows(df: DataFrame) -> DataFrame:
    """``df`` with a number of its own for every row: partition and place, as a scan of stored files gives them again."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def _digest(id_col: str, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))


class _Plan(NamedTuple):
    sizes: DataFrame  #: doc_id, source, size, key, bucket (and ROW) of every row
    starts: DataFrame  #: sums and starts of the buckets
    sources: DataFrame  #: one row a source: source_size, target, epochs, rest, cut_bucket, cut_start


def _plan(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, weights: Sequence[int], most: float, seed: str,
          size: Column | None) -> _Plan:
    row = [ROW] if ROW in df.columns else []
    size = word_count(F.col(text_col)) if size is None else size
    digest = _digest(id_col, seed)
    docs = scratch.write(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                                   digest.alias("key"), F.substring(digest, 1, DIGITS).alias("bucket"), *row), "sizes")
    starts = scratch.write(bucket_starts(docs, ["source"], "bucket", "size"), "buckets")
    targets = scratch.write(source_targets(starts.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, most), "targets")
    rest = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    budget = targets.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)))
    budget = budget.withColumn("rest", rest)
    same = F.col("s.source").eqNullSafe(F.col("b.source"))
    cut = starts.alias("s").join(budget.alias("b"), same).where("_start < rest and _start + _sum >= rest").groupBy("b.source").agg(
        F.min("bucket").alias("cut_bucket"), F.min_by("_start", "bucket").alias("cut_start"))
    plan = budget.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(
        "p.*", "cut_bucket", "cut_start")
    return _Plan(docs, starts, plan)


def _cut_rows(rows: DataFrame) -> DataFrame:
    """``part`` of the rows of their source's cut bucket: their words before the cut."""
    row = [ROW] if ROW in rows.columns else []
    running = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1))
    return rows.where("bucket = cut_bucket").withColumn("left", F.col("rest") - F.col("cut_start") - F.coalesce(running, F.lit(0))).withColumn(
        "part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left"))).cast("long")).drop("left")


def mix(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (5, 2, 1), most: float = 3.0, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """One row per document: id, size, source, source_size, target of its source, and taken words.

    The numbers of ``numbered_rows`` are passed on where ``df`` has them.
    """
    row = [ROW] if ROW in df.columns else []
    docs, starts, plan = _plan(df, scratch, id_col, text_col, source_col, weights, most, seed, size)
    # documents meet the plan by source and bucket, so that a hot source is dealt over all its buckets
    fate = starts.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
        "s.source", "s.bucket", "source_size", "target", "epochs", "rest", "cut_bucket", "cut_start")
    d = docs.alias("d").join(fate.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.bucket") == F.col("f.bucket"))).select(
        "d.*", "source_size", "target", "epochs", "rest", "cut_bucket", "cut_start")
    d = scratch.write(d, "planned")
    whole = d.where("cut_bucket is null or bucket <> cut_bucket").withColumn(
        "part", F.when(F.col("bucket") < F.col("cut_bucket"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return whole.unionByName(_cut_rows(d)).select(
        F.col("doc_id").alias(id_col), "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *row)


def mixed(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Sequence[int] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixed documents themselves, with the columns of ``df``, by the decisions of ``mix``.

    Each row comes as often as it is taken whole, and cut to its leading words where a source's budget ends inside it.  Texts are
    not shuffled, but for those of the cut buckets.  ``df`` is read three times; where it is not read straight from files,
    it is written first.
    """
    columns = df.columns
    rows = numbered_rows(scratch.stored(df, "rows"))
    docs, _, plan = _plan(rows, scratch, id_col, text_col, source_col, weights, most, seed, None)
    plan = scratch.write(plan.select(F.col("source").alias("_source"), "rest", "epochs", "cut_bucket", "cut_start"), "plan")
    cuts = docs.join(plan.where("cut_bucket is not null"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("cut_bucket")))
    decided = scratch.write(_cut_rows(cuts).select(ROW, "size", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")), "cuts")
    scratch.drop("sizes", "buckets", "targets")
    bucket = F.substring(_digest(id_col, seed), 1, DIGITS)
    plan = plan.select("_source", F.col("epochs").alias("_epochs"), F.col("cut_bucket").alias("_cut"))
    met = rows.withColumn("_bucket", bucket).join(plan, F.col(source_col).eqNullSafe(F.col("_source")))
    times = F.col("_epochs") + F.when(F.col("_bucket") < F.col("_cut"), F.lit(1)).otherwise(F.lit(0))
    whole = met.where(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut"))).withColumn("_times", times.cast("int"))
    whole = whole.where((F.col("_times") > 0) & F.col(text_col).rlike(WORD))
    whole = whole.withColumn("_turn", F.explode(F.expr("sequence(1, _times)"))).select(*columns)
    cut = met.where(F.col("_bucket") == F.col("_cut")).select(*columns, ROW)
    return whole.unionByName(repeated(cut, decided, id_col, text_col))


def repeated(df: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed documents, with the columns of ``df`` but ``ROW``: each row as often as it is taken
    whole, and cut to its leading words where a source's budget ends inside it.

    ``decisions`` are those of ``mix`` over ``df``.  Rows without the numbers of ``numbered_rows`` meet
    theirs by id, which fails where several rows share one.
    """
    columns = [c for c in df.columns if c != ROW]
    if ROW in df.columns:
        takes = decisions.where("taken > 0").select(F.col(ROW), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
        rows = df.join(takes, ROW)
    else:
        shared = F.raise_error(F.lit("rows share an id: number them by numbered_rows before mix"))
        takes = decisions.groupBy(F.col(id_col).alias("_id")).agg(F.max("size").alias("_size"), F.when(
            F.count("*") > 1, shared.cast("long")).otherwise(F.max("taken")).alias("_taken")).where("_taken > 0")
        rows = df.join(takes, F.col(id_col).eqNullSafe(F.col("_id")))
    times = F.expr("sequence(1, cast(ceil(_taken / _size) as int))")
    rows = rows.withColumn("_turn", F.explode(times))
    room = F.least(F.col("_size"), F.col("_taken") - (F.col("_turn") - 1) * F.col("_size"))
    lead = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, room.cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(room < F.col("_size"), lead).otherwise(F.col(text_col)))
    if "n_chars" in df.columns:
        rows = rows.withColumn("n_chars", F.when(room < F.col("_size"), F.length(text_col).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*columns)
