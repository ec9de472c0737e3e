"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.scratch import Scratch


#: edges a task gets at least, so that few edges are not dealt over many tasks
EDGES_PER_TASK = 50_000


def _star(pairs: DataFrame, keep, tasks: int) -> DataFrame:
    """Link each node's neighbours (column v of node u) to the smallest of them and itself.

    The minimum is a partially aggregated sum-like column and comes back by a join, whose
    hot keys adaptive execution can split; no neighbourhood is gathered in one place.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")).coalesce(tasks)
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)


def _is_stars(e: DataFrame, tasks: int) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.lit(None).cast(e.schema["v"].dataType).alias("v")))
    odd = ends.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.col("v").isNull()).alias("root")).coalesce(tasks)
    return odd.where("lo is not null and (lo <> hi or root)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is its smallest member.

    Values are any ordered type; null ends and self loops are ignored (a node with self
    loops only is not returned: it is its own component).  Iterations are written tables.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, i = scratch.write(e, f"{tag}0"), 0
    tasks = 1 + e.count() // EDGES_PER_TASK  # an iteration never makes more edges than two for each
    e = e.coalesce(tasks)
    while not _is_stars(e, tasks):
        i += 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u"), tasks).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = down.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = scratch.write(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks), f"{tag}{i}")
        scratch.drop(f"{tag}{i - 1}")
        e = new.coalesce(tasks)
    least = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return least.union(roots)
