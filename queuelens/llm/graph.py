"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.stages import Stages


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """(a, m): the smallest neighbour.  Written, so that a join with the links deals both sides
    by a shuffle of its own, which adaptive execution can split where one a has very many."""
    return stages.write(edges.groupBy("a").agg(F.min("b").alias("m")), name)


def _to_minimum(edges: DataFrame, least: DataFrame, keep: Column) -> DataFrame:
    """Links of each a to its neighbours, moved to the smallest of them and itself."""
    least = least.select("a", F.least("a", "m").alias("m"))
    moved = edges.join(least, "a").where(keep)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _clean(edges: DataFrame) -> DataFrame:
    ordered = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    return ordered.groupBy("a", "b").agg(F.lit(1).alias("x")).drop("x")


def components(edges: DataFrame, stages: Stages, name: str = "links") -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component is the smallest id.

    Alternating star contraction: links move to the smallest neighbour, first
    from the larger side, then from the smaller one, until they form stars.  It
    takes a number of rounds about logarithmic in the longest path; each
    round is written, so lineage stays short.  No vertex is brought to the driver.
    """
    current = stages.write(_clean(edges), name)
    mark = None
    while True:
        both = _both_ways(current)
        # links of a to larger neighbours go to a's smallest neighbour
        nearest = _least(both, stages, f"{name}-least")
        large = stages.write(_clean(_to_minimum(both, nearest, F.col("b") > F.col("a"))), name)
        # a and its smaller neighbours go to the smallest of these
        least = _least(large, stages, f"{name}-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b")))
        following = stages.write(_clean(small), name)
        for table in (current, nearest, large, least):
            stages.remove(table)
        current = following
        seen = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = current.select(F.col("b").alias("id")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
