"""Distributed union-find: connected components by alternating star contraction."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._session import Kept, join_counted, no_shuffle_left


def _around(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = _around(edges)
    return join_counted(both, _least(both), "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; edges run from larger to smaller."""
    least = _least(edges)
    joined = join_counted(edges, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v")))


def _unsettled(edges: DataFrame) -> int:
    """Nodes that are linked to two smaller ones, or to a smaller and to a larger one: none in a forest of stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below > 0 and above > 0").count()


def components(edges: DataFrame, kept: Kept, most: int = 60) -> DataFrame:
    """(u, v) links -> (node, root): every node of a link with the smallest node it can reach.

    Rounds follow the logarithm of a component's diameter. A hub's links stay where they are:
    its least neighbour is broadcast (``join_counted``), so that no task meets them all. Loops count as no link.
    """
    least, most_ = F.least("u", "v"), F.greatest("u", "v")
    edges = kept.table(edges.where("u <> v").select(most_.alias("u"), least.alias("v")).distinct(), "links")
    for _ in range(most):
        total = edges.count()
        large = kept.table(_large_star(edges, total).distinct(), "links")
        kept.drop_one(-2)
        edges = kept.table(_small_star(large, total).distinct(), "links")
        kept.drop_one(-2)
        with no_shuffle_left(kept.spark) if kept.lean else nullcontext():
            unsettled = _unsettled(edges)
        if not unsettled:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
