"""Connected components of an edge table as Spark joins: stars are grown and cut in turn until nothing changes.

A large step moves the larger neighbours of every node to its smallest one, a small step moves the smaller ones; after a
number of rounds that grows with the logarithm of the longest path every node hangs on the smallest of its component
(Kiveris and others, "Connected Components in MapReduce and Beyond"). Edges and minima are written between the steps, so
lineage stays short, a lost executor costs one step, and both sides of each join are plain exchanges that a hot node can
be split out of. Links and components never reach the driver; it only asks whether a node is left that does
not hang on a smallest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import saved


def _least(edges: DataFrame, least) -> DataFrame:
    return saved(edges.groupBy("u").agg(least.alias("m")), "component-minima")


def _large_step(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, F.least(F.min("v"), F.first("u")))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return saved(moved.where("u <> v"), "component-edges")


def _small_step(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node u to the smaller v."""
    least = _least(edges, F.min("v"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = least.select("u", F.col("m").alias("v"))
    return saved(moved.unionByName(hung).distinct(), "component-edges")


def _settled(edges: DataFrame) -> bool:
    """Whether every larger node hangs on one smaller node that itself hangs on none."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("top")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("top")))
    nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("top").alias("top"))
    return nodes.where("down > 1 OR (down = 1 AND top = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b) of one type -> (node, component) for every node that is not the smallest of its component.

    Nulls and loops link nothing; repeated links count once; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = saved(edges.distinct(), "component-edges")
    while not _settled(edges):
        edges = _small_step(_large_step(edges))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
