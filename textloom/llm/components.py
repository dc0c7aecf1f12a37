"""Distributed connected components, by alternating large and small stars.

A large star links every larger neighbour of a node to the smallest node of its neighbourhood, a small star the smaller
ones and the node itself. Links never increase in number, labels only fall, and the forest becomes one star for each
component after a number of rounds that grows with the logarithm of the longest path. Minima are aggregated before the
shuffle, so a node with very many links is no single task's work, and each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scope


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: (a, b) with a > b."""
    towards = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = towards.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if large:
        moved = towards.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = towards.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link upwards, or only links downwards."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(scope: Scope, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """``edges``: (a, b). Gives (node, component): each node that has an edge to another, and the smallest node it is
    connected with. Nulls, loops and repeated edges count for nothing. ``parts``: files of each round's table."""
    links = scope.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), parts)
    while not _are_stars(links):
        links = scope.table(_star(_star(links, large=True), large=False).distinct(), parts)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
