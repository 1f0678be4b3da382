"""Connected components of links by alternating large and small stars; all state is in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b), a > b. Every node's neighbours (all of them, or the smaller ones) move to the smallest one."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = common.salted_join(both, least, ["a"], "b").filter("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (its component's smallest node) of every node with a link, but the roots themselves. links: a, b of type long."""
    edges = common.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        old, edges = edges, common.cut(star(star(edges, True), False))
        common.forget(old)
        if (now := mark(edges)) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    if seen[0]:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
