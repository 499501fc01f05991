"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, discard

#: Rounds after which something must be wrong; paths of 2^40 nodes need fewer.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b) with a > b. Every edge is moved to the least neighbour of its node; large star leaves repeated ones."""
    if large:
        ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
        least = edges.select(ends).groupBy("e.a").agg(F.min("e.b").alias("m"))
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        return up.join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    joined = edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")
    moved = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
    return joined.select(moved).select("e.*").where(F.col("a") > F.col("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b) with a > b are stars: no node has two lesser neighbours, or one that has a lesser one itself."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"))
    nodes = edges.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e")).groupBy("e.node")
    nodes = nodes.agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return nodes.where("up > 1 or up = 1 and least = 0").isEmpty()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b), a written table: for every node of the edges (a, b) but the least it reaches, a is the node and b that least one.

    Edges may repeat and point either way; loops are ignored. A hub's edges are joined, never
    collected, and each round's edges are a written table.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = cut(edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            return now
        before = now
        now = cut(_star(_star(now, True), False), "edges")
        discard(before)
    raise RuntimeError(f"components have not settled after {MOST_ROUNDS} rounds")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the least node it reaches."""
    now = stars(edges)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
