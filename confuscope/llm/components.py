"""Distributed connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v, m): each directed edge with the lowest of u and its neighbours.

    The minimum is pre-aggregated before the shuffle; the join back is an inner equi-join, which
    adaptive execution splits where one node has very many edges.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low, "u")


def _settled(pairs: DataFrame) -> bool:
    """Whether every node of the edges (u, v) has one target, which has none itself. Counts by node are pre-aggregated."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.count("*").alias("n"))
    return nodes.where((F.col("out") > 1) | (F.col("out") == 1) & (F.col("n") > 1)).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node of an edge list; component is its smallest node.

    Alternates the large-star and small-star contractions, O(log^2 n) rounds; each round is a
    written table, so a lost executor costs one round at most. Null ends, loops and repeated edges
    are ignored, apart from nodes that have loops only, which do not appear. An empty edge list
    gives an empty result. ``max_rounds`` guards against a fault; exceeding it raises.
    """
    pairs = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(pairs):
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _lowest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        old, pairs = pairs, written(small.where("u <> v").distinct(), "edges")
        discard(old)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
