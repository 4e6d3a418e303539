"""Connected components of an edge table by alternating large-star and small-star.

Each round is two grouped minimums and two joins over the edges; the number of
rounds grows with the logarithm of the longest chain, not with its length
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.skew import with_group
from stowage.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour at the smallest node around."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = with_group(both, ["a"], {"low": F.min("b")})
    return low.filter("b > a").select(F.least("a", "low").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them. Edges run ``a < b``."""
    low = with_group(edges, ["b"], {"low": F.min("a")})
    moved = low.filter("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.union(low.select(F.col("low").alias("a"), "b")).distinct()


def connected_components(
    edges: DataFrame, nodes: DataFrame | None = None,
) -> DataFrame:
    """``(node, component)`` for an edge table ``(a, b)``; the component is its smallest node.

    With ``nodes`` (one column ``node``) nodes without an edge come out as
    components of their own.
    """
    current = materialize(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges")
    while True:
        # Done when it is a forest of stars: nobody points at a node that itself points elsewhere.
        centres = current.select(F.col("a").alias("node"))
        leaves = current.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"))
        bad = leaves.filter("n > 1").unionByName(leaves.join(centres, "node", "left_semi"))
        if bad.limit(1).count() == 0:
            break
        current = materialize(_small_star(_large_star(current)), "edges")
    labels = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    labels = labels.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    if nodes is None:
        return labels
    alone = nodes.select("node").join(labels, "node", "left_anti")
    return labels.unionByName(alone.select("node", F.col("node").alias("component")))
