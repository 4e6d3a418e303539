"""Connected components of links between fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for links ``(a, b)``; the root is the smallest node of the component.

    Alternates large-star and small-star (Kiveris et al., "Connected Components
    in MapReduce and Beyond", 2014): rounds grow with the logarithm of the
    longest chain. The smallest neighbour of a node is a minimum that map tasks
    combine, and is joined back, so a node with very many links is never
    gathered in one task. Rounds are stored, so a lost executor costs a retry.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "links")
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            small.select("a", F.col("low").alias("b"))).distinct()
        small = materialize(small, "links")
        # A forest of stars: every node points once, and at a node that points nowhere.
        unsettled = small.groupBy("a").count().filter("count > 1").select("a").union(
            small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a"))
        edges = small
        if unsettled.limit(1).count() == 0:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
