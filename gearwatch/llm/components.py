"""Connected components of links by alternating large and small stars.

Each step is a minimum per node and a join back, so neighbours are never gathered,
and a node with very many links is pre-aggregated before the shuffle and split by
the skew join. The number of steps grows with the logarithm of the size squared.
Links are written to the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gearwatch.session import materialize

ROUNDS = 60


def _starred(links: DataFrame, to_least: DataFrame, keep) -> DataFrame:
    """Replace each link (u, v) that ``keep`` wants by (v, least neighbour of u)."""
    return links.join(to_least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of links (a, b); the component is its smallest node.

    Nodes without a link are absent. Repeated links, loops and an empty table are fine.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    )
    before = None
    for _ in range(ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _starred(both, least, F.col("v") > F.col("u")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _starred(large, least, F.col("v") != F.col("m")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
