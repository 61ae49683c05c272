"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import discard
from sluicebox.session import materialise


def _to_least(edges: DataFrame) -> DataFrame:
    """Each edge u, v with ``least``, the smallest neighbour of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that can be reached, for every node of the edges u, v.

    Alternating large and small stars (Kiveris et al., 2014): each round links nodes to the smallest neighbour known,
    from all neighbours and then from the smaller ones. The minima are aggregated before the shuffle and every round is
    written to the shared folder. Rounds grow with the logarithm of the longest path. Loops and repeated edges are
    harmless; no edges give no node.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = materialise(edges.where("u <> v").select(u, v).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        stars = _to_least(large.distinct())
        small = stars.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        last = edges
        edges = materialise(small.unionByName(stars.select("u", F.col("least").alias("v"))).distinct(), "edges")
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
