"""Connected components by alternating stars, all in DataFrames.

Each round replaces the links by links to smaller nodes: the large star links every
larger neighbour of a node to the least node around it, the small star every smaller
one.  Components shrink to stars in a number of rounds that grows with the logarithm of
their size.  A node's least neighbour is a minimum that combines before the shuffle,
and the joins back are plain equi-joins whose hot keys Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """edges (u > v); every node looks at all its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u")
    return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of links (columns a and b, long) but the roots themselves;
    a root is the least node of its component."""
    a, b = F.col("a"), F.col("b")
    edges = stored(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc", narrow=True)
    before = _signature(edges)
    for _ in range(rounds):
        edges = stored(_small_star(_large_star(edges)), "cc", narrow=True)
        now = _signature(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
