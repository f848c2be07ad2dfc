"""Connected components of a graph of links, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marksheet.llm.common import Scratch


def _stars(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """Link every neighbour of a node to the least of them and the node.

    Large stars move only the neighbours above the node, small stars those below and the node.
    The minima are combinable sums; they are written so that the join with a hub can be split.
    """
    up = edges.select("u", "v")
    pairs = up.union(up.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else up
    least = scratch.keep(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
    joined = pairs.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    stars = scratch.keep(moved.filter("u != v").distinct(), "stars")
    scratch.drop(least)
    return stars


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has a link; ``links`` has two columns of one orderable type.

    The root is the least node that can be reached.  Links may repeat, come in either direction, or
    lead from a node to itself.  The rounds grow with the logarithm of the longest chain.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = scratch.keep(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
        large = _stars(edges, scratch, True)
        small = _stars(large, scratch, False)
        scratch.drop(edges, large)
        edges = small
