"""Connected components of an undirected link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(scratch: Scratch, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that a link (a, b) touches; component is the smallest node that links reach.

    Alternates large-star and small-star steps. Every round rewrites the links as links to smaller nodes, ends when
    all are stars, and is written to the shared folder. A node with very many links is met by adaptive skew handling
    of the joins and by map-side minima.
    """
    edges = scratch.put("links", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        # large star: larger neighbours of each node go to the smallest of its neighbourhood
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of each node, and the node, go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        new = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        new = scratch.put("links", new)
        sums = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(edges)
        edges, before, state = new, state, tuple(sums)
        if state == before or state[0] == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
