"""Connected parts of a graph of links, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import settle


def smallest_reachable(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """pairs: a, b. Returns (node, root) for every node with a link; root is the least node that it reaches.

    Alternating large-star and small-star steps: each links a node's neighbours to their least member, until nothing
    changes. The rounds grow with the logarithm of the longest chain. A node's neighbours are only summed to their
    least, never gathered, and the sums are written before they meet the links, so that Spark can split a hub's rows."""
    edges = settle(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "large-star")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        stepped = settle(small.distinct(), "small-star")
        same = stepped.count() == edges.count() and stepped.join(edges, ["u", "v"], "left_anti").limit(1).count() == 0
        edges = stepped
        if same:
            break
    else:
        raise RuntimeError(f"links are not joined after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return settle(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "roots")
