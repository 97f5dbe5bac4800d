"""Connected components of a graph given as edges, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: a, b (no nulls). Returns node, root: root is the smallest node that node can reach. Nodes without edges don't appear.

    Alternating large-star and small-star steps: every node's larger (then smaller) neighbours are tied to its smallest
    neighbour. Smallest neighbours come from an aggregate with map-side combine and are written before the edges meet
    them, so both sides of that join are shuffled for it alone and Spark can split the partition of a node with very many
    neighbours; computed within the join, they would hold such a node's edges in one task. Each round is written to the
    shared folder, which cuts lineage.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    last = None
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "edges")
        # the same edges again: stars around the smallest nodes
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
