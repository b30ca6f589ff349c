"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.runtime import checkpoint


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of an edge; the component is its smallest node.

    ``edges``: (src, dst) of any orderable type. Every round hangs larger neighbors of a node on its smallest neighbor
    and then all nodes on the smallest of their neighborhood, so chains shrink geometrically; the rounds
    needed grow with the logarithm of the longest path. Lineage is cut each round in the shared folder. Nulls and
    self-loops are dropped; an empty input gives an empty result.
    """
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    e = checkpoint(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    last = None
    for _ in range(max_rounds):
        # never broadcast: edges are often more than Spark's estimate of what they were made from knows
        # large star: over both directions, each larger neighbor goes to the smallest of the neighborhood
        both = e.union(e.select("dst", "src"))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(low.hint("merge"), "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        # small star: smaller neighbors and the node itself go to the smallest neighbor
        small = large.groupBy("src").agg(F.min("dst").alias("low"))
        hung = large.join(small.hint("merge"), "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(small.select("src", F.col("low").alias("dst")))
        e = checkpoint(hung.where(F.col("src") != F.col("dst")).distinct())
        # a star forest maps to itself, so its edges and their hash sum stay
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
