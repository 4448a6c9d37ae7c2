"""Connected components by alternating large and small stars, entirely in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import discard, stash


def _smallest(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node, itself included; written, so that joins to it can split hot nodes."""
    return stash(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b); the component is its smallest node.

    Nodes are of any type that has an order.  Self-links and repeated links do no harm.
    Each round writes its edges to the shared folder and deletes those of the round
    before, so lineage stays short and lost executors cost one round at most.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        # large star: larger neighbours go to the least of the neighbourhood
        both = edges.unionAll(edges.select("b", "a"))
        near = _smallest(both)
        large = both.join(near, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stash(large, "large")
        # small star: a node and its smaller neighbours go to the least of them
        low = _smallest(large)
        moved = large.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stash(moved.unionAll(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        discard(edges, near, large, low)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
