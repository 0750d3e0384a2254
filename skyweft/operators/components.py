"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyweft.session import cut_lineage


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node that an edge names; a component has the name of its smallest node.

    Each round, every node takes the smallest name among its neighbours, and the
    node that gave it its old name is told of the smaller one, so that trees of names
    hook onto each other; then names are replaced by the names of their namesakes. The
    number of rounds grows with the logarithm of a component's length. A node with very
    many edges is one sum, combined before the shuffle. Both columns have one type.
    """
    there = edges.select(F.col(left).alias("_a"), F.col(right).alias("_b"))
    both = cut_lineage(there.union(there.select("_b", "_a")).distinct())
    names = cut_lineage(both.groupBy(F.col("_a").alias("node")).agg(F.least("node", F.min("_b")).alias("component")))
    while True:
        near = both.join(names.select(F.col("node").alias("_b"), "component"), "_b").groupBy(
            F.col("_a").alias("node")).agg(F.min("component").alias("_least"))
        seen = cut_lineage(names.join(near, "node").select("node", "component", F.least("component", "_least").alias("_least")))
        if seen.filter(F.col("_least") < F.col("component")).isEmpty():
            return names
        told = seen.groupBy(F.col("component").alias("node")).agg(F.min("_least").alias("_told"))
        hooked = cut_lineage(seen.join(told, "node", "left").select("node", F.least("_least", "_told").alias("component")))
        further = hooked.select(F.col("node").alias("component"), F.col("component").alias("_further"))
        names = cut_lineage(hooked.join(further, "component", "left").select(
            "node", F.least("component", "_further").alias("component")))
