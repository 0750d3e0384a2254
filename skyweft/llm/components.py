"""Connected components of a graph given as edges, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyweft.llm.common import land


class Forest:
    """Union-find over small whole numbers, for the few nodes of one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its smallest node.

    Each round, a node takes the smallest name among its own and its
    neighbours', then the name of the node it is named after. Names are written
    to the shared folder after every round; only the number of changes reaches
    the driver. A node with very many edges is a sum per key, combined before
    the shuffle.
    """
    both = land(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    names = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    names = land(names)
    while True:
        near = (
            both.join(names.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        )
        taken = names.join(near, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new")
        )
        named = names.select(F.col("node").alias("_new"), F.col("component").alias("_further"))
        taken = land(taken.join(named, "_new", "left").select(
            "node", "_old", F.least("_new", F.coalesce("_further", "_new")).alias("component")
        ))
        changed = taken.filter(F.col("component") != F.col("_old")).limit(1).count()
        names = taken.select("node", "component")
        if not changed:
            return names
