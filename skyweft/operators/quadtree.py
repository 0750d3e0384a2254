"""Adaptive bins in two dimensions, for colour-magnitude maps of any number of rows.

The plane between the smallest and largest values is halved on both axes, level by
level, wherever a bin holds more than its share of the rows. The tree takes two scans:
one for the ranges, one that counts rows on the finest grid, ``2 ** depth`` a side. Coarser
levels are sums of that bounded table, so no level needs the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyweft.session import cut_lineage

DEPTH, SHARE = 7, 256


def most_bins(depth: int = DEPTH, share: int = SHARE) -> int:
    """Bound of the number of bins: fewer than ``share`` bins a level are split, each into four."""
    return 1 + 3 * share * depth


def adaptive_bins(df: DataFrame, x: str, y: str, depth: int = DEPTH, share: int = SHARE) -> DataFrame:
    """(level, i, j, x_low, x_high, y_low, y_high, n) of bins that hold rows, at most ``most_bins`` of them.

    A bin is split while it holds more than one in ``share`` of the rows and is above
    ``depth``. Bins are closed below and open above, the last on each axis closed; rows
    without either value are left out. Where an axis has one value, its first half is taken.
    """
    values = df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    finite = finite & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    values = values.filter(finite)
    ranges = values.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                        F.count(F.lit(1)).alias("total"))
    ranges = cut_lineage(ranges)
    side = 1 << depth

    def place(value: str, low: str, high: str) -> Column:
        at = F.floor((F.col(value) - F.col(low)) / ((F.col(high) - F.col(low)) / F.lit(float(side)))).cast("long")
        return F.when(F.col(high) > F.col(low), F.least(at, F.lit(side - 1).cast("long"))).otherwise(F.lit(0).cast("long"))

    placed = values.crossJoin(F.broadcast(ranges))  # one row
    finest = cut_lineage(placed.groupBy(place("x", "x0", "x1").alias("i"), place("y", "y0", "y1").alias("j")).agg(
        F.count(F.lit(1)).alias("n")))
    # All levels of the tree in one aggregation of at most 4 ** depth rows.
    levels = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    down = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    nodes = levels.groupBy("level", down("i").alias("i"), down("j").alias("j")).agg(F.sum("n").alias("n"))
    nodes = nodes.crossJoin(F.broadcast(ranges))
    many = F.col("n") * F.lit(share) > F.col("total")
    nodes = cut_lineage(nodes.withColumn("_split", many & (F.col("level") < depth)))
    parents = nodes.filter("_split").select(
        (F.col("level") + 1).alias("level"), F.col("i").alias("_i"), F.col("j").alias("_j"))
    up = nodes.withColumns({"_i": F.shiftright("i", 1), "_j": F.shiftright("j", 1)})
    # A bin counts if its parent was split; parents of split bins always are, as they hold more.
    leaves = up.filter("NOT _split").join(parents, ["level", "_i", "_j"], "left_semi").unionByName(
        up.filter("NOT _split AND level = 0"))
    width = {a: (F.col(f"{a}1") - F.col(f"{a}0")) / F.expr("cast(shiftleft(1L, level) as double)") for a in "xy"}
    edges = {f"{a}_{end}": F.col(f"{a}0") + (F.col(c) + int(end == "high")) * width[a]
             for a, c in (("x", "i"), ("y", "j")) for end in ("low", "high")}
    return leaves.select("level", "i", "j", *[v.alias(k) for k, v in edges.items()], "n")
