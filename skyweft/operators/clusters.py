"""Membership of sources in many clusters at once.

A table of clusters has one row each: ``name``, the centre ``ra, dec`` and
``radius_deg``, and the boxes of parallax and proper motion with half widths
(``parallax, parallax_width, pmra, pmra_width, pmdec, pmdec_width``). A source may lie in
the boxes of several; it belongs to the one that it is nearest to in units of their
widths, ties to the smaller name.

The join is one on cells: a cluster is copied to the cells that its disc touches,
at a level where even the widest has few, and the disc and the boxes are the join's
residual. The clusters' side is small but not of a bounded size, so whether it is
broadcast is left to the sizes that Spark sees; a crowded cell is split by adaptive
execution, as each source joins for itself. A source then keeps its best cluster by an
aggregation on its key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skyweft.functions.nulls import flag
from skyweft.functions.sphere import separation_arcsec, unit_vector
from skyweft.sources.skycells import cell_number

#: Disc widths, in cells, up to which a level is fine; the level is chosen by the widest cluster.
LARGEST_LEVEL, CELLS_ACROSS = 10, 2.0
BOXES = ("parallax", "pmra", "pmdec")


def _level(clusters: DataFrame) -> int:
    """Finest level whose cells are at least half as wide as the widest disc."""
    widest = clusters.agg(F.max("radius_deg")).first()[0]
    if not widest or widest <= 0:
        return LARGEST_LEVEL
    across = 2.0 * math.sin(math.radians(min(widest, 90.0)))
    return max(0, min(LARGEST_LEVEL, math.floor(math.log2(CELLS_ACROSS / across))))


def _covered(clusters: DataFrame, level: int) -> DataFrame:
    """One row for each cell of ``level`` that a cluster's disc touches."""
    edge = 1.0 / (1 << level)
    reach = 2.0 * F.sin(F.radians(F.least(F.col("radius_deg"), F.lit(180.0))) / 2.0) + F.lit(1e-9)
    vector = dict(zip("xyz", unit_vector(F.col("ra"), F.col("dec")), strict=True))
    cells = clusters.withColumns({f"_{a}": v for a, v in vector.items()}).withColumn("_reach", reach)
    for axis in "xyz":
        low = F.floor((F.col(f"_{axis}") - F.col("_reach")) / F.lit(edge))
        high = F.floor((F.col(f"_{axis}") + F.col("_reach")) / F.lit(edge))
        cells = cells.withColumn(f"_c{axis}", F.explode(F.sequence(low, high)))
    middle = [(F.col(f"_c{a}") + F.lit(0.5)) * F.lit(edge) for a in "xyz"]
    # Cubes too far from the sphere hold no source.
    norm = F.sqrt(sum((m * m for m in middle), F.lit(0.0)))
    cells = cells.filter(F.abs(norm - 1.0) <= F.lit(edge * math.sqrt(3.0) / 2.0 + 1e-9))
    return cells.withColumn("_cell", cell_number(level, *middle)).drop(
        *[f"_{a}" for a in "xyz"], *[f"_c{a}" for a in "xyz"], "_reach")


def _offset(source: Column, cluster: Column, axis: str) -> Column:
    return (source - cluster[axis]) / cluster[f"{axis}_width"]


def join_clusters(
    sources: DataFrame, clusters: DataFrame, *, ra: str = "ra", dec: str = "dec", parallax: str = "parallax",
    pmra: str = "pmra", pmdec: str = "pmdec",
) -> DataFrame:
    """Sources with ``cluster`` and ``cluster_distance`` of every cluster in whose disc and boxes they lie.

    Discs and boxes are open; a missing value lies in no box.
    """
    level = _level(clusters)
    vector = unit_vector(F.col(ra).cast("double"), F.col(dec).cast("double"))
    placed = sources.withColumn("_cell", cell_number(level, *vector))
    boxes = _covered(clusters, level).select("_cell", F.struct(*[F.col(c) for c in clusters.columns]).alias("_cluster"))
    c = F.col("_cluster")
    values = dict(zip(BOXES, (parallax, pmra, pmdec), strict=True))
    inside = F.lit(True)
    for axis, column in values.items():
        inside = inside & (F.abs(F.col(column) - c[axis]) < c[f"{axis}_width"])
    apart = separation_arcsec(F.col(ra), F.col(dec), c["ra"], c["dec"])
    inside = inside & (apart < c["radius_deg"] * F.lit(3600.0))
    distance = F.sqrt(sum((_offset(F.col(v), c, a) * _offset(F.col(v), c, a) for a, v in values.items()), F.lit(0.0)))
    found = placed.join(boxes, "_cell").filter(inside)
    return found.withColumns({"cluster": c["name"], "cluster_distance": distance}).drop("_cell", "_cluster")


def best_cluster(sources: DataFrame, clusters: DataFrame, *, key: str = "source_id", **columns: str) -> DataFrame:
    """All sources with their nearest cluster, its distance, and ``n_clusters`` whose boxes they lie in; ``key`` is unique."""
    found = join_clusters(sources, clusters, **columns)
    order = F.struct("cluster_distance", "cluster")
    best = found.groupBy(key).agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_n"))
    return sources.join(best, key, "left").withColumns({
        "cluster": F.col("_best.cluster"), "cluster_distance": F.col("_best.cluster_distance"),
        "n_clusters": F.coalesce("_n", F.lit(0).cast("long"))}).drop("_best", "_n")


def member_counts(sources: DataFrame, clusters: DataFrame, **columns: str) -> DataFrame:
    """Every cluster with the number of sources that belong to it and their mean distance."""
    counted = best_cluster(sources, clusters, **columns).filter(flag(F.col("cluster").isNotNull())).groupBy(
        F.col("cluster").alias("name")).agg(F.count(F.lit(1)).alias("n_members"), F.avg("cluster_distance").alias("mean_distance"))
    return clusters.select("name").join(counted, "name", "left").withColumn(
        "n_members", F.coalesce("n_members", F.lit(0).cast("long")))
