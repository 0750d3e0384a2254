"""A landed match table that is brought up to date where its inputs have changed.

The table is partitioned by a coarse sky cell of the left rows. Beside it lie digests
of both inputs: for every cell the number of rows and sums over two hashes of all their
columns. An update compares the digests of the new inputs with those, cell by cell, and
matches again only left rows in cells whose own rows changed or whose search balls reach
a cell of the right side that changed; all else stays as it lies. The result equals
that of matching everything again, because a match depends on nothing beyond its ball.

The partitions of those cells are overwritten, then the digests. A run that ends
between the two repeats the same cells the next time, so it may be repeated at will. A
cell that has lost all its matches gets a marker row, which readers leave out, because
an overwritten partition is only known by its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyweft.operators import nearest
from skyweft.session import cut_lineage
from skyweft.sources.skycells import cell_number

#: Cells of 2 ** -5 (some 1.8 degrees).
LEVEL = 5
ZONE, MARKER = "zone", "_no_match"


def _zone(df: DataFrame, ra: str, dec: str, level: int) -> Column:
    """Cell of a row; -1 without coordinates."""
    place = [F.when(nearest._has_place(ra, dec), F.col(f"`{c}`").cast("double")) for c in (ra, dec)]
    vector = nearest.unit_vector(*place)
    return F.coalesce(cell_number(level, *vector), F.lit(-1).cast("long"))


def cell_digests(df: DataFrame, ra: str, dec: str, level: int = LEVEL) -> DataFrame:
    """(zone, n, first, second) of every occupied cell; a changed, new, gone or repeated row changes them."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    # Sums of 40-bit pieces neither cancel pairs of equal rows nor overflow below 8 million rows a cell and task.
    pieces = [F.pmod(F.xxhash64(*columns, *([F.lit(1)] * n)), F.lit(1 << 40)).cast("decimal(20,0)") for n in (0, 1)]
    return df.select(_zone(df, ra, dec, level).alias(ZONE), *[p.alias(f"_{i}") for i, p in enumerate(pieces)]).groupBy(ZONE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_0").alias("first"), F.sum("_1").alias("second"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was completely written at ``path``."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _changed(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Cells whose digests at ``path`` are not the new ones, those that came or went included."""
    old = spark.read.parquet(path).select(ZONE, *[F.col(c).alias(f"_old_{c}") for c in ("n", "first", "second")])
    same = F.lit(True)
    for c in ("n", "first", "second"):
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return new.join(old, ZONE, "full_outer").filter(~same).select(ZONE)


def update_matches(
    path: str, left: DataFrame, right: DataFrame, *, left_ra: str = "ra", left_dec: str = "dec", right_ra: str = "ra",
    right_dec: str = "dec", threshold_arcsec: float = 2.0, level: int = LEVEL, **how,
) -> int:
    """Bring the match table at ``path`` up to date with both catalogs; the number of cells that were matched again.

    Further arguments go to ``crossmatch_nearest``. The catalogs keep their columns from
    update to update; the threshold and the level belong to the table.
    """
    spark = left.sparkSession
    names = ("left", "right")
    digests = [cut_lineage(cell_digests(left, left_ra, left_dec, level)), cut_lineage(cell_digests(right, right_ra, right_dec, level))]
    known = all(_exists(spark, f"{path}/digests/{n}") for n in names) and _exists(spark, f"{path}/matches")
    zoned = left.withColumn(ZONE, _zone(left, left_ra, left_dec, level))
    if known:
        stale, moved = (_changed(spark, d, f"{path}/digests/{n}") for d, n in zip(digests, names, strict=True))
        reach, edge = nearest._reach(float(threshold_arcsec)), 1.0 / (1 << level)
        placed = nearest._with_geometry(zoned.filter(nearest._has_place(left_ra, left_dec)), left_ra, left_dec, True)
        around = nearest._touched_cells(placed.select(ZONE, *nearest.AXES), edge, reach)
        touched = cell_number(level, *[(F.col(c) + F.lit(0.5)) * F.lit(edge) for c in nearest.CELL])
        reached = around.select(ZONE, touched.alias("_touched")).distinct().join(
            moved.withColumnRenamed(ZONE, "_touched"), "_touched", "left_semi").select(ZONE)
        stale = cut_lineage(stale.union(reached).distinct().filter(F.col(ZONE) >= 0))
        zoned = zoned.join(stale, ZONE, "left_semi")
    else:
        stale = digests[0].select(ZONE).filter(F.col(ZONE) >= 0)
    n_stale = stale.count()
    if n_stale:
        found = nearest.crossmatch_nearest(
            zoned, right, left_ra=left_ra, left_dec=left_dec, right_ra=right_ra, right_dec=right_dec,
            threshold_arcsec=threshold_arcsec, options=nearest.NearestOptions(coarse_filter=known), **how)
        prefix = how.get("left_prefix", "gaia_")
        found = found.withColumnRenamed(f"{prefix}{ZONE}", ZONE).withColumn(MARKER, F.lit(False))
        found = cut_lineage(found)
        empty = stale.join(found.select(ZONE), ZONE, "left_anti").withColumn(MARKER, F.lit(True))
        rows = found.unionByName(empty, allowMissingColumns=True)
        writer = rows.repartition(ZONE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if known else "static")
        writer.partitionBy(ZONE).parquet(f"{path}/matches")
    for digest, name in zip(digests, names, strict=True):
        digest.write.mode("overwrite").parquet(f"{path}/digests/{name}")
    return n_stale


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the match table."""
    return spark.read.parquet(f"{path}/matches").filter(~F.col(MARKER)).drop(MARKER, ZONE)
