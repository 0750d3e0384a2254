"""Catalogs landed by sky cell.

Space is cut into cubes whose edge halves from level to level; a direction lies in
the cube of its unit vector. Cell numbers are hierarchical: the number of the cube
around a cube is its own with every axis shifted. There are no poles and no seam.

A landed catalog is partitioned by its coarse cell (``sky_cell``) and bucketed and
sorted by its fine one (``fine_cell``). A cone scan then reads the partitions that
the cone touches, and a nearest-neighbour join leaves the landed rows where they are:
copies of the other side's rows are sent to the cells that their search balls touch,
in the table's own bucketing.

Rows without coordinates go to the coarse cell -1 and match nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyweft.functions.sphere import chord_length, unit_vector, within_cone
from skyweft.operators import nearest
from skyweft.session import shared_folder

#: Edges of 1/8 (some 7 degrees) and of 2 ** -13 (25 arcsec).
COARSE_LEVEL, FINE_LEVEL = 3, 13
AXIS_BITS = 21
NOWHERE = -1
PARTITION, BUCKET = "sky_cell", "fine_cell"

Cone = tuple[float, float, float]


def cell_number(level: int, x: Column, y: Column, z: Column) -> Column:
    """Number of the cube at ``level`` that holds a vector; every axis takes ``AXIS_BITS`` bits."""
    places = [F.floor(axis * F.lit(float(1 << level))).cast("long") + F.lit(1 << level) for axis in (x, y, z)]
    return _packed(*places)


def _packed(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft(x, 2 * AXIS_BITS).bitwiseOR(F.shiftleft(y, AXIS_BITS)).bitwiseOR(z)


def parent_number(cell: Column, level: int, above: int) -> Column:
    """Number at the coarser level ``above`` of the cube around a cube of ``level``."""
    mask = F.lit((1 << AXIS_BITS) - 1)
    axes = [F.shiftright(F.shiftright(cell, n * AXIS_BITS).bitwiseAND(mask), level - above) for n in (2, 1, 0)]
    return _packed(*axes)


def cone_cells(cone: Cone, level: int = COARSE_LEVEL) -> list[int]:
    """Numbers of all cubes that meet both the sphere and the cone; found from the coarse to the fine."""
    ra, dec, radius = cone
    lon, lat = math.radians(ra), math.radians(dec)
    centre = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
    reach = chord_length(radius * 3600.0) + 1e-9

    def children(at: tuple[int, int, int], depth: int) -> Iterator[int]:
        edge = 1.0 / (1 << depth)
        low = [(a - (1 << depth)) * edge for a in at]
        gap = math.hypot(*(max(lo - c, c - lo - edge, 0.0) for lo, c in zip(low, centre, strict=True)))
        near = math.hypot(*(0.0 if lo <= 0.0 <= lo + edge else min(abs(lo), abs(lo + edge)) for lo in low))
        far = math.hypot(*(max(abs(lo), abs(lo + edge)) for lo in low))
        if gap > reach or near > 1.0 + 1e-9 or far < 1.0 - 1e-9:
            return
        if depth == level:
            yield at[0] << 2 * AXIS_BITS | at[1] << AXIS_BITS | at[2]
            return
        for n in range(8):
            yield from children(tuple(2 * a + (n >> i & 1) for i, a in enumerate(at)), depth + 1)

    # A unit vector's axes reach 1 itself, so the first cubes are three a side.
    return sorted(c for x in range(3) for y in range(3) for z in range(3) for c in children((x, y, z), 0))


def with_cells(df: DataFrame, ra: str = "ra", dec: str = "dec", fine_level: int = FINE_LEVEL) -> DataFrame:
    """Add ``sky_cell`` and ``fine_cell``."""
    place = [F.when(nearest._has_place(ra, dec), F.col(f"`{c}`").cast("double")) for c in (ra, dec)]
    vector = unit_vector(*place)
    cells = {PARTITION: cell_number(COARSE_LEVEL, *vector), BUCKET: cell_number(fine_level, *vector)}
    return df.withColumns({name: F.coalesce(cell, F.lit(NOWHERE).cast("long")) for name, cell in cells.items()})


def land_by_cell(
    df: DataFrame, ra: str = "ra", dec: str = "dec", *, buckets: int = 64, fine_level: int = FINE_LEVEL,
    path: str | None = None, name: str | None = None,
) -> DataFrame:
    """Write ``df`` as a table by sky cell and read it back.

    Rows are brought to their buckets before, so each bucket of a partition is
    one file. The table lies in the shared folder unless ``path`` names another place.
    """
    spark = df.sparkSession
    name = name or f"skyweft_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(spark)}/{name}"
    celled = with_cells(df, ra, dec, fine_level).repartition(buckets, BUCKET)
    writer = celled.write.partitionBy(PARTITION).bucketBy(buckets, BUCKET).sortBy(BUCKET)
    writer.option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def attach_landed(spark: SparkSession, path: str, name: str, schema: str, buckets: int) -> DataFrame:
    """A table that another session has landed at ``path``; ``schema`` in DDL, with both cell columns."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet PARTITIONED BY ({PARTITION})"
              f" CLUSTERED BY ({BUCKET}) SORTED BY ({BUCKET}) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def landed_cone(landed: DataFrame, cone: Cone, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows of a landed table inside a cone; only partitions that it touches are read."""
    cells = F.col(PARTITION).isin(cone_cells(cone))
    return landed.filter(cells & within_cone(F.col(ra), F.col(dec), *cone)).drop(PARTITION, BUCKET)


def _sent(df: DataFrame, ra: str, dec: str, reach: float, fine_level: int, body: Column) -> DataFrame:
    """One row for each fine cell that the search ball of a row touches."""
    placed = nearest._with_geometry(df.filter(nearest._has_place(ra, dec)), ra, dec, True)
    touched = nearest._touched_cells(placed.withColumn("_body", body), 1.0 / (1 << fine_level), reach)
    offset = F.lit(1 << fine_level)
    number = _packed(*[F.col(c).cast("long") + offset for c in nearest.CELL])
    return touched.select(number.alias(BUCKET), F.struct("_ra", "_sin", "_cos", "_body").alias("_near"))


def _paired(landed: DataFrame, sent: DataFrame, ra: str, dec: str, threshold: float) -> DataFrame:
    """Landed rows with every sent row below the threshold, and their separation."""
    lit = nearest._with_geometry(landed.filter(nearest._has_place(ra, dec)), ra, dec, True)
    level = F.abs(F.col("_near._sin") - F.col("_sin")) <= F.lit(nearest._reach(threshold))
    apart = nearest._separation(
        F.col("_near._ra"), F.col("_near._sin"), F.col("_near._cos"), F.col("_ra"), F.col("_sin"), F.col("_cos"))
    return lit.join(sent, BUCKET).filter(level).withColumn("_apart", apart).filter(F.col("_apart") < F.lit(threshold))


def nearest_of_landed(
    landed: DataFrame, right: DataFrame, *, left_key: str = "source_id", right_key: str = "designation",
    left_ra: str = "ra", left_dec: str = "dec", right_ra: str = "ra", right_dec: str = "dec",
    threshold_arcsec: float = 2.0, left_prefix: str = "gaia_", right_prefix: str = "wise_",
    separation: str = "distance_arcsec", fine_level: int = FINE_LEVEL,
) -> DataFrame:
    """For each landed row the nearest right row strictly below the threshold; ``left_key`` is unique.

    A landed row has one fine cell, so both the join and the choice of the nearest
    are answered within its bucket: the landed side is never exchanged. The smaller
    ``right_key`` wins among equally near rows.
    """
    body = F.struct(F.col(f"`{right_key}`").alias("key"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("row"))
    sent = _sent(right, right_ra, right_dec, nearest._reach(threshold_arcsec), fine_level, body)
    found = _paired(landed, sent, left_ra, left_dec, threshold_arcsec)
    columns = [c for c in landed.columns if c not in (PARTITION, BUCKET)]
    best = F.struct(F.col("_apart").alias("separation"), F.col("_near._body.key").alias("key"))
    own = F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_own")
    one = found.groupBy(BUCKET, F.col(f"`{left_key}`").alias("_key")).agg(
        own, F.min(best).alias("_best"), F.min_by("_near._body.row", best).alias("_row"))
    return one.select(
        *[F.col("_own")[c].alias(left_prefix + c) for c in columns],
        *[F.col("_row")[c].alias(right_prefix + c) for c in right.columns],
        F.col("_best.separation").alias(separation))


def nearest_in_landed(
    left: DataFrame, landed: DataFrame, *, left_key: str = "source_id", right_key: str = "designation",
    left_ra: str = "ra", left_dec: str = "dec", right_ra: str = "ra", right_dec: str = "dec",
    threshold_arcsec: float = 2.0, left_prefix: str = "gaia_", right_prefix: str = "wise_",
    separation: str = "distance_arcsec", fine_level: int = FINE_LEVEL,
) -> DataFrame:
    """For each left row the nearest landed row strictly below the threshold; ``left_key`` is unique.

    The other way round: left rows travel to the cells around them, the catalog
    stays, and what is found, a row or a few for each left row, is reduced by key.
    """
    body = F.struct(F.col(f"`{left_key}`").alias("key"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    sent = _sent(left, left_ra, left_dec, nearest._reach(threshold_arcsec), fine_level, body)
    found = _paired(landed, sent, right_ra, right_dec, threshold_arcsec)
    columns = [c for c in landed.columns if c not in (PARTITION, BUCKET)]
    best = F.struct(F.col("_apart").alias("separation"), F.col(f"`{right_key}`").alias("key"))
    one = found.groupBy(F.col("_near._body.key").alias("_key")).agg(
        F.first("_near._body.row").alias("_own"), F.min(best).alias("_best"),
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), best).alias("_row"))
    return one.select(
        *[F.col("_own")[c].alias(left_prefix + c) for c in left.columns],
        *[F.col("_row")[c].alias(right_prefix + c) for c in columns],
        F.col("_best.separation").alias(separation))
