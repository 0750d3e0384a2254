"""Local surface density of sources, and prior odds from it.

The sky is cut into bands of declination and, within them, steps of right ascension
whose number shrinks with the cosine of the declination, so cells are of nearly one
area and none is a sliver at a pole. A cell's density is smoothed over its halo: the
sources in all cells that touch it, over the area of those cells whether occupied or
not. Each occupied cell tells its count to its neighbours; two aggregations by cell do
all the work, and they combine before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

STEP_DEG = 0.1


def _steps(band: Column, step: float) -> Column:
    """Number of cells in a band: as many as its wider edge has steps, one at least."""
    low, high = band * F.lit(step) - 90.0, (band + 1) * F.lit(step) - 90.0
    across = F.least(F.abs(low), F.abs(high))
    around = F.when((low < 0) & (high > 0), F.lit(1.0)).otherwise(F.cos(F.radians(across)))
    return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(360.0 / step) * around).cast("long"))


def _area(band: Column, step: float) -> Column:
    """Solid angle of one cell of a band in steradians."""
    low, high = band * F.lit(step) - 90.0, F.least((band + 1) * F.lit(step) - 90.0, F.lit(90.0))
    return F.lit(2.0 * math.pi) * (F.sin(F.radians(high)) - F.sin(F.radians(low))) / _steps(band, step)


def _last_band(step: float) -> int:
    return math.ceil(180.0 / step) - 1


def cell_of(ra: Column, dec: Column, step: float = STEP_DEG) -> tuple[Column, Column]:
    """(band, place in the band) of a direction."""
    band = F.least(F.floor((dec + 90.0) / F.lit(step)).cast("long"), F.lit(_last_band(step)).cast("long"))
    steps = _steps(band, step)
    turned = F.pmod(ra, F.lit(360.0))
    return band, F.least(F.floor(turned / 360.0 * steps).cast("long"), steps - 1)


def _halo(cells: DataFrame, step: float) -> DataFrame:
    """Every (band, place) with each of the cells (band2, place2) that touch it, itself included."""
    last = _last_band(step)
    low, high = F.greatest(F.col("band") - 1, F.lit(0)), F.least(F.col("band") + 1, F.lit(last))
    near = cells.withColumn("band2", F.explode(F.sequence(low, high)))
    own, other = _steps(F.col("band"), step), _steps(F.col("band2"), step)
    # Edges of the own cell in units of the other band's cells, a little widened: touching at a corner counts.
    first = F.floor(F.col("place") * other / own - 1e-9).cast("long")
    behind = F.floor((F.col("place") + 1) * other / own + 1e-9).cast("long")
    same = F.col("band2") == F.col("band")
    first, behind = F.when(same, F.col("place") - 1).otherwise(first), F.when(same, F.col("place") + 1).otherwise(behind)
    behind = F.least(behind, first + other - 1)  # once around at most
    return near.withColumn("place2", F.explode(F.sequence(first, behind))).withColumn("place2", F.pmod("place2", other))


def local_density(sources: DataFrame, ra: str = "ra", dec: str = "dec", step: float = STEP_DEG) -> DataFrame:
    """(band, place, n, density) of every cell in the halo of a source; ``density`` in sources a steradian, smoothed."""
    band, place = cell_of(F.col(ra), F.col(dec), step)
    counts = sources.filter(F.col(ra).isNotNull() & F.col(dec).isNotNull()).groupBy(
        band.alias("band"), place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    spread = _halo(counts, step)
    own = (F.col("band2") == F.col("band")) & (F.col("place2") == F.col("place"))
    told = spread.groupBy("band2", "place2").agg(
        F.sum("n").alias("_around"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0).cast("long")).alias("n"))
    told = told.select(F.col("band2").alias("band"), F.col("place2").alias("place"), "n", "_around")
    areas = _halo(told.select("band", "place"), step).groupBy("band", "place").agg(F.sum(_area(F.col("band2"), step)).alias("_area"))
    return told.join(areas, ["band", "place"]).select("band", "place", "n", (F.col("_around") / F.col("_area")).alias("density"))


def with_local_odds(
    pairs: DataFrame, first: DataFrame, second: DataFrame, *, ra: str = "gaia_ra", dec: str = "gaia_dec",
    match_fraction: float = 0.7, step: float = STEP_DEG, odds: str = "local_odds",
) -> DataFrame:
    """Pairs with the prior odds of their own place: the fraction over the larger of both local densities.

    That is the odds of the whole area with local densities in place of its own. ``first`` and
    ``second`` hold (ra, dec) of the two catalogs. Where one has no source nearby, the odds are NULL.
    """
    band, place = cell_of(F.col(ra), F.col(dec), step)
    out = pairs.withColumns({"band": band, "place": place})
    for number, catalog in enumerate((first, second)):
        cells = local_density(catalog, step=step).select("band", "place", F.col("density").alias(f"_density{number}"))
        out = out.join(cells, ["band", "place"], "left")
    both = F.when(F.col("_density0").isNotNull() & F.col("_density1").isNotNull(), F.greatest("_density0", "_density1"))
    return out.withColumn(odds, F.lit(match_fraction) / both).drop("band", "place", "_density0", "_density1")
