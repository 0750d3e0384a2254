"""Epoch propagation, proper-motion shift and positional uncertainty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skyweft.config import INFRARED_EPOCH, MAS_PER_DEGREE, OPTICAL_EPOCH
from skyweft.functions.nulls import clip
from skyweft.functions.once import with_columns_once

POLE_COSINE = 1e-12


def propagate_position(
    df: DataFrame,
    from_epoch: float = OPTICAL_EPOCH,
    to_epoch: float = INFRARED_EPOCH,
    *,
    ra: str = "ra",
    dec: str = "dec",
    pmra: str = "pmra",
    pmdec: str = "pmdec",
    out_ra: str = "ra_epoch",
    out_dec: str = "dec_epoch",
) -> DataFrame:
    """Move positions linearly along their proper motion (mas/yr, cos dec included).

    A missing motion counts as zero, and a source on a pole gets no right
    ascension. The result is not wrapped to 0..360 degrees.
    """
    years = F.lit(float(to_epoch) - float(from_epoch))
    moved = {
        name: F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)) / F.lit(MAS_PER_DEGREE) * years
        for name in (pmra, pmdec)
    }
    ra_deg, dec_deg = F.col(f"`{ra}`").cast("double"), F.col(f"`{dec}`").cast("double")
    cos_dec = F.cos(F.radians(dec_deg))
    return with_columns_once(
        df,
        {
            out_ra: F.when(F.abs(cos_dec) >= F.lit(POLE_COSINE), ra_deg + F.try_divide(moved[pmra], cos_dec)),
            out_dec: dec_deg + moved[pmdec],
        },
    )


def proper_motion_shift(
    pmra: Column,
    pmdec: Column,
    years: float,
    *,
    dec: Column | None = None,
    compat: bool = False,
) -> Column:
    """Distance moved in arcsec over ``years``.

    ``pmra`` already holds the cos dec factor. ``compat`` applies it a second
    time, for comparison with results that were computed that way.
    """
    east, north = F.coalesce(pmra, F.lit(0.0)), F.coalesce(pmdec, F.lit(0.0))
    if compat:
        if dec is None:
            raise ValueError("compat needs the declination")
        east = east * F.cos(F.radians(dec))
    return F.hypot(east, north) * F.lit(abs(years) / 1000.0)


def _radial(first: Column, second: Column) -> Column:
    return F.hypot(first, second) / F.lit(math.sqrt(2.0))


def gaia_radial_sigma(ra_error_mas: Column, dec_error_mas: Column) -> Column:
    """Effective circular error in arcsec; a missing error counts as 1 mas."""
    in_arcsec = [F.coalesce(c, F.lit(1.0)) / F.lit(1000.0) for c in (ra_error_mas, dec_error_mas)]
    return clip(_radial(*in_arcsec), 0.001, 1.0)


def wise_radial_sigma(sigra: Column, sigdec: Column) -> Column:
    """Effective circular error in arcsec; a missing error counts as 0.5 arcsec."""
    filled = [F.coalesce(c, F.lit(0.5)) for c in (sigra, sigdec)]
    return clip(_radial(*filled), 0.05, 2.0)
