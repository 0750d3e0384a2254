"""Spherical geometry as column expressions. Angles are in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skyweft.config import ARCSEC_PER_DEGREE, ARCSEC_PER_RADIAN


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """Cartesian coordinates of a direction on the unit sphere."""
    lon, lat = F.radians(ra), F.radians(dec)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation, accurate from sub-arcsecond to antipodal."""
    lat1, lat2, dlon = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    sin1, cos1, sin2, cos2 = F.sin(lat1), F.cos(lat1), F.sin(lat2), F.cos(lat2)
    across = F.sqrt(
        F.pow(cos2 * F.sin(dlon), F.lit(2.0))
        + F.pow(cos1 * sin2 - sin1 * cos2 * F.cos(dlon), F.lit(2.0))
    )
    along = sin1 * sin2 + cos1 * cos2 * F.cos(dlon)
    return F.degrees(F.atan2(across, along)) * F.lit(ARCSEC_PER_DEGREE)


def chord_length(angle_arcsec: float) -> float:
    """Straight-line distance between two unit vectors that far apart."""
    return 2.0 * math.sin(min(angle_arcsec / ARCSEC_PER_RADIAN, math.pi) / 2.0)


def within_cone(ra: Column, dec: Column, centre_ra: float, centre_dec: float, radius_deg: float) -> Column:
    """Cone containment, led by plain bounds that a parquet scan can prune on.

    The declination band is always a plain bound. The right-ascension bound is
    added where the cone contains no pole and does not cross 0/360 degrees.
    """
    slack = 1e-9
    low_dec, high_dec = centre_dec - radius_deg - slack, centre_dec + radius_deg + slack
    bounds = (dec >= F.lit(low_dec)) & (dec <= F.lit(high_dec))
    if low_dec > -90.0 and high_dec < 90.0 and radius_deg < 90.0:
        ratio = math.sin(math.radians(radius_deg)) / math.cos(math.radians(centre_dec))
        if ratio < 1.0:
            half_width = math.degrees(math.asin(ratio)) + slack
            low_ra, high_ra = centre_ra - half_width, centre_ra + half_width
            if low_ra >= 0.0 and high_ra <= 360.0:
                bounds = bounds & (ra >= F.lit(low_ra)) & (ra <= F.lit(high_ra))
    exact = separation_arcsec(ra, dec, F.lit(float(centre_ra)), F.lit(float(centre_dec)))
    return bounds & (exact <= F.lit(radius_deg * ARCSEC_PER_DEGREE))


def cone_solid_angle(radius_deg: float) -> float:
    """Solid angle of a cone in steradians."""
    return 2.0 * math.pi * (1.0 - math.cos(math.radians(radius_deg)))


def density_per_sq_arcmin(density_per_sr: Column) -> Column:
    """Convert a surface density from steradian to square arcminute."""
    return density_per_sr / F.lit((math.degrees(1.0) * 60.0) ** 2)
