"""Declared schemas of the catalogs and the aliases under which columns arrive."""

from __future__ import annotations

from pyspark.sql import types as T


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


GAIA_QUICK = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        *_doubles(
            "ra", "dec", "parallax", "parallax_error", "pmra", "pmra_error", "pmdec", "pmdec_error",
            "phot_g_mean_mag", "phot_bp_mean_mag", "phot_rp_mean_mag", "bp_rp", "ruwe",
        ),
    ]
)
GAIA = T.StructType([*GAIA_QUICK.fields, *_doubles("ra_error", "dec_error", "astrometric_excess_noise")])
ALLWISE = T.StructType(
    [
        *_strings("designation"),
        *_doubles(
            "ra", "dec", "sigra", "sigdec", "w1mpro", "w1sigmpro", "w2mpro", "w2sigmpro",
            "w3mpro", "w3sigmpro", "w4mpro", "w4sigmpro",
        ),
        *_strings("cc_flags", "ph_qual"),
    ]
)
TIC = T.StructType([*_strings("ID"), *_doubles("ra", "dec", "Tmag"), *_strings("GAIA")])
SIMBAD = T.StructType([*_doubles("ra", "dec"), *_strings("main_id", "otype")])
LIGHTCURVE = T.StructType([*_strings("target_id"), T.StructField("time", T.TimestampNTZType()), *_doubles("flux")])

# Names under which published member lists carry a column.
MEMBER_ID_NAMES = ("source", "gaiadr2", "gaiadr3", "sourceid")
MEMBER_PROBABILITY_NAMES = ("proba", "pmemb", "memberprob")
MEMBER_MAGNITUDE_NAMES = ("gmag", "g", "phot_g_mean_mag")
MEMBER_RA_NAMES = ("RA_ICRS", "ra", "RAJ2000", "_RAJ2000")
MEMBER_DEC_NAMES = ("DE_ICRS", "dec", "DEJ2000", "_DEJ2000")
MEMBER_PMRA_NAMES = ("pmRA*", "pmRA")
MEMBER_PMDEC_NAMES = ("pmDE",)
MEMBER_PARALLAX_NAMES = ("Plx",)
