"""Attach identifiers and known-object flags to matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyweft.operators.nearest import NearestOptions, crossmatch_nearest
from skyweft.operators.skew import hot_keys, salted_join
from skyweft.operators.topk import first_rows
from skyweft.session import cut_lineage

#: Hashes of identifiers whose entries are counted before those of each identifier.
BUCKETS = 1 << 12


def join_tic(
    matches: DataFrame,
    tic: DataFrame,
    *,
    source_key: str = "gaia_source_id",
    dedupe: bool = False,
    max_rows_per_key: int = 500_000,
) -> DataFrame:
    """Left join on the decimal text of the source identifier.

    Entries without an identifier are dropped first. Several entries of one
    source give several rows, or with ``dedupe`` only the smallest entry.
    An identifier with very many entries is spread over several tasks. The entries of each are
    counted only where some of ``BUCKETS`` hashes of identifiers has so many, which needs next to no shuffle.
    """
    lookup = tic.filter(F.col("GAIA").isNotNull()).select(
        F.col("ID").alias("tic_id"), F.col("Tmag").alias("tic_Tmag"), F.col("GAIA").cast("string").alias("_key")
    )
    keyed = matches.withColumn("_key", F.col(source_key).cast("string"))
    if dedupe:
        lookup = lookup.groupBy("_key").agg(F.min(F.struct("tic_id", "tic_Tmag")).alias("t")).select("_key", "t.*")
        return keyed.join(lookup, "_key", "left").drop("_key")

    hashed = lookup.select(F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).alias("_bucket"))
    if hot_keys(hashed, ["_bucket"], max_rows_per_key).isEmpty():
        return keyed.join(lookup, "_key", "left").drop("_key")
    counted = cut_lineage(hot_keys(lookup, ["_key"], max_rows_per_key))
    if counted.isEmpty():
        return keyed.join(lookup, "_key", "left").drop("_key")
    hot = counted.select("_key")
    ordinary = keyed.join(hot, "_key", "left_anti").join(lookup.join(hot, "_key", "left_anti"), "_key", "left")
    crowded = salted_join(
        lookup.join(hot, "_key", "left_semi"), keyed.join(hot, "_key", "left_semi"), ["_key"], "tic_id",
        "inner", max_rows_per_key, counted,
    )
    return ordinary.unionByName(crowded.select(ordinary.columns)).drop("_key")


def _nearest_known(rows: DataFrame, simbad: DataFrame, key: str, ra: str, dec: str, radius: float,
                   options: NearestOptions) -> DataFrame:
    return crossmatch_nearest(
        rows,
        simbad.select("main_id", "otype", "ra", "dec"),
        left_key=key,
        right_key="main_id",
        left_ra=ra,
        left_dec=dec,
        threshold_arcsec=radius,
        left_prefix="",
        right_prefix="_known_",
        separation="_known_separation",
        how="left",
        options=options,
    )


def enrich_known_objects(
    matches: DataFrame,
    simbad: DataFrame,
    *,
    key: str = "gaia_source_id",
    ra: str = "gaia_ra",
    dec: str = "gaia_dec",
    radius_arcsec: float = 5.0,
    options: NearestOptions = NearestOptions(),
) -> DataFrame:
    """Nearest known object of every row: a 0/1 flag, type and name (empty if none)."""
    found = _nearest_known(matches, simbad, key, ra, dec, radius_arcsec, options)
    return found.select(
        *[F.col(f"`{c}`") for c in matches.columns],
        F.col("_known_main_id").isNotNull().cast("int").alias("known_in_simbad"),
        F.coalesce("_known_otype", F.lit("")).alias("simbad_otype"),
        F.coalesce("_known_main_id", F.lit("")).alias("simbad_main_id"),
    )


def flag_known_objects(
    matches: DataFrame,
    simbad: DataFrame,
    *,
    key: str = "gaia_source_id",
    ra: str = "gaia_ra",
    dec: str = "gaia_dec",
    radius_arcsec: float = 2.0,
    limit: int | None = None,
    options: NearestOptions = NearestOptions(),
) -> DataFrame:
    """Look up known objects: 1 found, 0 not found.

    With a ``limit``, only rows whose key is among its ``limit`` smallest are looked
    up, and the others get NULL. All columns go through the one nearest join, so a
    repeated key keeps its number of rows.
    """

    def looked_up(rows: DataFrame) -> DataFrame:
        return _nearest_known(rows, simbad, key, ra, dec, radius_arcsec, options).select(
            *[F.col(f"`{c}`") for c in matches.columns],
            F.col("_known_main_id").isNotNull().cast("int").alias("known_in_simbad"),
            F.col("_known_main_id").alias("simbad_main_id"),
            F.col("_known_otype").alias("simbad_type"),
        )

    if limit is None:
        return looked_up(matches)
    last = first_rows(matches.select(key), key, limit).agg(F.max(key)).scalar()
    chosen = F.coalesce(F.col(key) <= last, F.lit(False))
    rest = matches.filter(~chosen).select(
        "*", F.lit(None).cast("int").alias("known_in_simbad"), F.lit(None).cast("string").alias("simbad_main_id"),
        F.lit(None).cast("string").alias("simbad_type"),
    )
    return looked_up(matches.filter(chosen)).union(rest)
