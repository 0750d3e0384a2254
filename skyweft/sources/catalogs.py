"""Catalog scans over tables that have been landed as parquet.

All scans are lazy. Cones lead with plain declination and right-ascension
bounds and magnitude cuts stay plain comparisons, so they reach the parquet
reader; projections are declared, so only those columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyweft.functions.sphere import within_cone
from skyweft.operators.topk import first_rows
from skyweft.sources import schemas
from skyweft.sources.conform import conform, find_column, select_present

Cone = tuple[float, float, float]


def in_cone(df: DataFrame, cone: Cone | None) -> DataFrame:
    """Rows inside ``(ra, dec, radius)`` degrees; all rows for None."""
    return df if cone is None else df.filter(within_cone(F.col("ra"), F.col("dec"), *cone))


def scan_gaia_quick(
    df: DataFrame, cone: Cone | None = None, limit: int | None = None, clean: bool = True
) -> DataFrame:
    """The 14-column optical scan; ``limit`` keeps the smallest identifiers."""
    rows = conform(in_cone(df, cone), schemas.GAIA_QUICK, clean)
    return rows if limit is None else first_rows(rows, "source_id", limit)


def scan_gaia(
    df: DataFrame, cone: Cone | None = None, max_g_mag: float = 19.0, clean: bool = True
) -> DataFrame:
    """The 17-column optical scan: brighter than ``max_g_mag``, with a parallax."""
    rows = in_cone(df, cone).filter(F.col("phot_g_mean_mag") < F.lit(max_g_mag)).filter(F.col("parallax").isNotNull())
    return conform(rows, schemas.GAIA, clean)


def scan_allwise(df: DataFrame, cone: Cone | None = None, keep_all: bool = False) -> DataFrame:
    """The infrared scan: the wanted columns that are present, or all of them."""
    rows = in_cone(df, cone)
    return rows if keep_all else select_present(rows, schemas.ALLWISE.fieldNames())


def scan_tic(df: DataFrame, cone: Cone | None = None, clean: bool = True) -> DataFrame:
    return conform(in_cone(df, cone), schemas.TIC, clean)


def scan_simbad(df: DataFrame, cone: Cone | None = None, clean: bool = True) -> DataFrame:
    return conform(in_cone(df, cone), schemas.SIMBAD, clean)


def scan_lightcurve(df: DataFrame, target_id: str | None = None) -> DataFrame:
    """Light-curve rows, of one target or of all."""
    return df if target_id is None else df.filter(F.col("target_id") == F.lit(target_id))


def scan_members(df: DataFrame, names: Sequence[str], cone: Cone | None = None) -> DataFrame:
    """Member rows of a cluster under the first of several names that has any.

    If no name has rows, the cone serves as a last resort. Which choice applies
    is one aggregated value inside the plan, so nothing is collected.
    """
    last = len(names)
    rank = F.lit(None).cast("int")
    if cone is not None:
        ra = find_column(df.columns, schemas.MEMBER_RA_NAMES)
        dec = find_column(df.columns, schemas.MEMBER_DEC_NAMES)
        rank = F.when(within_cone(F.col(f"`{ra}`"), F.col(f"`{dec}`"), *cone), F.lit(last))
    for i, name in reversed(list(enumerate(names))):
        rank = F.when(F.col("Cluster") == F.lit(name), F.lit(i)).otherwise(rank)
    ranked = df.withColumn("_rank", rank)
    # A row outside the last-resort cone still belongs to its own name, so the
    # cone is only reached when no row carries any of the names.
    best = ranked.agg(F.min("_rank")).scalar()
    return ranked.filter(F.col("_rank") == best).drop("_rank")


def _number(identifier: Column) -> Column:
    """A whole number per identifier: itself where it is one, else a hash of its text."""
    return F.coalesce(identifier.try_cast("long"), F.xxhash64(identifier))


def standard_members(df: DataFrame) -> DataFrame:
    """Member list under fixed column names, whatever names it arrived with.

    Optional columns that are absent become NULL; ``ordinal`` (row order of the
    list, used when several rows fall on one source) defaults to the identifier.
    """
    def pick(out: str, names: Sequence[str], kind: str, ignore_case: bool = False, required: bool = False) -> Column:
        found = find_column(df.columns, names, ignore_case)
        if found is None and required:
            raise ValueError(f"member list has none of the columns {tuple(names)}")
        column = F.lit(None) if found is None else F.col(f"`{found}`")
        return column.cast(kind).alias(out)

    identifier = pick("member_id", schemas.MEMBER_ID_NAMES, "string", True)
    ordinal = F.col("ordinal").cast("long") if "ordinal" in df.columns else _number(identifier)
    return df.select(
        identifier,
        ordinal.alias("ordinal"),
        pick("proba", schemas.MEMBER_PROBABILITY_NAMES, "double", True),
        pick("g_mag", schemas.MEMBER_MAGNITUDE_NAMES, "double", True),
        pick("ra", schemas.MEMBER_RA_NAMES, "double", required=True),
        pick("dec", schemas.MEMBER_DEC_NAMES, "double", required=True),
        pick("pmra", schemas.MEMBER_PMRA_NAMES, "double"),
        pick("pmdec", schemas.MEMBER_PMDEC_NAMES, "double"),
        pick("parallax", schemas.MEMBER_PARALLAX_NAMES, "double"),
    )


def read_first_existing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet at the first path that exists, on any file system Spark knows."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        location = jvm.org.apache.hadoop.fs.Path(path)
        if location.getFileSystem(hadoop).exists(location):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")
