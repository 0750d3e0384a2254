"""Comparison with a published member list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyweft.config import OPTICAL_EPOCH, REFERENCE_EPOCH
from skyweft.functions.astrometry import propagate_position
from skyweft.functions.nulls import flag
from skyweft.operators.nearest import NearestOptions, crossmatch_nearest


def match_members(
    members: DataFrame,
    matches: DataFrame,
    *,
    key: str = "gaia_source_id",
    ra: str = "gaia_ra",
    dec: str = "gaia_dec",
    tolerance_arcsec: float = 1.0,
    how: str = "left",
    options: NearestOptions = NearestOptions(coarse_filter=True),
) -> DataFrame:
    """Nearest of our sources for each listed member, after moving the list to our epoch.

    A list covers little of the sky, so our sources far from it are dropped first.

    Adds ``source_key`` and ``separation_arcsec``, NULL for a member without a match.
    """
    moved = propagate_position(members, REFERENCE_EPOCH, OPTICAL_EPOCH)
    ours = matches.select(F.col(key).alias("key"), F.col(ra).alias("ra"), F.col(dec).alias("dec"))
    matched = crossmatch_nearest(
        moved,
        ours,
        left_key="ordinal",
        right_key="key",
        left_ra="ra_epoch",
        left_dec="dec_epoch",
        threshold_arcsec=tolerance_arcsec,
        left_prefix="",
        right_prefix="_ours_",
        separation="separation_arcsec",
        how=how,
        options=options,
    )
    return matched.withColumnRenamed("_ours_key", "source_key").drop("_ours_ra", "_ours_dec")


def mark_listed(matches: DataFrame, member_matches: DataFrame, *, key: str = "gaia_source_id") -> DataFrame:
    """Write list membership and probability onto our rows.

    Where several listed members fall on one source, the last in list order counts,
    and of equals in that order the more probable one.
    """
    last = (
        member_matches.filter(F.col("source_key").isNotNull())
        .groupBy(F.col("source_key").alias(key))
        .agg(F.max_by("proba", F.struct("ordinal", "proba")).alias("list_proba"), F.lit(True).alias("_listed"))
    )
    return matches.join(last, key, "left").withColumn("in_list", flag(F.col("_listed"))).drop("_listed")


def comparison_labels(marked: DataFrame, *, predicted: str = "cluster_member", threshold: float = 0.5) -> DataFrame:
    """Restrict to listed sources and add 0/1 labels and the error category."""
    y_true = flag(F.col("list_proba") > F.lit(threshold)).cast("int")
    y_pred = flag(F.col(predicted)).cast("int")
    labelled = marked.filter("in_list").withColumns({"y_true": y_true, "y_pred": y_pred})
    category = (
        F.when((F.col("y_true") == 1) & (F.col("y_pred") == 1), "TP")
        .when(F.col("y_pred") == 1, "FP")
        .when(F.col("y_true") == 1, "FN")
        .otherwise("TN")
    )
    return labelled.withColumn("category", category)
