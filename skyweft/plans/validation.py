"""Validation of matches against a published member list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skyweft.config import ClusterConfig
from skyweft.functions import photometry
from skyweft.operators import members as member_ops, metrics
from skyweft.operators.nearest import NearestOptions
from skyweft.operators.ranked import exact_quantiles, roc_auc

BRIGHTEST_COLUMNS = (
    "gaia_source_id", "gaia_phot_g_mean_mag", "gaia_parallax", "gaia_pmra", "gaia_pmdec", "list_proba"
)


def labelled_matches(
    matches: DataFrame, members: DataFrame, cluster: ClusterConfig = ClusterConfig(),
    options: NearestOptions = NearestOptions(),
) -> DataFrame:
    """Listed sources with labels, error category and continuous membership score."""
    marked = member_ops.mark_listed(
        matches, member_ops.match_members(members, matches, how="inner", options=options)
    )
    return with_membership_score(member_ops.comparison_labels(marked), cluster)


def with_membership_score(labelled: DataFrame, cluster: ClusterConfig = ClusterConfig()) -> DataFrame:
    distance = photometry.mahalanobis_distance(
        F.col("gaia_parallax"), F.col("gaia_pmra"), F.col("gaia_pmdec"), cluster
    )
    return labelled.withColumn("mahalanobis", distance).withColumn(
        "membership_score", photometry.membership_score(F.col("mahalanobis"))
    )


def match_rate(member_matches: DataFrame) -> DataFrame:
    """One row: list size, matched, unmatched, rate in percent, median and largest separation."""
    median = exact_quantiles(member_matches, "separation_arcsec", {"m": 0.5}).scalar()
    return member_matches.agg(
        F.count(F.lit(1)).alias("n_members"),
        F.count("source_key").alias("n_matched"),
        F.count_if(F.col("source_key").isNull()).alias("n_unmatched"),
        F.max("separation_arcsec").alias("max_separation"),
    ).select(
        "n_members",
        "n_matched",
        "n_unmatched",
        F.try_divide(F.lit(100.0) * F.col("n_matched"), F.col("n_members")).alias("matched_percent"),
        median.alias("median_separation"),
        "max_separation",
    )


def probability_cuts(members: DataFrame, cuts: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """Listed members above each probability cut, in one row."""
    return members.agg(
        *[F.count_if(F.col("proba") > F.lit(c)).alias(f"above_{int(round(c * 100))}") for c in cuts]
    )


def brightest_errors(labelled: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` brightest false positives and false negatives."""
    order = Window.partitionBy("category").orderBy("gaia_phot_g_mean_mag", "gaia_source_id")
    errors = labelled.filter(F.col("category").isin("FP", "FN"))
    return (
        errors.select("category", *BRIGHTEST_COLUMNS, F.row_number().over(order).alias("place"))
        .filter(F.col("place") <= n)
    )


def error_summary(labelled: DataFrame) -> DataFrame:
    """Per error category: count, probability range and medians of probability and astrometry."""
    medians = {
        "median_proba": "list_proba",
        "median_parallax": "gaia_parallax",
        "median_pmra": "gaia_pmra",
        "median_pmdec": "gaia_pmdec",
    }
    summary = labelled.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min("list_proba").alias("min_proba"), F.max("list_proba").alias("max_proba")
    )
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(c).alias("_value")) for n, c in medians.items()]))
    long = labelled.select("category", values.alias("_v")).select("category", "_v.*")
    middle = exact_quantiles(long, "_value", {"_median": 0.5}, by=["category", "_name"]).groupBy("category").agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(n) for n in medians])
    return summary.join(middle, "category", "left")


def validation_summary(labelled: DataFrame, member_matches: DataFrame) -> DataFrame:
    """One row: compared sources, confusion, precision, recall, F1, accuracy, AUC and coverage of the list."""
    confusion = metrics.confusion_counts(labelled)
    auc = roc_auc(labelled, "membership_score", "y_true").scalar()
    coverage = member_matches.agg(F.try_divide(F.lit(100.0) * F.count("source_key"), F.count(F.lit(1)))).scalar()
    counts = confusion.select(F.struct("tn", "fp", "fn", "tp")).scalar()
    return metrics.headline_metrics(confusion).select(
        *[counts.getField(c).alias(c) for c in ("tn", "fp", "fn", "tp")], "precision", "recall", "f1", "accuracy",
        auc.alias("roc_auc"), coverage.alias("coverage_percent"))
