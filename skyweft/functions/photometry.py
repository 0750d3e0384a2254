"""Colours, magnitudes, membership, quality and novelty expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skyweft.config import ClusterConfig, Scenario
from skyweft.functions.nulls import clip, flag, is_finite


def color_index(first_mag: Column, second_mag: Column) -> Column:
    return first_mag - second_mag


def absolute_magnitude(g_mag: Column, parallax_mas: Column) -> Column:
    """Approximate absolute magnitude; the parallax is floored at 0.1 mas."""
    return g_mag + F.lit(5.0) * F.log10(clip(parallax_mas, low=0.1) / F.lit(1000.0)) + F.lit(5.0)


def _near(value: Column, centre: float, tolerance: float) -> Column:
    return F.abs(value - F.lit(centre)) < F.lit(tolerance)


def membership_criterion(
    parallax: Column, pmra: Column, pmdec: Column, scenario: Scenario, cluster: ClusterConfig = ClusterConfig()
) -> Column:
    """Strict parallax window and proper-motion box; an absent clause is skipped."""
    clauses = [F.lit(True)]
    if scenario.parallax_window is not None:
        low, high = scenario.parallax_window
        clauses += [parallax > F.lit(low), parallax < F.lit(high)]
    if scenario.pm_tolerance is not None:
        clauses += [
            _near(pmra, cluster.pmra_centre, scenario.pm_tolerance),
            _near(pmdec, cluster.pmdec_centre, scenario.pm_tolerance),
        ]
    combined = clauses[0]
    for clause in clauses[1:]:
        combined = combined & clause
    return flag(combined)


def cluster_member(
    parallax: Column, pmra: Column, pmdec: Column, cluster: ClusterConfig = ClusterConfig()
) -> Column:
    window = (cluster.parallax_low, cluster.parallax_high)
    return membership_criterion(parallax, pmra, pmdec, Scenario("member", window, cluster.pm_tolerance), cluster)


def photometric_quality(w1_sigma: Column, w2_sigma: Column, g_mag: Column) -> Column:
    """Both infrared errors below 0.2 mag (a missing one counts as 99) and G < 17.5."""
    small = [F.coalesce(c, F.lit(99.0)) < F.lit(0.2) for c in (w1_sigma, w2_sigma)]
    return flag(small[0] & small[1] & (g_mag < F.lit(17.5)))


def valid_features(quality: Column, *features: Column) -> Column:
    valid = flag(quality)
    for feature in features:
        valid = valid & is_finite(feature)
    return valid


def novelty_score(quality: Column, known: Column, posterior: Column, anomaly: Column, ruwe: Column) -> Column:
    """Weighted sum of five yes/no terms, at most 4.3."""
    # Weight of each term.
    terms = (
        (quality, 1.0),
        (known == F.lit(0), 1.0),
        (posterior > F.lit(0.95), 0.5),
        (F.coalesce(anomaly, F.lit(0.0)) > F.lit(0.6), 1.5),
        (F.coalesce(ruwe, F.lit(99.0)) < F.lit(1.4), 0.3),
    )
    score = F.lit(0.0)
    for condition, weight in terms:
        score = score + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return score


def mahalanobis_distance(
    parallax: Column, pmra: Column, pmdec: Column, cluster: ClusterConfig = ClusterConfig()
) -> Column:
    """Distance to the cluster centroid in units of its spread, axes independent."""
    axes = (
        (parallax, cluster.parallax_centre, cluster.parallax_spread),
        (pmra, cluster.pmra_centre, cluster.pm_spread),
        (pmdec, cluster.pmdec_centre, cluster.pm_spread),
    )
    total = F.lit(0.0)
    for value, centre, spread in axes:
        z = (value - F.lit(centre)) / F.lit(spread)
        total = total + z * z
    return F.sqrt(total)


def membership_score(distance: Column) -> Column:
    return F.exp(F.lit(-0.5) * distance * distance)


def discrimination_band(auc: Column) -> Column:
    """Verbal band of an area under the ROC curve."""
    return (
        F.when(auc > 0.95, F.lit("excellent"))
        .when(auc > 0.85, F.lit("good"))
        .when(auc > 0.7, F.lit("moderate"))
        .otherwise(F.lit("low"))
    )
