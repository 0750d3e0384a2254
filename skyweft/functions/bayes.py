"""Two-catalog positional Bayes factor (Budavari & Szalay 2008) and posteriors.

The radian form is carried as a logarithm, which does not underflow for pairs
many sigma apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from skyweft.config import ARCSEC_PER_RADIAN


def _as_column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def bayes_factor_arcsec(
    separation: Column, sigma1: Column | float = 0.1, sigma2: Column | float = 0.5
) -> Column:
    """Bayes factor with variances in square arcsec; NULL for a variance that is not positive."""
    first, second = _as_column(sigma1), _as_column(sigma2)
    variance = first * first + second * second
    weight = F.exp(-(separation * separation) / (F.lit(2.0) * variance))
    return F.when(variance > 0, F.lit(2.0) / variance * weight)


def log_bayes_factor(separation: Column, sigma1: Column | float, sigma2: Column | float) -> Column:
    """Natural log of the Bayes factor with variances in square radians (1/sr)."""
    first, second = _as_column(sigma1), _as_column(sigma2)
    variance = first * first + second * second
    scale = math.log(2.0) + 2.0 * math.log(ARCSEC_PER_RADIAN)
    return F.when(
        variance > 0,
        F.lit(scale) - F.ln(variance) - separation * separation / (F.lit(2.0) * variance),
    )


def posterior_probability(bayes_factor: Column, prior: float = 0.5) -> Column:
    """Posterior of a match for a fixed prior probability."""
    if not 0.0 < prior < 1.0:
        raise ValueError("prior must lie strictly between 0 and 1")
    odds = bayes_factor * F.lit(prior / (1.0 - prior))
    return odds / (F.lit(1.0) + odds)


def posterior_from_log(log_factor: Column, prior_odds: Column) -> Column:
    """Posterior from log evidence and prior odds, in a form that cannot overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(log_factor + F.ln(prior_odds))))


def density_prior_odds(
    n_first: Column, n_second: Column, area_sr: Column | float, match_fraction: float = 0.7
) -> Column:
    """Prior odds when ``match_fraction`` of the smaller catalog has a counterpart.

    Densities are counts over the area, so the odds reduce to
    ``fraction * min(n1, n2) * area / (n1 * n2)``.
    """
    first, second = n_first.cast("double"), n_second.cast("double")
    expected = F.lit(match_fraction) * F.least(first, second)
    return F.try_divide(expected * _as_column(area_sr), first * second)


def edge_cost(log_factor: Column) -> Column:
    """Cost of accepting a pair: the smaller, the better the match."""
    return -log_factor
