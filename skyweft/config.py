"""Constants and parameter records shared by the plans."""

from __future__ import annotations

from dataclasses import dataclass

# Unit conversions and catalog epochs.
MAS_PER_DEGREE = 3.6e6
ARCSEC_PER_DEGREE = 3600.0
ARCSEC_PER_RADIAN = 206264.80624709636
OPTICAL_EPOCH = 2016.0
INFRARED_EPOCH = 2010.5
REFERENCE_EPOCH = 2015.5


@dataclass(frozen=True)
class FieldConfig:
    """A circular field and the limits of a quick cross-match over it."""

    ra: float
    dec: float
    radius: float
    gaia_limit: int | None = None
    match_threshold_arcsec: float = 2.0
    known_object_limit: int | None = None
    known_object_radius_arcsec: float = 2.0
    gaia_epoch: float = OPTICAL_EPOCH
    wise_epoch: float = INFRARED_EPOCH


@dataclass(frozen=True)
class ClusterConfig:
    """Astrometric box and centroid that describe one open cluster."""

    parallax_low: float = 2.0
    parallax_high: float = 2.8
    parallax_centre: float = 2.4
    parallax_spread: float = 0.2
    pmra_centre: float = -4.7
    pmdec_centre: float = 11.2
    pm_tolerance: float = 2.0
    pm_spread: float = 1.0


@dataclass(frozen=True)
class MatchConfig:
    """Parameters of the full probabilistic cross-match."""

    gaia_epoch: float = OPTICAL_EPOCH
    wise_epoch: float = INFRARED_EPOCH
    max_g_mag: float = 19.0
    prefilter_arcsec: float = 5.0
    expected_match_fraction: float = 0.7
    posterior_floor: float = 0.01
    known_object_radius_arcsec: float = 5.0
    top_candidates: int = 15


@dataclass(frozen=True)
class Scenario:
    """One membership criterion of the ablation grid; ``None`` skips a clause."""

    name: str
    parallax_window: tuple[float, float] | None = None
    pm_tolerance: float | None = None


# The eight published membership criteria.
ABLATION_SCENARIOS = (
    Scenario("parallax +-0.4", (2.0, 2.8), None),
    Scenario("parallax +-0.2", (2.2, 2.6), None),
    Scenario("pm +-2", None, 2.0),
    Scenario("pm +-1", None, 1.0),
    Scenario("parallax +-0.4 and pm +-2", (2.0, 2.8), 2.0),
    Scenario("parallax +-0.4 and pm +-1.5", (2.0, 2.8), 1.5),
    Scenario("parallax +-0.3 and pm +-1.5", (2.1, 2.7), 1.5),
    Scenario("parallax +-0.2 and pm +-1.0", (2.2, 2.6), 1.0),
)
