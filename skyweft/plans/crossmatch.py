"""The cross-match plans: quick match and full probabilistic match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyweft.config import ClusterConfig, FieldConfig, MatchConfig
from skyweft.functions import bayes, photometry
from skyweft.functions.astrometry import gaia_radial_sigma, propagate_position, wise_radial_sigma
from skyweft.functions.once import with_columns_once
from skyweft.operators.assign import one_to_one
from skyweft.operators.enrich import enrich_known_objects, flag_known_objects, join_tic
from skyweft.operators.isolation import fit_isolation_forest, score_isolation_forest
from skyweft.operators.nearest import NearestOptions, crossmatch_k_nearest, crossmatch_nearest, pairs_within
from skyweft.session import cut_lineage
from skyweft.sources.conform import select_present

FEATURES = ("gaia_bp_rp", "w1_w2", "m_g_approx")
GAIA_KEPT = ("source_id", "ra", "dec", "parallax", "pmra", "pmdec", "phot_g_mean_mag", "bp_rp", "ruwe")
WISE_KEPT = ("ra", "dec", "w1mpro", "w2mpro", "w3mpro", "w4mpro", "w1sigmpro", "w2sigmpro")


def quick_match(gaia: DataFrame, wise: DataFrame, field: FieldConfig, options: NearestOptions = NearestOptions()) -> DataFrame:
    """Nearest infrared source at its own epoch, with Bayes factor and fixed-prior posterior."""
    moved = propagate_position(gaia, field.gaia_epoch, field.wise_epoch)
    matched = crossmatch_nearest(
        moved, wise, left_ra="ra_epoch", left_dec="dec_epoch",
        threshold_arcsec=field.match_threshold_arcsec, options=options,
    )
    factor = bayes.bayes_factor_arcsec(F.col("distance_arcsec"))
    return matched.withColumn("bayes_factor_pos", factor).withColumn(
        "posterior_match", bayes.posterior_probability(F.col("bayes_factor_pos"))
    )


def quick_match_raw(gaia: DataFrame, wise: DataFrame, field: FieldConfig, options: NearestOptions = NearestOptions()) -> DataFrame:
    """Nearest infrared source without moving to its epoch: keys and separation only."""
    return crossmatch_nearest(
        gaia.select("source_id", "ra", "dec"), wise.select("designation", "ra", "dec"),
        threshold_arcsec=field.match_threshold_arcsec, options=options,
    )


def match_field(gaia: DataFrame, wise: DataFrame, simbad: DataFrame, field: FieldConfig) -> DataFrame:
    """Quick match with known-object flags on the first rows.

    The matches are written out once, because looking up goes over them twice.
    """
    return flag_known_objects(
        cut_lineage(quick_match(gaia, wise, field)), simbad,
        radius_arcsec=field.known_object_radius_arcsec, limit=field.known_object_limit,
    )


def quick_summary(gaia: DataFrame, wise: DataFrame, raw: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of counts over a quick run."""
    def count(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return matches.agg(
        F.count(F.lit(1)).alias("matches_pm"),
        F.count("known_in_simbad").alias("checked"),
        F.coalesce(F.sum("known_in_simbad"), F.lit(0)).alias("known"),
    ).select(
        count(gaia).alias("total_gaia"), count(wise).alias("total_wise"), count(raw).alias("matches_raw"),
        "matches_pm", "checked", "known",
    )


def needed_columns(wise: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """The infrared columns that a full match uses, or that ``wanted`` columns of its result need, so that no others are read and moved.

    Right columns ride through the join as one value, from which Spark drops none by itself.
    """
    needs = {*(wanted or ()), *(("wise_w1mpro", "wise_w2mpro") if "w1_w2" in (wanted or ()) else ())}
    kept = [c for c in WISE_KEPT if wanted is None or c in ("ra", "dec") or f"wise_{c}" in needs]
    return select_present(wise, ("designation", "sigra", "sigdec", *kept))


def candidate_pairs(
    gaia: DataFrame, wise: DataFrame, config: MatchConfig = MatchConfig(), options: NearestOptions = NearestOptions()
) -> DataFrame:
    """Nearest infrared source of each optical source below the prefilter radius, with log evidence.

    All columns of both sides ride along, so nothing has to be joined back.
    """
    moved = propagate_position(
        gaia, config.gaia_epoch, config.wise_epoch, out_ra="ra_at_wise", out_dec="dec_at_wise"
    )
    return with_evidence(crossmatch_nearest(
        moved, wise, left_ra="ra_at_wise", left_dec="dec_at_wise",
        threshold_arcsec=config.prefilter_arcsec, separation="psi_arcsec", options=options,
    ))


def all_candidate_pairs(
    gaia: DataFrame, wise: DataFrame, config: MatchConfig = MatchConfig(), most: int | None = None
) -> DataFrame:
    """Every pair below the prefilter radius, or the ``most`` nearest of each optical source, with log evidence."""
    moved = propagate_position(
        gaia, config.gaia_epoch, config.wise_epoch, out_ra="ra_at_wise", out_dec="dec_at_wise"
    )
    places = {"left_ra": "ra_at_wise", "left_dec": "dec_at_wise", "separation": "psi_arcsec"}
    if most is None:
        return with_evidence(pairs_within(moved, wise, radius_arcsec=config.prefilter_arcsec, **places))
    return with_evidence(crossmatch_k_nearest(moved, wise, k=most, threshold_arcsec=config.prefilter_arcsec, **places))


def with_evidence(near: DataFrame) -> DataFrame:
    """Pairs with both positional errors and the log of the Bayes factor."""
    errors = with_columns_once(
        near,
        {
            "sigma_gaia": gaia_radial_sigma(F.col("gaia_ra_error"), F.col("gaia_dec_error")),
            "sigma_wise": wise_radial_sigma(F.col("wise_sigra"), F.col("wise_sigdec")),
        },
    )
    return with_columns_once(
        errors, {"ln_b": bayes.log_bayes_factor(F.col("psi_arcsec"), F.col("sigma_gaia"), F.col("sigma_wise"))})


def prior_odds(
    gaia: DataFrame, wise: DataFrame, area_sr: Column | float, config: MatchConfig = MatchConfig()
) -> DataFrame:
    """One row: source counts and the prior odds they imply over the area."""
    n_gaia = gaia.agg(F.count(F.lit(1)).alias("n_gaia"))
    n_wise = wise.agg(F.count(F.lit(1)).alias("n")).scalar()
    return n_gaia.withColumn("n_wise", n_wise).withColumn(
        "prior_odds",
        bayes.density_prior_odds(F.col("n_gaia"), F.col("n_wise"), area_sr, config.expected_match_fraction),
    )


def score_pairs(pairs: DataFrame, odds: DataFrame) -> DataFrame:
    """Add the posterior; the odds are a single value of their own small plan."""
    value = odds.select("prior_odds").scalar()
    return pairs.withColumn("posterior", bayes.posterior_from_log(F.col("ln_b"), value))


def resolve_matches(
    scored: DataFrame, config: MatchConfig = MatchConfig(), cluster: ClusterConfig = ClusterConfig()
) -> DataFrame:
    """Posterior floor, one-to-one resolution, kept columns, colour and member flag."""
    chosen = one_to_one(scored.filter(F.col("posterior") > F.lit(config.posterior_floor)))
    wise_kept = [f"wise_{c}" for c in WISE_KEPT if f"wise_{c}" in chosen.columns]
    colour = photometry.color_index(F.col("wise_w1mpro"), F.col("wise_w2mpro")).alias("w1_w2")
    return chosen.select(
        *[f"gaia_{c}" for c in GAIA_KEPT],
        "wise_designation",
        *wise_kept,
        "psi_arcsec",
        "ln_b",
        "posterior",
        *([colour] if {"wise_w1mpro", "wise_w2mpro"} <= set(wise_kept) else []),
        photometry.cluster_member(
            F.col("gaia_parallax"), F.col("gaia_pmra"), F.col("gaia_pmdec"), cluster
        ).alias("cluster_member"),
    )


def probabilistic_matches(
    gaia: DataFrame,
    wise: DataFrame,
    area_sr: Column | float,
    config: MatchConfig = MatchConfig(),
    cluster: ClusterConfig = ClusterConfig(),
    options: NearestOptions = NearestOptions(),
) -> DataFrame:
    """From two catalogs to unique matches with posterior, colour and member flag."""
    pairs = candidate_pairs(gaia, needed_columns(wise), config, options)
    return resolve_matches(score_pairs(pairs, prior_odds(gaia, wise, area_sr, config)), config, cluster)


def enrich_matches(
    matches: DataFrame, tic: DataFrame, simbad: DataFrame, config: MatchConfig = MatchConfig(),
    options: NearestOptions = NearestOptions(),
) -> DataFrame:
    """Known-object flags, then input-catalog identifiers.

    The flags come first because identifiers may repeat a source.
    """
    known = enrich_known_objects(
        matches, simbad, radius_arcsec=config.known_object_radius_arcsec, options=options
    )
    return join_tic(known, tic)


def with_features(matches: DataFrame) -> DataFrame:
    """Absolute magnitude, photometric quality and feature validity."""
    quality = photometry.photometric_quality(
        F.col("wise_w1sigmpro"), F.col("wise_w2sigmpro"), F.col("gaia_phot_g_mean_mag")
    )
    magnitude = photometry.absolute_magnitude(F.col("gaia_phot_g_mean_mag"), F.col("gaia_parallax"))
    featured = matches.withColumns({"m_g_approx": magnitude, "quality": quality})
    return featured.withColumn(
        "valid_features", photometry.valid_features(F.col("quality"), *[F.col(f) for f in FEATURES])
    )


def with_anomaly(featured: DataFrame, *, seed: int = 42) -> DataFrame:
    """Isolation-forest score of the rows with valid features, NULL for the others.

    A source that input-catalog entries repeat is drawn row by row.
    """
    key = [c for c in ("gaia_source_id", "tic_id") if c in featured.columns]
    forest = fit_isolation_forest(featured.filter("valid_features"), FEATURES, key, seed=seed)
    return score_isolation_forest(featured, forest, FEATURES, "valid_features")


def with_novelty(scored: DataFrame) -> DataFrame:
    return scored.withColumn(
        "novelty_score",
        photometry.novelty_score(
            F.col("quality"), F.col("known_in_simbad"), F.col("posterior"), F.col("anomaly_score"), F.col("gaia_ruwe")
        ),
    )


def top_candidates(scored: DataFrame, n: int = 15) -> DataFrame:
    """Rows of good quality with the largest novelty; ties by identifier."""
    return (
        scored.filter("quality")
        .orderBy(F.col("novelty_score").desc(), F.col("gaia_source_id"), F.col("tic_id"))
        .limit(n)
    )


def first_with_tic(candidates: DataFrame) -> DataFrame:
    """The best candidate that has an input-catalog identifier."""
    return (
        candidates.filter(F.col("tic_id").isNotNull())
        .orderBy(F.col("novelty_score").desc(), F.col("gaia_source_id"), F.col("tic_id"))
        .limit(1)
    )


def run_summary(gaia: DataFrame, wise: DataFrame, pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of headline counts of a full run."""
    def count(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return matches.agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.coalesce(F.sum("known_in_simbad"), F.lit(0)).alias("n_known"),
        F.count_if("cluster_member").alias("n_members"),
    ).select(
        count(gaia).alias("n_gaia"), count(wise).alias("n_wise"), count(pairs).alias("n_candidates"),
        "n_matches", "n_known", "n_members",
    )
