"""Every operator as a query over the derived sky catalogs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skyweft.config import INFRARED_EPOCH, OPTICAL_EPOCH, REFERENCE_EPOCH, FieldConfig
from skyweft.functions import astrometry, bayes, photometry, sphere
from skyweft.operators import clusters, density, enrich, histogram as hist, incremental, lightcurve, members, metrics, quadtree, ranked
from skyweft.operators.assign import assign_components, one_to_one
from skyweft.operators.nearest import NearestOptions, crossmatch_k_nearest, crossmatch_nearest, pairs_within
from skyweft.plans import crossmatch as xm, validation
from skyweft.plans.survey import CLUSTER_NAMES, FIELD_CONE, FIELD_RADIUS_DEG, Survey
from skyweft.session import cut_lineage, shared_folder, ship_code
from skyweft.sources import catalogs, schemas, skycells
from skyweft.sources.conform import conform, prefixed
from skyweft.streaming import alerts

Query = Callable[[SparkSession, str], DataFrame]
FIELD = FieldConfig(*FIELD_CONE)
SMOKE_FIELD = FieldConfig(119.5, -60.83, 0.05)
LANDED_BUCKETS = 8
#: Columns of matches that looking up takes, and those that comparisons with the member list show.
PLACED = ("gaia_source_id", "gaia_ra", "gaia_dec")
COMPARED = (*PLACED, "gaia_parallax", "gaia_pmra", "gaia_pmdec", "gaia_phot_g_mean_mag", "gaia_bp_rp")
_QUERIES: dict[str, Query] = {}


def query(function: Callable[[Survey], DataFrame]) -> Callable[[Survey], DataFrame]:
    """Register a function of the survey under its own name."""

    def run(spark: SparkSession, table_dir: str) -> DataFrame:
        ship_code(spark)
        return function(Survey(spark, table_dir))

    _QUERIES[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double so that another engine's last digit does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# Stages shared by several queries; all lazy.


def _gaia(s: Survey) -> DataFrame:
    return catalogs.scan_gaia(s.gaia, clean=False)


def _moved(s: Survey) -> DataFrame:
    return astrometry.propagate_position(s.gaia, OPTICAL_EPOCH, INFRARED_EPOCH)


def _pairs(s: Survey, wanted: Sequence[str] | None = None) -> DataFrame:
    return xm.candidate_pairs(_gaia(s), xm.needed_columns(s.wise, wanted))


def _scored(s: Survey, wanted: Sequence[str] | None = None) -> DataFrame:
    return xm.score_pairs(_pairs(s, wanted), xm.prior_odds(_gaia(s), s.wise, s.area_sr()))


def _matches(s: Survey) -> DataFrame:
    return xm.resolve_matches(_scored(s))


def _landed_matches(s: Survey, *columns: str) -> DataFrame:
    """Columns of the matches written out once, for plans that go over them several times; no others are moved."""
    return cut_lineage(xm.resolve_matches(_scored(s, columns)).select(*columns))


def _members(s: Survey) -> DataFrame:
    return catalogs.standard_members(s.members)


def _labelled(s: Survey) -> DataFrame:
    return validation.labelled_matches(_landed_matches(s, *COMPARED, "cluster_member"), _members(s))


def _landed_labels(s: Survey) -> DataFrame:
    columns = ("y_true", "y_pred", "category", "membership_score", "list_proba", *COMPARED)
    return cut_lineage(_labelled(s).select(*columns))


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


# Scans


@query
def scan_cone(s: Survey) -> DataFrame:
    return rounded(catalogs.scan_gaia_quick(s.gaia, FIELD_CONE, clean=False))


@query
def scan_cone_top(s: Survey) -> DataFrame:
    """The cone scan with an explicit limit."""
    return rounded(catalogs.scan_gaia_quick(s.gaia, FIELD_CONE, limit=1500, clean=False))


@query
def scan_gaia_filtered(s: Survey) -> DataFrame:
    return rounded(catalogs.scan_gaia(s.gaia, FIELD_CONE, clean=False))


@query
def scan_wise_cone(s: Survey) -> DataFrame:
    return rounded(catalogs.scan_allwise(s.wise, FIELD_CONE, keep_all=True))


@query
def scan_conform_projection(s: Survey) -> DataFrame:
    """A table that lacks some wanted columns and has NaN, brought into the declared shape."""
    incomplete = s.relation("wise").drop("w4mpro", "w4sigmpro").withColumn("extra", F.lit(1))
    return rounded(conform(catalogs.scan_allwise(incomplete), schemas.ALLWISE))


@query
def landed_cone_scan(s: Survey) -> DataFrame:
    """The cone scan over a catalog landed by sky cell."""
    landed = skycells.land_by_cell(s.gaia, buckets=LANDED_BUCKETS)
    return rounded(catalogs.scan_gaia_quick(skycells.landed_cone(landed, FIELD_CONE), clean=False))


@query
def scan_tic(s: Survey) -> DataFrame:
    return rounded(catalogs.scan_tic(s.tic, clean=False))


@query
def scan_simbad_field(s: Survey) -> DataFrame:
    return rounded(catalogs.scan_simbad(s.simbad, FIELD_CONE, clean=False))


@query
def scan_members_cascade(s: Survey) -> DataFrame:
    return rounded(catalogs.scan_members(s.members, CLUSTER_NAMES, FIELD_CONE))


@query
def members_cascade_second(s: Survey) -> DataFrame:
    """The list under the second name, the first one having no rows."""
    return rounded(catalogs.scan_members(s.members, ("no such cluster", CLUSTER_NAMES[1]), FIELD_CONE))


@query
def members_cascade_cone(s: Survey) -> DataFrame:
    """The list by position, no name having rows."""
    return rounded(catalogs.scan_members(s.members, ("no such cluster",), FIELD_CONE))


@query
def members_standard_columns(s: Survey) -> DataFrame:
    return rounded(_members(s))


@query
def prefix_columns(s: Survey) -> DataFrame:
    return rounded(prefixed(s.simbad, "simbad_"))


# Astrometry


@query
def propagate_epoch(s: Survey) -> DataFrame:
    return rounded(_moved(s).select("source_id", "ra_epoch", "dec_epoch"))


@query
def propagate_members(s: Survey) -> DataFrame:
    moved = astrometry.propagate_position(_members(s), REFERENCE_EPOCH, OPTICAL_EPOCH)
    return rounded(moved.select("ordinal", "ra_epoch", "dec_epoch"))


def _shift_stats(shifts: DataFrame) -> DataFrame:
    spread = ranked.exact_quantiles(shifts, "shift", {"median": 0.5, "p90": 0.9}).select(F.struct("median", "p90")).scalar()
    return rounded(
        shifts.agg(F.max("shift").alias("max_shift"), F.count_if(F.col("shift") > 1.0).alias("n_above_1")).select(
            spread["median"].alias("median_shift"), spread["p90"].alias("p90_shift"), "max_shift", "n_above_1"
        )
    )


@query
def pm_shift_stats(s: Survey) -> DataFrame:
    shift = astrometry.proper_motion_shift(F.col("pmra"), F.col("pmdec"), INFRARED_EPOCH - OPTICAL_EPOCH)
    return _shift_stats(s.gaia.select(shift.alias("shift")))


@query
def pm_shift_stats_compat(s: Survey) -> DataFrame:
    shift = astrometry.proper_motion_shift(
        F.col("pmra"), F.col("pmdec"), INFRARED_EPOCH - OPTICAL_EPOCH, dec=F.col("dec"), compat=True
    )
    return _shift_stats(s.gaia.select(shift.alias("shift")))


@query
def sep_vincenty(s: Survey) -> DataFrame:
    """Separation of every source from the field centre."""
    apart = sphere.separation_arcsec(F.col("ra"), F.col("dec"), F.lit(FIELD.ra), F.lit(FIELD.dec))
    return rounded(s.gaia.select("source_id", apart.alias("separation")))


@query
def sigma_effective(s: Survey) -> DataFrame:
    optical = astrometry.gaia_radial_sigma(F.col("ra_error"), F.col("dec_error"))
    infrared = astrometry.wise_radial_sigma(F.col("sigra"), F.col("sigdec"))
    return rounded(
        s.gaia.select(F.lit("gaia").alias("catalog"), F.col("source_id").cast("string").alias("key"), optical.alias("sigma"))
        .unionByName(s.wise.select(F.lit("wise").alias("catalog"), F.col("designation").alias("key"), infrared.alias("sigma")))
    )


# Nearest-neighbour joins


@query
def xmatch_nearest_raw(s: Survey) -> DataFrame:
    return rounded(xm.quick_match_raw(s.gaia, s.wise, FIELD))


@query
def xmatch_nearest_pm(s: Survey) -> DataFrame:
    moved = _moved(s).select("source_id", "ra_epoch", "dec_epoch", "phot_g_mean_mag")
    return rounded(
        crossmatch_nearest(moved, s.wise.select("designation", "ra", "dec", "w1mpro"), left_ra="ra_epoch",
                           left_dec="dec_epoch", threshold_arcsec=2.0)
    )


@query
def xmatch_nearest_crowded(s: Survey) -> DataFrame:
    """The widest join with sizes so small that cells are split by boxes and salted."""
    small = NearestOptions(max_candidates=1, leaf_rows=1, max_left_rows=2, salt_left=True)
    near = crossmatch_nearest(
        _moved(s).select("source_id", "ra_epoch", "dec_epoch"), s.wise.select("designation", "ra", "dec"),
        left_ra="ra_epoch", left_dec="dec_epoch", threshold_arcsec=5.0, options=small,
    )
    return rounded(near.select("gaia_source_id", "wise_designation", "distance_arcsec"))


@query
def xmatch_k_nearest(s: Survey) -> DataFrame:
    """The three nearest infrared sources of each optical one within 20 arcsec, ranked."""
    near = crossmatch_k_nearest(
        _moved(s).select("source_id", "ra_epoch", "dec_epoch"), s.wise.select("designation", "ra", "dec"), k=3,
        left_ra="ra_epoch", left_dec="dec_epoch", threshold_arcsec=20.0,
    )
    return rounded(near.select("gaia_source_id", "wise_designation", "rank", "distance_arcsec"))


@query
def xmatch_k_nearest_crowded(s: Survey) -> DataFrame:
    """The same join with sizes so small that cells are split by boxes."""
    small = NearestOptions(max_candidates=2, leaf_rows=1, max_left_rows=50, salt_left=True)
    near = crossmatch_k_nearest(
        _moved(s).select("source_id", "ra_epoch", "dec_epoch"), s.wise.select("designation", "ra", "dec"), k=3,
        left_ra="ra_epoch", left_dec="dec_epoch", threshold_arcsec=20.0, options=small,
    )
    return rounded(near.select("gaia_source_id", "wise_designation", "rank", "distance_arcsec"))


@query
def xmatch_pairs_within(s: Survey) -> DataFrame:
    """All pairs below 20 arcsec."""
    near = pairs_within(
        _moved(s).select("source_id", "ra_epoch", "dec_epoch"), s.wise.select("designation", "ra", "dec"),
        left_ra="ra_epoch", left_dec="dec_epoch", radius_arcsec=20.0,
    )
    return rounded(near.select("gaia_source_id", "wise_designation", "distance_arcsec"))


@query
def xmatch_of_landed(s: Survey) -> DataFrame:
    """Nearest infrared source of each source of an optical catalog landed by sky cell."""
    landed = skycells.land_by_cell(_moved(s).select("source_id", "ra_epoch", "dec_epoch"), "ra_epoch", "dec_epoch", buckets=LANDED_BUCKETS)
    near = skycells.nearest_of_landed(
        landed, s.wise.select("designation", "ra", "dec"), left_ra="ra_epoch", left_dec="dec_epoch")
    return rounded(near.select("gaia_source_id", "wise_designation", "distance_arcsec"))


@query
def xmatch_in_landed(s: Survey) -> DataFrame:
    """The same, with the infrared catalog landed."""
    landed = skycells.land_by_cell(s.wise.select("designation", "ra", "dec"), buckets=LANDED_BUCKETS)
    near = skycells.nearest_in_landed(
        _moved(s).select("source_id", "ra_epoch", "dec_epoch"), landed, left_ra="ra_epoch", left_dec="dec_epoch")
    return rounded(near.select("gaia_source_id", "wise_designation", "distance_arcsec"))


@query
def xmatch_incremental(s: Survey) -> DataFrame:
    """Nearest infrared sources in a landed table: the bright optical sources first, then an update with the whole catalog."""
    path = f"{shared_folder(s.spark)}/skyweft-{uuid.uuid4().hex}"
    places = {"left_ra": "ra_epoch", "left_dec": "dec_epoch"}
    wise = s.wise.select("designation", "ra", "dec")
    moved = _moved(s).select("source_id", "ra_epoch", "dec_epoch", "phot_g_mean_mag")
    incremental.update_matches(path, moved.filter("phot_g_mean_mag < 12"), wise, **places)
    incremental.update_matches(path, moved, wise, **places)
    found = incremental.read_matches(s.spark, path)
    return rounded(found.select("gaia_source_id", "wise_designation", "distance_arcsec"))


@query
def stream_alert_matches(s: Survey) -> DataFrame:
    """Nearest known object of every alert, the alerts read as a stream of files."""
    folder = f"{shared_folder(s.spark)}/skyweft-{uuid.uuid4().hex}"
    arrived = s.alerts.withColumn("time", F.col("time").cast("timestamp"))
    arrived.write.parquet(f"{folder}/alerts")
    stream = alerts.read_alerts(s.spark, f"{folder}/alerts", arrived.schema)
    alerts.catch_up(alerts.match_alerts(
        stream, s.simbad, f"{folder}/matched", f"{folder}/progress", right_key="main_id", threshold_arcsec=5.0, watermark="3650 days"))
    found = alerts.read_matched(s.spark, f"{folder}/matched")
    return rounded(found.select("gaia_alert_id", "wise_main_id", "distance_arcsec").withColumnsRenamed(
        {"gaia_alert_id": "alert_id", "wise_main_id": "main_id"}))


@query
def xmatch_coarse_filter(s: Survey) -> DataFrame:
    """Nearest infrared source of bright sources alone, far rows of the catalog dropped before they are copied."""
    bright = _moved(s).filter(F.col("phot_g_mean_mag") < 8.3).select("source_id", "ra_epoch", "dec_epoch")
    near = crossmatch_nearest(
        bright, s.wise.select("designation", "ra", "dec"), left_ra="ra_epoch", left_dec="dec_epoch",
        options=NearestOptions(coarse_filter=True))
    return rounded(near.select("gaia_source_id", "wise_designation", "distance_arcsec"))


@query
def xmatch_gain(s: Survey) -> DataFrame:
    keys = _moved(s).select("source_id", "ra_epoch", "dec_epoch")
    places = s.wise.select("designation", "ra", "dec")
    moved = crossmatch_nearest(keys, places, left_ra="ra_epoch", left_dec="dec_epoch")
    raw = xm.quick_match_raw(s.gaia, s.wise, FIELD).agg(_count("n")).scalar()
    return moved.agg(_count("n_pm")).select(raw.alias("n_raw"), "n_pm", (F.col("n_pm") - raw).alias("gain"))


@query
def threshold_sweep(s: Survey) -> DataFrame:
    """Match counts below 1, 2 and 5 arcsec from one join at the widest radius."""
    near = crossmatch_nearest(
        _moved(s).select("source_id", "ra_epoch", "dec_epoch"), s.wise.select("designation", "ra", "dec"),
        left_ra="ra_epoch", left_dec="dec_epoch", threshold_arcsec=5.0,
    )
    return near.agg(*[F.count_if(F.col("distance_arcsec") < float(t)).alias(f"within_{t}") for t in (1, 2, 5)])


@query
def bf_arcsec_posterior(s: Survey) -> DataFrame:
    matched = xm.quick_match(s.gaia, s.wise, FIELD)
    return rounded(matched.select("gaia_source_id", "wise_designation", "distance_arcsec", "bayes_factor_pos", "posterior_match"))


@query
def quick_run(s: Survey) -> DataFrame:
    gaia = s.gaia.select("source_id", "ra", "dec", "pmra", "pmdec", "bp_rp", "phot_g_mean_mag")
    out = xm.match_field(gaia, s.wise.select("designation", "ra", "dec"), s.simbad, FIELD)
    return rounded(out.select(
        "gaia_source_id", "wise_designation", "gaia_bp_rp", "gaia_phot_g_mean_mag", "distance_arcsec",
        "posterior_match", "known_in_simbad", "simbad_main_id", "simbad_type"))


@query
def quick_run_summary(s: Survey) -> DataFrame:
    gaia, wise = s.gaia.select("source_id", "ra", "dec", "pmra", "pmdec"), s.wise.select("designation", "ra", "dec")
    out = xm.match_field(gaia, wise, s.simbad, FIELD)
    return xm.quick_summary(s.gaia, s.wise, xm.quick_match_raw(s.gaia, s.wise, FIELD), out)


@query
def smoke_crossmatch(s: Survey) -> DataFrame:
    """A small cone, matched without epoch correction, with all rows looked up."""
    cone = (SMOKE_FIELD.ra, SMOKE_FIELD.dec, SMOKE_FIELD.radius)
    gaia = catalogs.scan_gaia_quick(s.gaia, cone, clean=False)
    wise = catalogs.scan_allwise(s.wise, cone)
    matched = cut_lineage(
        crossmatch_nearest(gaia.select("source_id", "ra", "dec"), wise.select("designation", "ra", "dec"))
    )
    return rounded(enrich.flag_known_objects(matched, s.simbad))


# Bayes factors, priors and posteriors


@query
def candidates_5as(s: Survey) -> DataFrame:
    return rounded(_pairs(s).select("gaia_source_id", "wise_designation", "psi_arcsec", "sigma_gaia", "sigma_wise"))


@query
def bf_radian_ln(s: Survey) -> DataFrame:
    return rounded(_pairs(s).select("gaia_source_id", "wise_designation", "ln_b"), 4)


@query
def edge_cost(s: Survey) -> DataFrame:
    kept = _scored(s).filter(F.col("posterior") > 0.01)
    return rounded(kept.select("gaia_source_id", "wise_designation", bayes.edge_cost(F.col("ln_b")).alias("cost")), 4)


@query
def prior_odds_density(s: Survey) -> DataFrame:
    odds = xm.prior_odds(_gaia(s), s.wise, s.area_sr())
    return odds.select("n_gaia", "n_wise", F.round(F.ln("prior_odds"), 6).alias("ln_prior_odds"))


@query
def solid_angle_density(s: Survey) -> DataFrame:
    area = s.area_sr()
    counts = _gaia(s).agg(_count("n_gaia")).withColumn("n_wise", s.wise.agg(_count("n")).scalar())
    per_arcmin = {c: sphere.density_per_sq_arcmin(F.col(f"n_{c}") / area) for c in ("gaia", "wise")}
    return rounded(counts.select(area.alias("area_sr"), *[v.alias(f"{c}_per_sq_arcmin") for c, v in per_arcmin.items()]))


@query
def posterior_density(s: Survey) -> DataFrame:
    return rounded(_scored(s).select("gaia_source_id", "wise_designation", "posterior"))


@query
def local_density_cells(s: Survey) -> DataFrame:
    """Sources of each cell and the density smoothed over its halo, per square arcmin."""
    cells = density.local_density(s.gaia.select("ra", "dec"))
    per_arcmin = sphere.density_per_sq_arcmin(F.col("density"))
    return rounded(cells.select("band", "place", "n", per_arcmin.alias("density")))


@query
def posterior_local(s: Survey) -> DataFrame:
    """Posterior with prior odds from the density around each pair instead of one over the whole area."""
    pairs = density.with_local_odds(_pairs(s), _gaia(s).select("ra", "dec"), s.wise.select("ra", "dec"))
    scored = pairs.withColumn("posterior", bayes.posterior_from_log(F.col("ln_b"), F.col("local_odds")))
    return rounded(scored.select("gaia_source_id", "wise_designation", F.ln("local_odds").alias("ln_odds"), "posterior"))


@query
def posterior_describe(s: Survey) -> DataFrame:
    scored = cut_lineage(_scored(s).select("posterior"))
    summary = ranked.describe(scored, "posterior", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return rounded(summary.withColumnsRenamed({"count": "n", "min": "smallest", "max": "largest"}))


# One-to-one matches


@query
def assign_one_to_one(s: Survey) -> DataFrame:
    chosen = one_to_one(_scored(s).filter(F.col("posterior") > 0.01))
    return rounded(chosen.select("gaia_source_id", "wise_designation", "psi_arcsec", "posterior"))


@query
def candidates_all_5as(s: Survey) -> DataFrame:
    """All candidate pairs below the prefilter radius, not the nearest alone, with their evidence."""
    pairs = xm.all_candidate_pairs(_gaia(s), xm.needed_columns(s.wise))
    return rounded(pairs.select("gaia_source_id", "wise_designation", "psi_arcsec", "ln_b"), ln_b=4)


@query
def assign_general(s: Survey) -> DataFrame:
    """The best one-to-one assignment where sources of both sides have several candidates."""
    pairs = xm.all_candidate_pairs(_gaia(s), xm.needed_columns(s.wise))
    scored = xm.score_pairs(pairs, xm.prior_odds(_gaia(s), s.wise, s.area_sr()))
    chosen = assign_components(scored.filter(F.col("posterior") > 0.01).select(
        "gaia_source_id", "wise_designation", "psi_arcsec", "ln_b", "posterior"))
    return rounded(chosen, ln_b=4)


@query
def pair_metrics_rejoin(s: Survey) -> DataFrame:
    """Chosen keys joined back to the metrics of their pair on the composite key."""
    keys = ["gaia_source_id", "wise_designation"]
    scored = cut_lineage(_scored(s).select(*keys, "psi_arcsec", "ln_b", "posterior"))
    chosen = one_to_one(scored.filter(F.col("posterior") > 0.01).select(*keys, "ln_b")).select(*keys)
    return rounded(chosen.join(scored, keys, "left"), ln_b=4)


@query
def match_confidence_counts(s: Survey) -> DataFrame:
    cuts = {"above_50": 0.5, "above_90": 0.9, "above_99": 0.99}
    return _matches(s).agg(_count("n_matches"), *[F.count_if(F.col("posterior") > v).alias(n) for n, v in cuts.items()])


@query
def distinct_keys(s: Survey) -> DataFrame:
    """Sorted distinct infrared sources among the candidates above the floor."""
    return _scored(s).filter(F.col("posterior") > 0.01).select("wise_designation").distinct().orderBy("wise_designation")


@query
def enrich_gather(s: Survey) -> DataFrame:
    kept = [f"gaia_{c}" for c in xm.GAIA_KEPT] + [f"wise_{c}" for c in xm.WISE_KEPT]
    return rounded(_matches(s).select(*kept))


@query
def color_index(s: Survey) -> DataFrame:
    return rounded(_matches(s).select("gaia_source_id", "w1_w2"))


@query
def cluster_members(s: Survey) -> DataFrame:
    return rounded(_matches(s).select("gaia_source_id", "gaia_parallax", "gaia_pmra", "gaia_pmdec", "cluster_member"))


@query
def clusters_best(s: Survey) -> DataFrame:
    """The nearest of all clusters in whose disc and boxes a source lies."""
    found = clusters.best_cluster(s.gaia, s.clusters)
    return rounded(found.select("source_id", "cluster", "cluster_distance", "n_clusters"))


@query
def clusters_all(s: Survey) -> DataFrame:
    """Every pair of a source and a cluster in whose disc and boxes it lies."""
    return rounded(clusters.join_clusters(s.gaia, s.clusters).select("source_id", "cluster", "cluster_distance"))


@query
def clusters_counts(s: Survey) -> DataFrame:
    return rounded(clusters.member_counts(s.gaia, s.clusters))


@query
def crossmatch_flagship(s: Survey) -> DataFrame:
    columns = [
        "gaia_source_id", "gaia_ra", "gaia_dec", "wise_designation", "psi_arcsec", "posterior", "w1_w2",
        "cluster_member", "known_in_simbad", "simbad_otype", "simbad_main_id", "tic_id", "tic_Tmag",
    ]
    found = ("simbad_otype", "simbad_main_id", "known_in_simbad", "tic_id", "tic_Tmag")
    matches = _landed_matches(s, *[c for c in columns if c not in found])
    return rounded(xm.enrich_matches(matches, catalogs.scan_tic(s.tic, clean=False), s.simbad).select(*columns))


# Enrichment


@query
def tic_left_join(s: Survey) -> DataFrame:
    return rounded(enrich.join_tic(_matches(s), catalogs.scan_tic(s.tic, clean=False)).select("gaia_source_id", "tic_id", "tic_Tmag"))


@query
def tic_join_dedupe(s: Survey) -> DataFrame:
    joined = enrich.join_tic(_matches(s), catalogs.scan_tic(s.tic, clean=False), dedupe=True)
    return rounded(joined.select("gaia_source_id", "tic_id", "tic_Tmag"))


@query
def tic_join_hot(s: Survey) -> DataFrame:
    """The join with a limit so small that every repeated identifier counts as hot."""
    joined = enrich.join_tic(_matches(s), catalogs.scan_tic(s.tic, clean=False), max_rows_per_key=1)
    return rounded(joined.select("gaia_source_id", "tic_id", "tic_Tmag"))


@query
def tic_match_rate(s: Survey) -> DataFrame:
    joined = enrich.join_tic(_matches(s), catalogs.scan_tic(s.tic, clean=False))
    return rounded(joined.agg(
        _count("n_rows"), F.count("tic_id").alias("n_tic"),
        F.try_divide(F.lit(100.0) * F.count("tic_id"), F.count(F.lit(1))).alias("tic_percent")))


@query
def simbad_enrich_nearest(s: Survey) -> DataFrame:
    found = enrich.enrich_known_objects(_landed_matches(s, *PLACED), s.simbad)
    return found.select("gaia_source_id", "known_in_simbad", "simbad_otype", "simbad_main_id")


@query
def simbad_lookup_limit(s: Survey) -> DataFrame:
    matched = cut_lineage(xm.quick_match_raw(s.gaia, s.wise, FIELD).select("gaia_source_id", "gaia_ra", "gaia_dec"))
    found = enrich.flag_known_objects(matched, s.simbad, limit=100)
    return found.select("gaia_source_id", "known_in_simbad", "simbad_main_id", "simbad_type")


@query
def simbad_lookup_all(s: Survey) -> DataFrame:
    matched = cut_lineage(xm.quick_match_raw(s.gaia, s.wise, FIELD).select("gaia_source_id", "gaia_ra", "gaia_dec"))
    found = enrich.flag_known_objects(matched, s.simbad)
    return found.select("gaia_source_id", "known_in_simbad", "simbad_main_id", "simbad_type")


@query
def simbad_type_counts(s: Survey) -> DataFrame:
    found = enrich.enrich_known_objects(_landed_matches(s, *PLACED), s.simbad).filter("known_in_simbad = 1")
    return found.groupBy("simbad_otype").agg(_count("n")).orderBy(F.col("n").desc(), "simbad_otype").limit(15)


@query
def quality_gate(s: Survey) -> DataFrame:
    return xm.with_features(_matches(s)).select("gaia_source_id", "quality", "valid_features")


@query
def abs_mag(s: Survey) -> DataFrame:
    magnitude = photometry.absolute_magnitude(F.col("phot_g_mean_mag"), F.col("parallax"))
    return rounded(s.gaia.select("source_id", magnitude.alias("m_g_approx")))


def _novel(s: Survey) -> DataFrame:
    """Scores of the enriched matches; what features are made of is not moved beyond them."""
    errors = ("wise_w1sigmpro", "wise_w2sigmpro")
    shown = (*PLACED, "gaia_phot_g_mean_mag", "gaia_bp_rp", "w1_w2", "gaia_parallax", "gaia_ruwe", "posterior")
    matches = xm.resolve_matches(_scored(s, (*shown, *errors)))
    featured = cut_lineage(xm.with_features(matches).select(*shown, "m_g_approx", "quality", "valid_features"))
    enriched = xm.enrich_matches(featured, catalogs.scan_tic(s.tic, clean=False), s.simbad)
    return xm.with_novelty(xm.with_anomaly(cut_lineage(enriched.drop("gaia_ra", "gaia_dec", "simbad_main_id", "tic_Tmag"))))


@query
def novelty_scores(s: Survey) -> DataFrame:
    return rounded(_novel(s).select("gaia_source_id", "tic_id", "anomaly_score", "novelty_score"))


@query
def novelty_topk(s: Survey) -> DataFrame:
    top = xm.top_candidates(_novel(s))
    return rounded(top.select(
        "gaia_source_id", "gaia_phot_g_mean_mag", "gaia_bp_rp", "w1_w2", "gaia_parallax", "gaia_ruwe",
        "posterior", "known_in_simbad", "simbad_otype", "anomaly_score", "novelty_score", "tic_id"))


@query
def first_candidate_with_tic(s: Survey) -> DataFrame:
    return rounded(xm.first_with_tic(xm.top_candidates(_novel(s))).select("gaia_source_id", "tic_id", "novelty_score"))


@query
def isolation_forest_score(s: Survey) -> DataFrame:
    features = ("gaia_source_id", "gaia_phot_g_mean_mag", "gaia_parallax", "gaia_bp_rp", "w1_w2", "wise_w1sigmpro", "wise_w2sigmpro")
    featured = xm.with_features(_landed_matches(s, *features))
    return rounded(xm.with_anomaly(featured).select("gaia_source_id", "valid_features", "anomaly_score"))


@query
def novelty_with_forest(s: Survey) -> DataFrame:
    """The top candidates' scores alone."""
    return rounded(xm.top_candidates(_novel(s)).select("gaia_source_id", "anomaly_score", "novelty_score", "tic_id"))


@query
def top_candidate_lightcurve(s: Survey) -> DataFrame:
    """Normalised light curve of the best candidate with an input-catalog entry, found once."""
    best = cut_lineage(xm.first_with_tic(xm.top_candidates(_novel(s))).select(F.col("tic_id").alias("target_id")))
    curve = catalogs.scan_lightcurve(s.lightcurve).join(F.broadcast(best), "target_id", "left_semi")  # one row
    return rounded(lightcurve.relative_flux(curve).select("target_id", "event_id", "flux"))


@query
def lightcurve_normalize(s: Survey) -> DataFrame:
    flux = lightcurve.relative_flux(catalogs.scan_lightcurve(s.lightcurve))
    return rounded(flux.select("target_id", "event_id", "flux"))


@query
def run_summary(s: Survey) -> DataFrame:
    pairs = cut_lineage(_pairs(s))
    scored = xm.score_pairs(pairs, xm.prior_odds(_gaia(s), s.wise, s.area_sr()))
    flagged = enrich.enrich_known_objects(cut_lineage(xm.resolve_matches(scored)), s.simbad)
    return xm.run_summary(_gaia(s), s.wise, pairs, flagged)


# Comparison with the member list


@query
def ref_match_1as(s: Survey) -> DataFrame:
    matched = members.match_members(_members(s), _landed_matches(s, *PLACED), how="inner")
    return rounded(matched.select("ordinal", "source_key", "separation_arcsec"))


@query
def ref_match_rate(s: Survey) -> DataFrame:
    matched = members.match_members(_members(s), _landed_matches(s, *PLACED))
    return rounded(validation.match_rate(cut_lineage(matched.select("source_key", "separation_arcsec"))))


@query
def ref_unmatched(s: Survey) -> DataFrame:
    listed = _members(s)
    matched = members.match_members(listed, _landed_matches(s, *PLACED), how="inner")
    return listed.join(matched.select("ordinal"), "ordinal", "left_anti").select("ordinal", "member_id")


@query
def ref_scatter_last(s: Survey) -> DataFrame:
    ours = _landed_matches(s, *PLACED)
    marked = members.mark_listed(ours, members.match_members(_members(s), ours, how="inner"))
    return rounded(marked.select("gaia_source_id", "in_list", "list_proba"))


@query
def ours_only_counts(s: Survey) -> DataFrame:
    ours = _landed_matches(s, *PLACED)
    hits = members.match_members(_members(s), ours, how="inner").select(F.col("source_key").alias("gaia_source_id"))
    hits = cut_lineage(hits.distinct())
    keys = ours.select("gaia_source_id")
    outside = keys.join(hits, "gaia_source_id", "left_anti").agg(_count("n")).scalar()
    return keys.join(hits, "gaia_source_id", "left_semi").agg(_count("in_list")).withColumn("only_ours", outside)


@query
def proba_cut_counts(s: Survey) -> DataFrame:
    return validation.probability_cuts(_members(s))


@query
def labels_confusion(s: Survey) -> DataFrame:
    return metrics.confusion_counts(_labelled(s))


@query
def prf_metrics(s: Survey) -> DataFrame:
    return rounded(metrics.headline_metrics(metrics.confusion_counts(_labelled(s))))


@query
def validation_summary(s: Survey) -> DataFrame:
    ours = _landed_matches(s, *COMPARED, "cluster_member")
    listed = cut_lineage(members.match_members(_members(s), ours).select("source_key"))
    labels = cut_lineage(validation.labelled_matches(ours, _members(s)).select("y_true", "y_pred", "membership_score"))
    return rounded(validation.validation_summary(labels, listed))


@query
def class_report(s: Survey) -> DataFrame:
    return rounded(metrics.class_report(metrics.confusion_counts(_labelled(s))))


@query
def error_categories(s: Survey) -> DataFrame:
    return _labelled(s).select("gaia_source_id", "y_true", "y_pred", "category")


@query
def ablation_grid(s: Survey) -> DataFrame:
    return rounded(metrics.ablation_grid(_labelled(s), digits=None))


@query
def ablation_rounded(s: Survey) -> DataFrame:
    return metrics.ablation_grid(_labelled(s))


@query
def ablation_best(s: Survey) -> DataFrame:
    return metrics.best_scenario(metrics.ablation_grid(_labelled(s)))


@query
def mahalanobis_score(s: Survey) -> DataFrame:
    return rounded(_labelled(s).select("gaia_source_id", "mahalanobis", "membership_score"))


@query
def roc_curve(s: Survey) -> DataFrame:
    return rounded(ranked.roc_curve(_landed_labels(s), "membership_score", "y_true"), threshold=9)


@query
def roc_curve_all_points(s: Survey) -> DataFrame:
    return rounded(ranked.roc_curve(_landed_labels(s), "membership_score", "y_true", drop_collinear=False), threshold=9)


@query
def roc_auc(s: Survey) -> DataFrame:
    return rounded(ranked.roc_auc(_landed_labels(s), "membership_score", "y_true"))


@query
def auc_band(s: Survey) -> DataFrame:
    auc = ranked.roc_auc(_landed_labels(s), "membership_score", "y_true")
    return auc.select(photometry.discrimination_band(F.col("roc_auc")).alias("band"))


@query
def pr_curve(s: Survey) -> DataFrame:
    return rounded(ranked.pr_curve(_landed_labels(s), "membership_score", "y_true"), threshold=9)


@query
def fp_fn_brightest5(s: Survey) -> DataFrame:
    return rounded(validation.brightest_errors(_landed_labels(s)))


@query
def fp_fn_summary(s: Survey) -> DataFrame:
    return rounded(validation.error_summary(_landed_labels(s)))


# Plot data


@query
def hist_separation_30(s: Survey) -> DataFrame:
    separations = cut_lineage(xm.quick_match_raw(s.gaia, s.wise, FIELD).select("distance_arcsec"))
    return rounded(hist.histogram(separations, "distance_arcsec"))


@query
def hist_member_list(s: Survey) -> DataFrame:
    return rounded(hist.histogram_columns(_members(s), ("proba", "g_mag", "parallax")))


@query
def hist_parallax_by_category(s: Survey) -> DataFrame:
    return rounded(hist.histogram_by(_landed_labels(s), "gaia_parallax", "category", ("TP", "FP", "FN")))


@query
def cmd_plot_data(s: Survey) -> DataFrame:
    return rounded(hist.color_magnitude(xm.quick_match(s.gaia, s.wise, FIELD)))


@query
def cmd_adaptive_bins(s: Survey) -> DataFrame:
    """The colour-magnitude diagram in a bounded number of bins, finer where sources crowd."""
    matched = xm.quick_match(s.gaia, s.wise, FIELD).select("gaia_bp_rp", "gaia_phot_g_mean_mag")
    return rounded(quadtree.adaptive_bins(cut_lineage(matched), "gaia_bp_rp", "gaia_phot_g_mean_mag"), 10)


@query
def cmd_adaptive_bins_all(s: Survey) -> DataFrame:
    """The same over the whole optical catalog."""
    return rounded(quadtree.adaptive_bins(s.gaia, "bp_rp", "phot_g_mean_mag"), 10)


@query
def cmd_member_panels(s: Survey) -> DataFrame:
    return rounded(_matches(s).select("gaia_source_id", "gaia_bp_rp", "w1_w2", "gaia_phot_g_mean_mag", "cluster_member"))


@query
def validation_panels(s: Survey) -> DataFrame:
    return rounded(_landed_labels(s).select(
        "gaia_source_id", "category", "gaia_bp_rp", "gaia_phot_g_mean_mag", "gaia_ra", "gaia_dec",
        "gaia_pmra", "gaia_pmdec", "gaia_parallax"))
