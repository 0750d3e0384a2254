"""Complete runs that read landed catalogs and write every result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyweft.config import ClusterConfig, FieldConfig, MatchConfig
from skyweft.functions.sphere import cone_solid_angle
from skyweft.operators.lightcurve import relative_flux
from skyweft.plans import crossmatch, report
from skyweft.session import cut_lineage, own_tables
from skyweft.sources import catalogs, sinks


@dataclass(frozen=True)
class CatalogPaths:
    """Parquet locations of the landed catalogs; light curves are optional."""

    gaia: str
    wise: str
    tic: str
    simbad: str
    lightcurves: str | None = None


@own_tables
def run_full_match(
    spark: SparkSession,
    paths: CatalogPaths,
    field: FieldConfig,
    out: str,
    config: MatchConfig = MatchConfig(),
    cluster: ClusterConfig = ClusterConfig(),
) -> dict[str, int]:
    """Match one field with posteriors, enrich, score novelty and write all results.

    Writes ``matches`` (parquet), ``matches_csv``, ``top_candidates`` and, where
    the best candidate has one, its normalised ``lightcurve``. Returns the
    headline counts.
    """
    cone = (field.ra, field.dec, field.radius)
    gaia = catalogs.scan_gaia(spark.read.parquet(paths.gaia), cone, config.max_g_mag)
    wise = catalogs.scan_allwise(spark.read.parquet(paths.wise), cone, keep_all=True)
    tic = catalogs.scan_tic(spark.read.parquet(paths.tic), cone)
    simbad = catalogs.scan_simbad(spark.read.parquet(paths.simbad), cone)

    pairs = cut_lineage(crossmatch.candidate_pairs(gaia, crossmatch.needed_columns(wise), config))
    odds = crossmatch.prior_odds(gaia, wise, cone_solid_angle(field.radius), config)
    resolved = cut_lineage(crossmatch.resolve_matches(crossmatch.score_pairs(pairs, odds), config, cluster))
    featured = cut_lineage(crossmatch.with_features(crossmatch.enrich_matches(resolved, tic, simbad, config)))
    matches_path = f"{out}/matches"
    sinks.write_parquet(crossmatch.with_novelty(crossmatch.with_anomaly(featured)), matches_path)
    matches = spark.read.parquet(matches_path)
    sinks.write_csv(matches, f"{out}/matches_csv")

    candidates = crossmatch.top_candidates(matches, config.top_candidates)
    sinks.write_small_csv(candidates, f"{out}/top_candidates")
    best = crossmatch.first_with_tic(candidates).first()
    if best is not None and paths.lightcurves is not None:
        curve = catalogs.scan_lightcurve(spark.read.parquet(paths.lightcurves), best["tic_id"])
        sinks.write_csv(relative_flux(curve), f"{out}/lightcurve")

    return crossmatch.run_summary(gaia, wise, pairs, matches).first().asDict()


@own_tables
def run_validation(
    spark: SparkSession,
    match_paths: Sequence[str],
    members: DataFrame,
    cluster_names: Sequence[str],
    field: FieldConfig,
    out: str,
    field_name: str,
    list_name: str,
) -> report.ValidationResults:
    """Compare the first match table found with a member list; write report and ablation table."""
    # Input-catalog entries may repeat a source; it is compared once.
    matches = catalogs.read_first_existing(spark, match_paths).dropDuplicates(["gaia_source_id"])
    listed = catalogs.scan_members(members, cluster_names, (field.ra, field.dec, field.radius))
    results = report.collect_results(matches, catalogs.standard_members(listed))
    sinks.write_text(spark, report.render_report(results, field, field_name, list_name), f"{out}/report")
    table = spark.createDataFrame([tuple(r.values()) for r in results.ablation], list(results.ablation[0]))
    sinks.write_small_csv(table.orderBy(F.col("ordinal")).drop("ordinal"), f"{out}/ablation")
    return results
