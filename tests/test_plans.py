from __future__ import annotations

import math
import os
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import plan_text
from skyweft import cli
from skyweft.config import FieldConfig
from skyweft.functions.astrometry import propagate_position
from skyweft.plans import crossmatch, oracle, registry, report, runs
from skyweft.plans.survey import CLUSTER_NAMES, FIELD_CONE, Survey
from skyweft.session import cut_lineage, own_tables
from skyweft.sources import catalogs, sinks

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "scan_cone", "scan_members_cascade", "pm_shift_stats", "xmatch_nearest_pm", "quick_run", "posterior_describe",
    "crossmatch_flagship", "isolation_forest_score", "novelty_topk", "top_candidate_lightcurve", "lightcurve_normalize", "ref_scatter_last", "class_report",
    "ablation_rounded", "roc_curve", "fp_fn_summary", "hist_parallax_by_category", "xmatch_k_nearest_crowded", "xmatch_pairs_within",
    "assign_general", "xmatch_in_landed", "xmatch_incremental", "stream_alert_matches", "posterior_local", "clusters_best", "cmd_adaptive_bins",
)


@pytest.fixture(scope="module")
def check_engine():
    connection = duckdb.connect()
    for file in os.listdir(SMALL):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return connection


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else (value + 0.0 if isinstance(value, float) else value)


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in places) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_check_sql(spark, check_engine, name):
    df = entry.queries()[name](spark, SMALL)
    check = check_engine.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(check.columns)
    assert ordered(df.columns, df.collect()) == ordered(check.columns, check.fetchall())


def test_every_query_has_check_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_flagship_plan_has_no_nested_loops_or_python(spark):
    survey = Survey(spark, SMALL)
    plan = plan_text(crossmatch.probabilistic_matches(catalogs.scan_gaia(survey.gaia), survey.wise, survey.area_sr()))
    for unwanted in ("CartesianProduct", "NestedLoop", "Python"):
        assert unwanted not in plan
    assert "WindowGroupLimit" in plan


def test_forest_marks_top_candidates(spark):
    rows = registry.queries()["novelty_with_forest"](spark, SMALL).collect()
    assert len(rows) == 15
    assert all(0 <= r.novelty_score <= 4.3 for r in rows)


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, t string")
    again = cut_lineage(df)
    assert again.dtypes == df.dtypes and sorted(map(tuple, again.collect())) == [(1, None), (2, "x")]


def test_command_line(spark, tmp_path, capsys):
    survey = Survey(spark, SMALL)
    for name in ("gaia", "wise", "simbad"):
        sinks.write_parquet(survey.relation(name), f"{tmp_path}/{name}")
    ra, dec, radius = FIELD_CONE
    cli.main([
        "--ra", str(ra), "--dec", str(dec), "--radius", str(radius), "--out", f"{tmp_path}/out",
        "--plot-data", f"{tmp_path}/plots", *[a for n in ("gaia", "wise", "simbad") for a in (f"--{n}", f"{tmp_path}/{n}")],
    ])
    printed = capsys.readouterr().out
    written = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert f"Looked up in SIMBAD: {written.count()}" in printed
    assert {"gaia_source_id", "posterior_match", "known_in_simbad"} <= set(written.columns)
    assert f"Matches with proper motion: {written.count()}" in printed
    assert spark.read.option("header", True).csv(f"{tmp_path}/plots/separation_histogram").count() == 30


def test_pipeline_of_an_empty_field(spark):
    survey = Survey(spark, SMALL)
    field = FieldConfig(10.0, 10.0, 0.1)
    gaia = catalogs.scan_gaia_quick(survey.gaia, (10.0, 10.0, 0.1))
    out = crossmatch.match_field(gaia, survey.wise, survey.simbad, field)
    assert out.count() == 0 and "known_in_simbad" in out.columns
    pairs = crossmatch.candidate_pairs(catalogs.scan_gaia(survey.gaia, (10.0, 10.0, 0.1)), survey.wise)
    assert pairs.count() == 0


def test_report(spark):
    survey = Survey(spark, SMALL)
    matches = crossmatch.probabilistic_matches(catalogs.scan_gaia(survey.gaia), survey.wise, survey.area_sr())
    results = report.collect_results(matches, catalogs.standard_members(survey.members))
    text = report.render_report(results, FieldConfig(*FIELD_CONE), "NGC 2516", "derived list")
    c = results.confusion
    assert f"{c['tp']} (TP)" in text and "ROC-AUC" in text and text.count("parallax +-") >= 6
    assert f"{results.rate['n_matched']} of {results.rate['n_members']} listed members" in text


def test_full_run_and_validation(spark, tmp_path):
    survey = Survey(spark, SMALL)
    for name in ("gaia", "wise", "simbad", "tic"):
        sinks.write_parquet(survey.relation(name), f"{tmp_path}/{name}")
    # Every source gets a light curve, so the best candidate has one whoever it is.
    curves = survey.lightcurve.limit(3).select("time", "flux")
    wide = catalogs.scan_tic(survey.tic).select("ID").distinct().withColumnRenamed("ID", "target_id")
    sinks.write_parquet(wide.join(curves), f"{tmp_path}/curves")
    paths = runs.CatalogPaths(*[f"{tmp_path}/{n}" for n in ("gaia", "wise", "tic", "simbad", "curves")])
    field, out = FieldConfig(*FIELD_CONE), f"{tmp_path}/out"
    summary = runs.run_full_match(spark, paths, field, out)
    matches = spark.read.parquet(f"{out}/matches")
    assert matches.count() == summary["n_matches"] > 0
    assert spark.read.option("header", True).csv(f"{out}/top_candidates").count() == 15
    assert spark.read.option("header", True).csv(f"{out}/matches_csv").count() == summary["n_matches"]
    assert spark.read.option("header", True).csv(f"{out}/lightcurve").count() > 0
    results = runs.run_validation(
        spark, [f"{tmp_path}/nowhere", f"{out}/matches"], survey.members, CLUSTER_NAMES, field, out, "NGC 2516", "derived",
    )
    compared = sum(results.confusion.values())
    assert 0 < compared <= summary["n_matches"]
    text = next((tmp_path / "out" / "report").glob("*.txt")).read_text(encoding="utf-8")
    assert f"Sources compared: {compared}" in text
    assert spark.read.option("header", True).csv(f"{out}/ablation").count() == 8


def test_a_run_removes_its_tables(spark, tmp_path):
    seen = []

    @own_tables
    def run(session):
        table = cut_lineage(session.range(5))
        seen.append(table.inputFiles()[0].removeprefix("file://"))
        assert Path(seen[0]).exists()
        return table.count()

    assert run(spark) == 5
    assert not Path(seen[0]).parent.exists() and not Path(seen[0]).parent.parent.exists()


def test_generated_methods_are_short_enough_to_be_compiled(spark):
    """The JVM interprets methods of more than 8,000 bytes, which made these stages several times slower."""
    debug = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    s = Survey(spark, SMALL)
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        pairs = crossmatch.all_candidate_pairs(registry._gaia(s), crossmatch.needed_columns(s.wise))
        scored = crossmatch.score_pairs(pairs, crossmatch.prior_odds(registry._gaia(s), s.wise, s.area_sr()))
        body = F.struct("gaia_source_id", "wise_designation", "psi_arcsec", "ln_b", "posterior")
        best = scored.filter((F.col("posterior") > 0.01) & F.col("ln_b").isNotNull()).groupBy("gaia_source_id", "wise_designation").agg(F.max_by(body, "ln_b"))
        listed = propagate_position(registry._members(s), 2015.5, 2016.0).filter(F.col("ra_epoch") + F.col("dec_epoch") < 1e9)
        for df in (registry._matches(s), best, listed):
            code = debug.codegenString(df._jdf.queryExecution().executedPlan())
            assert max(int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
