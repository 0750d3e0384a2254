from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from skyweft.plans.survey import Survey
from skyweft.sources import catalogs, schemas, sinks
from skyweft.sources.conform import conform, find_column, prefixed, select_present

SMALL = "/root/testdata/sf0.001"
CONE = (119.5, -60.83, 0.3)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    survey = Survey(spark, SMALL)
    for name in ("gaia", "wise", "simbad", "tic"):
        sinks.write_parquet(survey.relation(name), f"{folder}/{name}")
    return folder


def test_scans_push_filters_and_prune_columns(spark, landed):
    plan = plan_text(catalogs.scan_gaia(spark.read.parquet(f"{landed}/gaia"), CONE).select("source_id", "parallax"))
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    for wanted in ("GreaterThanOrEqual(dec", "LessThanOrEqual(dec", "GreaterThanOrEqual(ra", "LessThan(phot_g_mean_mag,19.0)", "IsNotNull(parallax)"):
        assert wanted in pushed
    read = plan[plan.index("ReadSchema"):].split(">")[0]
    assert "ruwe" not in read and "pmra" not in read


def test_quick_scan_limit_is_the_smallest_ids(spark, landed):
    gaia = spark.read.parquet(f"{landed}/gaia")
    limited = catalogs.scan_gaia_quick(gaia, CONE, 25)
    assert limited.columns == schemas.GAIA_QUICK.fieldNames()
    inside = sorted(r.source_id for r in catalogs.scan_gaia_quick(gaia, CONE, None).collect())
    assert sorted(r.source_id for r in limited.collect()) == inside[:25]


def test_full_scan_cuts_and_other_scans(spark, landed):
    rows = catalogs.scan_gaia(spark.read.parquet(f"{landed}/gaia"), max_g_mag=15.0)
    assert rows.filter("phot_g_mean_mag >= 15 or parallax is null").count() == 0
    wise = spark.read.parquet(f"{landed}/wise").withColumn("extra", F.lit(1)).drop("w4mpro")
    assert catalogs.scan_allwise(wise).columns == [c for c in schemas.ALLWISE.fieldNames() if c != "w4mpro"]
    assert "extra" in catalogs.scan_allwise(wise, keep_all=True).columns
    tic = catalogs.scan_tic(spark.read.parquet(f"{landed}/tic"))
    assert dict(tic.dtypes)["ID"] == "string"
    assert catalogs.scan_simbad(spark.read.parquet(f"{landed}/simbad"), CONE).columns == schemas.SIMBAD.fieldNames()


def test_conform_adds_casts_and_refuses_float_ids(spark):
    df = spark.createDataFrame([(1, float("nan"))], "ID long, ra double")
    row = conform(df, schemas.TIC).first()
    assert row["ID"] == "1" and row["ra"] is None and row["GAIA"] is None
    with pytest.raises(TypeError):
        conform(spark.createDataFrame([(5.853e18,)], "GAIA double"), schemas.TIC)


def test_column_lookup_and_prefix(spark):
    assert find_column(["x", "GaiaDR2"], schemas.MEMBER_ID_NAMES, True) == "GaiaDR2"
    assert find_column(["RA", "DE_ICRS"], schemas.MEMBER_RA_NAMES) is None
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert prefixed(df, "p_").columns == ["p_a", "p_b"]
    assert select_present(df, ["b", "c", "a"]).columns == ["b", "a"]


def test_member_list_names_cascade(spark):
    df = spark.createDataFrame(
        [("NGC_2516", 1, 119.5, -60.8), ("NGC2516", 2, 119.5, -60.8), ("other", 3, 119.5, -60.8), ("other", 4, 10.0, 10.0)],
        "Cluster string, Source long, RA_ICRS double, DE_ICRS double",
    )
    def ids(names, cone=CONE):
        return sorted(r.Source for r in catalogs.scan_members(df, names, cone).collect())
    assert ids(["NGC_2516", "NGC2516"]) == [1]
    assert ids(["absent", "NGC2516"]) == [2]
    assert ids(["absent", "missing"]) == [1, 2, 3]
    assert ids(["absent"], None) == []


def test_standard_members_under_other_names(spark):
    df = spark.createDataFrame([(7, 0.9, 1.0, 2.0, 3.0, 4.0)], "GaiaDR2 long, PMemb double, RAJ2000 double, DEJ2000 double, `pmRA*` double, pmDE double")
    row = catalogs.standard_members(df).first()
    assert (row.member_id, row.ordinal, row.proba, row.ra, row.pmra, row.parallax) == ("7", 7, 0.9, 1.0, 3.0, None)
    with pytest.raises(ValueError):
        catalogs.standard_members(df.drop("RAJ2000"))


def test_first_existing_path_and_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    sinks.write_parquet(df, f"{tmp_path}/second")
    found = catalogs.read_first_existing(spark, [f"{tmp_path}/first", f"{tmp_path}/second"])
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(FileNotFoundError):
        catalogs.read_first_existing(spark, [f"{tmp_path}/nowhere"])
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["k", "t"]
    sinks.write_small_csv(df, f"{tmp_path}/small")
    assert len(list((tmp_path / "small").glob("*.csv"))) == 1
    sinks.write_small_csv(spark.range(2000), f"{tmp_path}/large")
    assert spark.read.option("header", True).csv(f"{tmp_path}/large").count() == 2000
    sinks.write_text(spark, "# é\n\nline", f"{tmp_path}/text")
    assert next((tmp_path / "text").glob("*.txt")).read_text(encoding="utf-8") == "# é\n\nline\n"


def test_lightcurve_of_one_target(spark):
    curves = Survey(spark, SMALL).lightcurve
    one = catalogs.scan_lightcurve(curves, "1000003")
    assert 0 < one.count() < curves.count() and one.select("target_id").distinct().count() == 1
