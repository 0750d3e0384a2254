from __future__ import annotations

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import plan_text
from skyweft.config import ClusterConfig, Scenario
from skyweft.functions import astrometry, bayes, nulls, once, photometry, sphere


def evaluate(spark, schema, rows, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_separation_known_values(spark):
    rows = [(0.0, 0.0, 0.0, 1.0), (10.0, 90.0, 200.0, 89.0), (359.9999, 0.0, 0.0001, 0.0), (0.0, 0.0, 180.0, 0.0)]
    sep = sphere.separation_arcsec(*[F.col(c) for c in "abcd"])
    got = [r["s"] for r in evaluate(spark, "a double, b double, c double, d double", rows, s=sep)]
    assert got == pytest.approx([3600.0, 3600.0, 0.72, 180 * 3600.0], rel=1e-9)


def test_cone_solid_angle_and_density(spark):
    assert sphere.cone_solid_angle(180.0) == pytest.approx(4 * math.pi)
    area = (math.degrees(1.0) * 60) ** 2
    assert evaluate(spark, "d double", [(area,)], v=sphere.density_per_sq_arcmin(F.col("d")))[0]["v"] == pytest.approx(1.0)


@pytest.mark.parametrize("cone", [(119.5, -60.83, 0.3), (0.05, 10.0, 0.2), (40.0, 89.9, 0.5), (100.0, -89.95, 0.3)])
def test_cone_bounds_lose_nothing(spark, cone):
    ra0, dec0, radius = cone
    points = [((ra0 + i * 7.7) % 360, max(-90.0, min(90.0, dec0 + (j - 20) * radius / 15))) for i in range(47) for j in range(41)]
    points += [((ra0 + (i - 30) * radius / 10) % 360, max(-90.0, min(90.0, dec0 + (j - 20) * radius / 15))) for i in range(61) for j in range(41)]
    exact = sphere.separation_arcsec(F.col("ra"), F.col("dec"), F.lit(ra0), F.lit(dec0)) <= radius * 3600
    got = evaluate(spark, "ra double, dec double", points, a=sphere.within_cone(F.col("ra"), F.col("dec"), *cone), b=exact)
    assert all(r["a"] == r["b"] for r in got) and any(r["b"] for r in got)


def test_propagation_fills_missing_motion_and_guards_pole(spark):
    df = spark.createDataFrame(
        [(10.0, 60.0, 3600.0, -3600.0), (10.0, 60.0, None, None), (10.0, 90.0, 5.0, 5.0)],
        "ra double, dec double, pmra double, pmdec double",
    )
    rows = astrometry.propagate_position(df, 2016.0, 2010.5).collect()
    assert rows[0]["ra_epoch"] == pytest.approx(10.0 - 5.5e-3 / math.cos(math.radians(60)))
    assert rows[0]["dec_epoch"] == pytest.approx(60.0 + 5.5e-3)
    assert (rows[1]["ra_epoch"], rows[1]["dec_epoch"]) == (10.0, 60.0)
    # cos(90 deg) is 6e-17 in floating point, so the guard applies
    assert rows[2]["ra_epoch"] is None and rows[2]["dec_epoch"] is not None


def test_propagation_there_and_back_keeps_declination(spark):
    df = spark.createDataFrame([(1.0, d, 500.0, 900.0) for d in (-80.0, 0.0, 45.5)], "ra double, dec double, pmra double, pmdec double")
    there = astrometry.propagate_position(df, 2016.0, 2000.0, out_ra="r", out_dec="d")
    back = astrometry.propagate_position(there, 2000.0, 2016.0, ra="r", dec="d", out_ra="r2", out_dec="d2")
    for r in back.collect():
        assert r["d2"] == pytest.approx(r["dec"], abs=1e-12)


def test_shift_and_its_compat_form(spark):
    cols = dict(
        plain=astrometry.proper_motion_shift(F.col("a"), F.col("b"), -5.5),
        compat=astrometry.proper_motion_shift(F.col("a"), F.col("b"), -5.5, dec=F.col("d"), compat=True),
    )
    row = evaluate(spark, "a double, b double, d double", [(300.0, 400.0, 60.0)], **cols)[0]
    assert row["plain"] == pytest.approx(2.75)
    assert row["compat"] == pytest.approx(math.hypot(150.0, 400.0) * 5.5 / 1000)


def test_sigmas_fill_and_clip(spark):
    rows = [(None, None), (0.0, 0.0), (1e9, 1e9), (3.0, 4.0)]
    got = evaluate(
        spark, "a double, b double", rows,
        g=astrometry.gaia_radial_sigma(F.col("a"), F.col("b")), w=astrometry.wise_radial_sigma(F.col("a"), F.col("b")),
    )
    assert [r["g"] for r in got] == pytest.approx([0.001, 0.001, 1.0, 0.005 / math.sqrt(2)])
    assert [r["w"] for r in got] == pytest.approx([0.5, 0.05, 2.0, 2.0])


def test_bayes_factor_falls_with_distance_and_posterior_is_open(spark):
    rows = [(i / 10,) for i in range(1, 40)]
    got = evaluate(spark, "s double", rows, b=bayes.bayes_factor_arcsec(F.col("s")), l=bayes.log_bayes_factor(F.col("s"), 0.1, 0.5))
    for name in ("b", "l"):
        values = [r[name] for r in got]
        assert values == sorted(values, reverse=True)
    posterior = evaluate(spark, "b double", [(1.0,), (10.0,), (100.0,)], p=bayes.posterior_probability(F.col("b")))
    assert [r["p"] for r in posterior] == pytest.approx([0.5, 10 / 11, 100 / 101])


def test_log_form_equals_direct_form_and_never_underflows(spark):
    arcsec = math.pi / 648000
    row, far = evaluate(spark, "s double", [(0.4,), (5000.0,)], l=bayes.log_bayes_factor(F.col("s"), 0.02, 0.2))
    variance = (0.02**2 + 0.2**2) * arcsec**2
    assert row["l"] == pytest.approx(math.log(2 / variance * math.exp(-((0.4 * arcsec) ** 2) / (2 * variance))))
    assert math.isfinite(far["l"])


def test_non_positive_variance_and_invalid_prior(spark):
    got = evaluate(spark, "s double", [(1.0,)], b=bayes.bayes_factor_arcsec(F.col("s"), 0.0, 0.0), l=bayes.log_bayes_factor(F.col("s"), 0.0, 0.0))
    assert got == [{"b": None, "l": None}]
    for prior in (0.0, 1.0, -1.0):
        with pytest.raises(ValueError):
            bayes.posterior_probability(F.col("b"), prior)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-2000, 100), min_size=20, max_size=40), st.floats(1e-12, 1e6))
def test_posterior_from_log_stays_in_unit_interval(spark, logs, odds):
    got = evaluate(spark, "l double", [(v,) for v in logs], p=bayes.posterior_from_log(F.col("l"), F.lit(odds)))
    assert all(0.0 <= r["p"] <= 1.0 for r in got)


def test_density_prior_odds(spark):
    odds = bayes.density_prior_odds(F.col("a"), F.col("b"), 2e-4, 0.7)
    got = evaluate(spark, "a long, b long", [(1000, 400), (0, 5)], o=odds)
    assert got[0]["o"] == pytest.approx(0.7 * 400 * 2e-4 / (1000 * 400)) and got[1]["o"] is None


def test_membership_is_strict_and_null_safe(spark):
    member = photometry.cluster_member(F.col("p"), F.col("a"), F.col("d"))
    rows = [(2.4, -4.7, 11.2), (2.0, -4.7, 11.2), (2.8, -4.7, 11.2), (2.4, -2.7, 11.2), (None, -4.7, 11.2), (2.4, None, None)]
    assert [r["m"] for r in evaluate(spark, "p double, a double, d double", rows, m=member)] == [True] + [False] * 5


def test_criterion_skips_absent_clauses(spark):
    everything = photometry.membership_criterion(F.col("p"), F.col("a"), F.col("d"), Scenario("all"))
    no_motion = photometry.membership_criterion(F.col("p"), F.col("a"), F.col("d"), Scenario("p", (2.0, 2.8)))
    got = evaluate(spark, "p double, a double, d double", [(2.4, None, None), (None, 0.0, 0.0)], e=everything, n=no_motion)
    assert got == [{"e": True, "n": True}, {"e": True, "n": False}]


def test_magnitude_quality_and_features(spark):
    rows = [(10.0, 10.0, 0.1, 0.1), (10.0, 0.01, None, 0.1), (18.0, None, 0.1, 0.1)]
    quality = photometry.photometric_quality(F.col("s1"), F.col("s2"), F.col("g"))
    magnitude = photometry.absolute_magnitude(F.col("g"), F.col("p"))
    got = evaluate(spark, "g double, p double, s1 double, s2 double", rows, q=quality, m=magnitude)
    assert [r["q"] for r in got] == [True, False, False]
    assert got[0]["m"] == pytest.approx(5.0) and got[1]["m"] == pytest.approx(10 + 5 * math.log10(1e-4) + 5) and got[2]["m"] is None
    values = [(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)]
    valid = photometry.valid_features(F.lit(True), F.col("v"))
    assert [r["v"] for r in evaluate(spark, "v double", values, v=valid)] == [True, False, False, False, False]


def test_novelty_terms(spark):
    score = photometry.novelty_score(F.col("q"), F.col("k"), F.col("p"), F.col("a"), F.col("r"))
    rows = [(True, 0, 0.96, 0.7, 1.0), (False, 1, 0.95, None, None), (True, 1, 0.5, 0.6, 1.4), (False, 0, None, 0.61, 1.39)]
    got = [r["s"] for r in evaluate(spark, "q boolean, k int, p double, a double, r double", rows, s=score)]
    assert got == pytest.approx([4.3, 0.0, 1.0, 2.8])


def test_mahalanobis_and_band(spark):
    distance = photometry.mahalanobis_distance(F.col("p"), F.col("a"), F.col("d"), ClusterConfig())
    got = evaluate(spark, "p double, a double, d double", [(2.6, -3.7, 12.2), (2.4, None, 11.2)], m=distance, s=photometry.membership_score(distance))
    assert got[0]["m"] == pytest.approx(math.sqrt(3)) and got[0]["s"] == pytest.approx(math.exp(-1.5)) and got[1]["m"] is None
    bands = evaluate(spark, "v double", [(0.96,), (0.95,), (0.8,), (0.7,)], b=photometry.discrimination_band(F.col("v")))
    assert [r["b"] for r in bands] == ["excellent", "good", "moderate", "low"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "x", 1), (1.0, None, 2)], "v double, t string, n int")
    assert [tuple(r) for r in nulls.nan_to_null(df).collect()] == [(None, "x", 1), (1.0, None, 2)]
    clipped = evaluate(spark, "v double", [(None,), (5.0,), (-5.0,)], c=nulls.clip(F.col("v"), -1, 1))
    assert [r["c"] for r in clipped] == [None, 1.0, -1.0]


def test_columns_computed_once_stay_below_filters(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (4.0, "c")], "x double, name string")
    out = once.with_columns_once(df, {"x": F.sqrt("x"), "y": F.exp("x")})
    assert out.columns == ["x", "name", "y"]
    kept = out.filter((F.col("y") > 3.0) & (F.col("y") < 100.0))
    assert [(r["x"], r["name"]) for r in kept.collect()] == [(2.0, "c")]
    assert {r["name"]: r["y"] for r in out.collect()}["b"] is None
    assert plan_text(kept).count("EXP(") == 1
