from __future__ import annotations

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from skyweft.config import Scenario
from skyweft.operators import enrich, histogram as hist, isolation, lightcurve, members, metrics, ranked
from skyweft.operators.assign import one_to_one
from skyweft.operators.topk import first_rows
from skyweft.plans import oracle


# One-to-one


def best_total(pairs):
    """Largest total evidence over all ways to use every source at most once, serving every right source."""
    by_right = {}
    for left, right, value in pairs:
        by_right.setdefault(right, []).append((left, value))
    best = None
    for choice in itertools.product(*by_right.values()):
        lefts = [c[0] for c in choice]
        if len(set(lefts)) == len(lefts):
            total = sum(c[1] for c in choice)
            best = total if best is None else max(best, total)
    return best


def test_assignment_is_one_to_one_and_optimal(spark):
    rng = random.Random(5)
    for _ in range(4):
        pairs = [(i, f"w{rng.randrange(5)}", round(rng.uniform(1, 30), 3)) for i in range(9)]
        df = spark.createDataFrame(pairs, "gaia_source_id long, wise_designation string, ln_b double")
        rows = one_to_one(df).collect()
        assert len({r.gaia_source_id for r in rows}) == len({r.wise_designation for r in rows}) == len(rows)
        assert sum(r.ln_b for r in rows) == pytest.approx(best_total(pairs))


def test_assignment_tie_and_group_limit(spark):
    df = spark.createDataFrame([(2, "w", 5.0), (1, "w", 5.0)], "gaia_source_id long, wise_designation string, ln_b double")
    chosen = one_to_one(df)
    assert [r.gaia_source_id for r in chosen.collect()] == [1]
    assert "WindowGroupLimit" in plan_text(chosen)


def test_first_rows_small_and_large(spark):
    df = spark.range(5000).select(((F.col("id") * 37) % 5000).alias("key"))
    for n in (20, 3000):
        assert [r.key for r in first_rows(df, "key", n).collect()] == list(range(n))


def test_known_object_flag_keeps_repeated_keys(spark):
    matches = spark.createDataFrame([(1, 10.0, 0.0), (1, 10.0, 0.0), (2, 20.0, 0.0)], "gaia_source_id long, gaia_ra double, gaia_dec double")
    simbad = spark.createDataFrame([("A", "Star", 10.0, 0.0)], "main_id string, otype string, ra double, dec double")
    for limit in (None, 1):
        rows = enrich.flag_known_objects(matches, simbad, limit=limit).collect()
        expected = [(1, 1), (1, 1), (2, 0 if limit is None else None)]
        assert sorted(((r.gaia_source_id, r.known_in_simbad) for r in rows), key=lambda x: x[0]) == expected


# Enrichment


def test_tic_join_fans_out_dedupes_and_splits_hot_keys(spark):
    matches = spark.createDataFrame([(1,), (2,), (5853000000000000001,)], "gaia_source_id long")
    rows = [("t2", 9.0, "1"), ("t1", 8.0, "1"), ("x", 7.0, None), ("t9", 6.0, "5853000000000000001")]
    rows += [(f"h{i}", 1.0, "2") for i in range(40)]
    tic = spark.createDataFrame(rows, "ID string, Tmag double, GAIA string")
    plain = sorted(map(tuple, enrich.join_tic(matches, tic).collect()), key=repr)
    split = sorted(map(tuple, enrich.join_tic(matches, tic, max_rows_per_key=10).collect()), key=repr)
    assert len(plain) == 43 and split == plain
    single = {r.gaia_source_id: r.tic_id for r in enrich.join_tic(matches, tic, dedupe=True).collect()}
    assert single == {1: "t1", 2: "h0", 5853000000000000001: "t9"}


def test_known_object_flag_has_three_values(spark):
    matches = spark.createDataFrame([(i, 10.0 + i, 0.0) for i in range(4)], "gaia_source_id long, gaia_ra double, gaia_dec double")
    simbad = spark.createDataFrame([(10.0, 1 / 3600, "A", "Star"), (13.0, 0.0, "B", "Star")], "ra double, dec double, main_id string, otype string")
    limited = {r.gaia_source_id: (r.known_in_simbad, r.simbad_main_id) for r in enrich.flag_known_objects(matches, simbad, limit=2).collect()}
    assert limited == {0: (1, "A"), 1: (0, None), 2: (None, None), 3: (None, None)}
    everyone = {r.gaia_source_id: r.known_in_simbad for r in enrich.flag_known_objects(matches, simbad, limit=None).collect()}
    assert everyone == {0: 1, 1: 0, 2: 0, 3: 1}
    enriched = {r.gaia_source_id: (r.known_in_simbad, r.simbad_otype) for r in enrich.enrich_known_objects(matches, simbad).collect()}
    assert enriched == {0: (1, "Star"), 1: (0, ""), 2: (0, ""), 3: (1, "Star")}


def test_last_listed_member_wins(spark):
    ours = spark.createDataFrame([(1, True), (2, False), (3, True)], "gaia_source_id long, cluster_member boolean")
    hits = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.2), (2, 5, 0.8), (None, 6, 0.7)], "source_key long, ordinal long, proba double")
    labelled = members.comparison_labels(members.mark_listed(ours, hits))
    assert {r.gaia_source_id: (r.list_proba, r.category) for r in labelled.collect()} == {1: (0.2, "FP"), 2: (0.8, "FN")}


# Order statistics


@pytest.mark.parametrize("bucket_rows", [500_000, 40])
def test_quantiles_equal_numpy(spark, bucket_rows):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=700), np.full(350, 0.25), rng.exponential(5, 300)])
    rows = [(float(v), "ab"[i % 3 == 0]) for i, v in enumerate(values)] + [(None, "a"), (float("nan"), "b")]
    df = spark.createDataFrame(rows, "v double, g string")
    wanted = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q999": 0.999, "q1": 1.0}
    got = ranked.exact_quantiles(df, "v", wanted, bucket_rows=bucket_rows).first().asDict()
    assert got == pytest.approx({n: np.quantile(values, p) for n, p in wanted.items()})
    for row in ranked.exact_quantiles(df, "v", {"m": 0.5}, by=["g"], bucket_rows=bucket_rows).collect():
        part = [v for v, g in rows if g == row["g"] and v is not None and not math.isnan(v)]
        assert row["m"] == pytest.approx(np.median(part))


def test_describe(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "v double")
    row = ranked.describe(df, "v", {"p90": 0.9}).first().asDict()
    assert row == pytest.approx({"count": 3, "mean": 13 / 3, "std": np.std([1, 2, 10], ddof=1), "min": 1.0, "p90": 8.4, "max": 10.0})


def scored_rows(n=300, seed=4):
    rng = random.Random(seed)
    return [(round(rng.random(), 2) if i % 3 else 0.5, int(rng.random() < 0.4)) for i in range(n)]


@pytest.mark.parametrize("bucket_rows", [500_000, 10])
def test_auc_equals_its_definition(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(ranked.cumulative, "__kwdefaults__", {**ranked.cumulative.__kwdefaults__, "bucket_rows": bucket_rows})
    rows = scored_rows()
    positive, negative = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    got = ranked.roc_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()[0]
    assert got == pytest.approx(wins / len(positive) / len(negative))


@pytest.mark.parametrize("bucket_rows", [500_000, 10])
def test_curves(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(ranked.cumulative, "__kwdefaults__", {**ranked.cumulative.__kwdefaults__, "bucket_rows": bucket_rows})
    rows = scored_rows()
    df = spark.createDataFrame(rows, "s double, y int")
    thresholds = sorted({s for s, _ in rows}, reverse=True)
    p = sum(y for _, y in rows)
    n = len(rows) - p
    points = []
    for t in thresholds:
        tp = sum(1 for s, y in rows if s >= t and y)
        points.append((t, tp, sum(1 for s, y in rows if s >= t) - tp))
    everything = {r.threshold: (r.fpr, r.tpr) for r in ranked.roc_curve(df, "s", "y", drop_collinear=False).collect()}
    assert everything == {None: (0.0, 0.0), **{t: pytest.approx((fp / n, tp / p)) for t, tp, fp in points}}
    kept = [0] + [
        i for i in range(1, len(points) - 1)
        if any(points[i + 1][j] - 2 * points[i][j] + points[i - 1][j] for j in (1, 2))
    ] + [len(points) - 1]
    reduced = {r.threshold for r in ranked.roc_curve(df, "s", "y").collect()}
    assert reduced == {None} | {points[i][0] for i in kept}
    pr = {r.threshold: (r.precision, r.recall) for r in ranked.pr_curve(df, "s", "y").collect()}
    assert pr == {None: (1.0, 0.0), **{t: pytest.approx((tp / (tp + fp), tp / p)) for t, tp, fp in points}}


def test_auc_of_one_class_is_null(spark):
    assert ranked.roc_auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first()[0] is None


def test_relative_flux(spark):
    rows = [("a", i, float(i + 1)) for i in range(5)] + [("a", 9, None), ("b", 0, 4.0), ("b", 1, float("nan")), ("c", 0, None)]
    df = spark.createDataFrame(rows, "target_id string, time int, flux double")
    got = {(r.target_id, r.time): r.flux for r in lightcurve.relative_flux(df).collect()}
    assert got == {("a", i): pytest.approx((i + 1) / 3.0) for i in range(5)} | {("b", 0): 1.0}


# Metrics


def test_published_confusion_reproduces_published_metrics(spark):
    confusion = spark.createDataFrame([(1, 42, 0, 252)], "tn long, fp long, fn long, tp long")
    row = metrics.headline_metrics(confusion).first()
    assert [round(v, 3) for v in row] == [0.857, 1.0, 0.923, 0.858]


def test_metrics_of_one_class_or_nothing(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1)], "y_true int, y_pred int")
    assert tuple(metrics.confusion_counts(labels).first()) == (0, 0, 0, 2)
    assert tuple(metrics.confusion_counts(labels.limit(0)).first()) == (0, 0, 0, 0)
    assert list(metrics.headline_metrics(metrics.confusion_counts(labels.limit(0))).first()) == [0.0] * 4


def test_class_report(spark):
    confusion = spark.createDataFrame([(3, 1, 2, 4)], "tn long, fp long, fn long, tp long")
    rows = {r.label: r for r in metrics.class_report(confusion).collect()}
    assert rows["non-member"].precision == pytest.approx(3 / 5) and rows["member"].recall == pytest.approx(4 / 6)
    assert rows["macro avg"].recall == pytest.approx((3 / 4 + 4 / 6) / 2)
    assert rows["weighted avg"].precision == pytest.approx((3 / 5 * 4 + 4 / 5 * 6) / 10)
    assert rows["weighted avg"].support == 10


def test_ablation_grid_and_best(spark):
    rows = [(2.4, -4.7, 11.2, 1), (2.05, -4.7, 11.2, 0), (2.4, None, None, 1), (3.5, -4.7, 11.2, 0)]
    df = spark.createDataFrame(rows, "gaia_parallax double, gaia_pmra double, gaia_pmdec double, y_true int")
    scenarios = [Scenario("wide", (2.0, 2.8)), Scenario("narrow", (2.2, 2.6)), Scenario("motion", None, 2.0), Scenario("again", (2.2, 2.6))]
    grid = metrics.ablation_grid(df, scenarios=scenarios)
    got = {r.criterion: (r.precision, r.recall, r.f1, r.n_pred) for r in grid.collect()}
    assert got["wide"] == (0.667, 1.0, 0.8, 3) and got["narrow"] == (1.0, 1.0, 1.0, 2) and got["motion"] == (0.333, 0.5, 0.4, 3)
    assert tuple(metrics.best_scenario(grid).first()) == ("narrow", 1.0)


# Plot data


@pytest.mark.parametrize("values", [[0.0, 0.1, 0.1, 2.9, 3.0, 3.0], [5.0, 5.0], list(np.random.default_rng(1).normal(size=200))])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    rows = hist.histogram(df, "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=30)
    assert [r.n for r in rows] == list(counts)
    assert [r.low for r in rows] + [rows[-1].high] == pytest.approx(list(edges))


def test_histogram_of_nothing_and_by_category(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (7.0, "b")], "v double, c string")
    assert hist.histogram(df.limit(0), "v").count() == 0
    by = hist.histogram_by(df, "v", "c", ["a", "b", "missing"], bins=4).groupBy("c").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    assert {r.c: (r.n, r.low) for r in by.collect()} == {"a": (2, 1.0), "b": (1, 6.5)}


# Isolation forest


def clump(spark, n=400):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(n)] + [(n, 9.0, 9.0, 9.0), (n + 1, -9.0, 9.0, -9.0)]
    return spark.createDataFrame(rows, "key long, a double, b double, c double").repartition(3)


def test_outliers_score_highest_and_runs_repeat(spark):
    df, features = clump(spark), ["a", "b", "c"]
    scores = []
    for _ in range(2):
        forest = isolation.fit_isolation_forest(df, features, "key", trees=60, seed=1)
        scored = isolation.score_isolation_forest(df.withColumn("ok", F.lit(True)), forest, features, "ok")
        scores.append({r.key: r.anomaly_score for r in scored.collect()})
    assert scores[0] == scores[1]
    assert set(sorted(scores[0], key=scores[0].get)[-2:]) == {400, 401}
    assert all(0.0 < s <= 1.0 for s in scores[0].values())
    assert np.median(list(scores[0].values())) < 0.5 < scores[0][400]


def test_scores_only_where_valid_and_none_without_rows(spark):
    df = clump(spark, 20).withColumn("ok", F.col("key") < 10)
    forest = isolation.fit_isolation_forest(df.filter("ok"), ["a", "b"], "key", trees=5)
    scored = {r.key: r.anomaly_score for r in isolation.score_isolation_forest(df, forest, ["a", "b"], "ok").collect()}
    assert all((s is not None) == (k < 10) for k, s in scored.items())
    assert isolation.fit_isolation_forest(df.limit(0), ["a"], "key") is None
    unscored = isolation.score_isolation_forest(df, None, ["a"], "ok")
    assert unscored.filter(F.col("anomaly_score").isNotNull()).count() == 0


def test_subsamples_have_the_wanted_size_without_repeats(spark):
    df = spark.range(5000).select(F.col("id").alias("key"), F.rand(1).alias("a"))
    drawn = isolation.draw_subsamples(df, 5000, ["a"], "key", 10, 32, 3)
    assert "WindowGroupLimit" in plan_text(drawn)
    rows = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("_key").alias("d")).collect()
    assert len(rows) == 10 and all(r.n == r.d == 32 for r in rows)
    assert drawn.select("_key").distinct().count() > 150


def test_thresholds_between_neighbouring_numbers_as_in_sql(spark):
    following = math.nextafter(1.0, 2.0)
    rows = [(str(i), 1.0 if i % 3 else following, 2.0, 3.0, True) for i in range(399)] + [("399", 5.0, 2.0, 3.0, True)]
    df = spark.createDataFrame(rows, "fkey string, bp_rp double, w1_w2 double, m_g double, quality boolean")
    features = ["bp_rp", "w1_w2", "m_g"]
    forest = isolation.fit_isolation_forest(df, features, "fkey")
    scored = {r.fkey: r.anomaly_score for r in isolation.score_isolation_forest(df, forest, features, "quality").collect()}
    values = ", ".join(f"('{key}', {x!r}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE, true)" for key, x, y, z, _ in rows)
    relations = {"own(fkey, bp_rp, w1_w2, m_g, quality)": f"VALUES {values}", **oracle._forest("f", "own")}
    text = "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in relations.items()) + " SELECT * FROM f_scores"
    expected = dict(duckdb.connect().execute(text).fetchall())
    assert scored == pytest.approx(expected, abs=1e-9)
    assert scored["399"] > scored["0"]


def test_average_path():
    assert [isolation.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert isolation.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_number_of_ranges_grows_with_the_data(spark):
    values = spark.range(3000).select(((F.col("id") * 7919) % 3000).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    got = ranked.exact_quantiles(values, "v", {"q": 0.25}, by=["g"], count_as="n", bucket_rows=10).orderBy("g").collect()
    expected = [np.quantile([(i * 7919) % 3000 for i in range(g, 3000, 2)], 0.25) for g in (0, 1)]
    assert [r.q for r in got] == pytest.approx(expected)
    assert [r.n for r in got] == [1500, 1500]
    running = ranked.cumulative(values, "v", {"n": F.count(F.lit(1))}, descending=True, bucket_rows=10).collect()
    assert all(r.n_upto == 3000 - r.v and r.n_total == 3000 for r in running)
