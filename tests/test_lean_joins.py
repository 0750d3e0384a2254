from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pytest

from conftest import plan_text
from skyweft.operators import enrich, isolation, nearest
from skyweft.operators.nearest import AXES, NearestOptions, crossmatch_nearest
from skyweft.plans import crossmatch, registry
from skyweft.plans.survey import Survey

SMALL = "/root/testdata/sf0.001"


def _points(spark, n, name):
    places = "80 + (id * 7919 % 1009) * 3e-5 ra", "-45 + (id * 104729 % 1013) * 3e-5 dec"
    return spark.range(n).selectExpr(f"{name} AS name", *places)


def _placed(df):
    return nearest._with_geometry(df, "ra", "dec", True)


def test_copying_rows_to_cells_is_a_short_loop(spark):
    """The exact test on a cell's corners filled a method of more than 4,000 bytes, which the JVM compiled late."""
    debug = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$")
    points = _placed(_points(spark, 100, "id")).select("name", *AXES).localCheckpoint()
    code = debug.codegenString(nearest._touched_cells(points, 1e-4, 1e-5)._jdf.queryExecution().executedPlan())
    assert 0 < max(int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 2000


@pytest.mark.parametrize("enough", [0, 10**9])
def test_wider_cells_bound_what_cells_hold(spark, enough):
    points = _placed(_points(spark, 3000, "id"))
    reach = nearest._reach(3.0)
    for factor in (1.0, 4.0, 8.0):
        bound, total, tasks = nearest._bound_of_cells(points, factor * reach, reach, enough)
        most, _ = nearest._most_and_all(nearest._count_cells(nearest._touched_cells(points, factor * reach, reach)))
        assert most <= bound and total == 3000 and 1 <= tasks <= 4


@pytest.mark.parametrize("how", ["inner", "left"])
def test_wide_and_narrow_cells_give_the_same_rows(spark, how):
    left = _points(spark, 400, "id").selectExpr("name source_id", "ra + 1e-4 ra", "dec").union(spark.sql("SELECT -1L, NULL, 1D"))
    right = _points(spark, 300, "concat('W', id)").withColumnRenamed("name", "designation")
    found = [sorted(crossmatch_nearest(left, right, threshold_arcsec=2.0, how=how, options=NearestOptions(thin_factor=f)).collect(), key=str)
             for f in (4.0, 8.0, 30.0)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_many_rows_of_few_tasks_are_dealt_before_they_are_copied(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_PER_TASK", 100)
    left = _points(spark, 400, "id").withColumnRenamed("name", "source_id")
    right = _points(spark, 300, "concat('W', id)").withColumnRenamed("name", "designation").coalesce(1)
    near = crossmatch_nearest(left, right, threshold_arcsec=2.0)
    assert "RoundRobinPartitioning" in plan_text(near)
    assert near.filter("gaia_ra = wise_ra AND gaia_dec = wise_dec").count() == 300


def test_only_wanted_infrared_columns_are_moved(spark):
    wise = Survey(spark, SMALL).wise
    assert crossmatch.needed_columns(wise, registry.PLACED).columns == ["designation", "sigra", "sigdec", "ra", "dec"]
    assert {"w1mpro", "w2mpro"} <= set(crossmatch.needed_columns(wise, ["w1_w2"]).columns)
    landed = registry._landed_matches(Survey(spark, SMALL), *registry.PLACED)
    assert landed.columns == list(registry.PLACED) and landed.count() > 0


def test_entries_of_identifiers_are_counted_only_where_a_bucket_is_full(spark, monkeypatch):
    matches = spark.range(20).selectExpr("id AS gaia_source_id")
    tic = spark.range(60).selectExpr("id AS ID", "0.5D AS Tmag", "cast(id % 20 AS string) AS GAIA")
    many = enrich.join_tic(matches, tic, max_rows_per_key=1).collect()
    monkeypatch.setattr(enrich, "cut_lineage", lambda df: pytest.fail("counted each identifier"))
    assert sorted(enrich.join_tic(matches, tic).collect()) == sorted(many) and len(many) == 60


def test_rows_are_offered_to_trees_without_functions_over_arrays(spark):
    df = spark.range(500).selectExpr("id AS k", "id * 1.5D AS x")
    drawn = isolation.draw_subsamples(df, 500, ["x"], "k", 5, 16, 42)
    assert "lambda" not in plan_text(drawn)
    assert [r["count"] for r in drawn.groupBy("tree").count().collect()] == [16] * 5


def test_path_lengths_follow_the_trees(spark):
    rng = np.random.default_rng(3)
    frames = [isolation._grow(_frame(rng, t), ["a", "b"], 42) for t in range(6)]
    shape = (6, max(len(f) for f in frames))
    arrays = {n: np.zeros(shape, dtype=k) for n, k in
              {"feature": np.int16, "threshold": float, "low": np.int32, "high": np.int32, "path": float}.items()}
    for t, frame in enumerate(frames):
        for name, array in arrays.items():
            array[t, frame["node"].to_numpy()] = frame[name].to_numpy()
    forest = isolation.Forest(**arrays, samples=64, depth=isolation.depth_limit(64))
    data = np.asfortranarray(rng.normal(size=(200, 2)))

    def walk(row, t):
        node = 0
        while forest.feature[t, node] >= 0:
            node = forest.low[t, node] if row[forest.feature[t, node]] <= forest.threshold[t, node] else forest.high[t, node]
        return forest.path[t, node]

    expected = [sum(walk(row, t) for t in range(6)) / 6 for row in data]
    assert all(math.isclose(a, b, rel_tol=1e-15) for a, b in zip(isolation.path_lengths(forest, data), expected, strict=True))


def _frame(rng, tree):
    return pd.DataFrame({"a": rng.normal(size=64), "b": rng.normal(size=64), "tree": tree, "_draw": rng.random(64)})
