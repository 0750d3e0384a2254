from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from skyweft.operators import nearest
from skyweft.operators.nearest import NearestOptions, crossmatch_nearest
from skyweft.operators.skew import hot_keys, salted_join

SCHEMA_LEFT = "source_id long, ra double, dec double"
SCHEMA_RIGHT = "designation long, ra double, dec double"
CROWDED = NearestOptions(max_candidates=8, leaf_rows=6, max_left_rows=20, salt_left=True)
CROWDED_SHUFFLED = NearestOptions(max_candidates=8, leaf_rows=6, max_left_rows=20, max_broadcast_rows=0)


def separation(a, b):
    d1, d2, dl = math.radians(a[1]), math.radians(b[1]), math.radians(b[0] - a[0])
    across = math.hypot(
        math.cos(d2) * math.sin(dl), math.cos(d1) * math.sin(d2) - math.sin(d1) * math.cos(d2) * math.cos(dl)
    )
    return math.degrees(math.atan2(across, math.sin(d1) * math.sin(d2) + math.cos(d1) * math.cos(d2) * math.cos(dl))) * 3600


def brute_force(left, right, radius, how):
    expected = {}
    for key, *place in left:
        best = None
        if None not in place and not any(map(math.isnan, place)):
            for other, *there in right:
                if None in there or any(map(math.isnan, there)):
                    continue
                s = separation(place, there)
                if s < radius and (best is None or (s, other) < best):
                    best = (s, other)
        if best:
            expected[key] = best[1]
        elif how == "left":
            expected[key] = None
    return expected


def scattered(n, seed):
    """Mid-latitude field, both poles, the 0/360 seam, a tight clump, and a third of copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        place = [
            (119.5 + rng.random() * 0.02, -60.8 + rng.random() * 0.01),
            (rng.random() * 360, 90 - rng.random() * 0.005),
            ((rng.random() - 0.5) * 0.02 % 360, 10 + rng.random() * 0.01),
            (rng.random() * 360, -90 + rng.random() * 0.004),
            (50 + rng.gauss(0, 1) * 1e-4, 20 + rng.gauss(0, 1) * 1e-4),
            rng.choice([(50.0, 20.0), (50.0005, 20.0002)]),
            (50.0003, 20.0001),
        ][i % 7]
        rows.append((i, *place))
    return rows + [(n, None, 1.0), (n + 1, float("nan"), 2.0)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("options", [NearestOptions(), CROWDED, CROWDED_SHUFFLED], ids=["plain", "crowded", "shuffled"])
def test_equals_brute_force(spark, options, how):
    left, right = scattered(420, 1), scattered(560, 2)
    out = crossmatch_nearest(
        spark.createDataFrame(left, SCHEMA_LEFT), spark.createDataFrame(right, SCHEMA_RIGHT),
        threshold_arcsec=5.0, how=how, options=options,
    )
    rows = out.collect()
    got = {r.gaia_source_id: r.wise_designation for r in rows}
    assert len(rows) == len(got)
    assert got == brute_force(left, right, 5.0, how)


@pytest.mark.parametrize("block_rows, max_candidates, batch", [(8, 256, 10000), (30, 2, 7), (4096, 2, 7)])
def test_blocks_of_any_size_equal_brute_force(spark, block_rows, max_candidates, batch):
    left, right = scattered(420, 1), scattered(560, 2)
    options = NearestOptions(max_candidates=max_candidates, block_rows=block_rows, leaf_rows=6, max_left_rows=20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = crossmatch_nearest(
            spark.createDataFrame(left, SCHEMA_LEFT), spark.createDataFrame(right, SCHEMA_RIGHT),
            threshold_arcsec=5.0, how="left", options=options).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.gaia_source_id: r.wise_designation for r in rows}
    assert len(rows) == len(got)
    assert got == brute_force(left, right, 5.0, "left")


def test_crowded_cells_are_compared_without_writing_boxes(spark, monkeypatch):
    """Every cell here is crowded; neither points nor boxes of them are written, and each row comes once."""
    written = []
    plain = nearest.cut_lineage
    monkeypatch.setattr(nearest, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    left = spark.range(400).select(F.col("id").alias("source_id"), (F.col("id") % 20 / 5000).alias("ra"), (F.col("id") / 50000).alias("dec"))
    right = left.withColumnRenamed("source_id", "designation")
    found = crossmatch_nearest(left, right, threshold_arcsec=5.0, options=NearestOptions(max_candidates=1, leaf_rows=1, max_left_rows=2, salt_left=True))
    assert {(r.gaia_source_id, r.wise_designation) for r in found.collect()} == {(i, i) for i in range(400)}
    assert found.count() == 400
    assert all(set(columns) <= {*nearest.CELL, nearest.PARTS} for columns in written)


def test_threshold_is_strict_and_ties_take_the_smaller_key(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0)], SCHEMA_LEFT)
    right = spark.createDataFrame([(7, 10.0, 1 / 3600), (9, 20.0, 0.5 / 3600), (8, 20.0, -0.5 / 3600)], SCHEMA_RIGHT)
    apart = crossmatch_nearest(left, right, threshold_arcsec=1.5).orderBy("gaia_source_id").collect()
    assert [r.wise_designation for r in apart] == [7, 8]
    exact = apart[0].distance_arcsec
    assert crossmatch_nearest(left.limit(1), right, threshold_arcsec=exact).count() == 0


def test_columns_ride_along_and_empty_sides_keep_the_schema(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0, "a")], SCHEMA_LEFT + ", name string")
    right = spark.createDataFrame([(5, 10.0, 0.0, 3.5)], SCHEMA_RIGHT + ", w1 double")
    names = ["gaia_source_id", "gaia_ra", "gaia_dec", "gaia_name", "wise_designation", "wise_ra", "wise_dec", "wise_w1", "distance_arcsec"]
    full = crossmatch_nearest(left, right)
    assert full.columns == names and full.collect()[0]["wise_w1"] == 3.5
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left.limit(0), right.limit(0))):
        empty = crossmatch_nearest(a, b)
        assert empty.columns == names and empty.count() == 0
    outer = crossmatch_nearest(left, right.limit(0), how="left").collect()
    assert len(outer) == 1 and outer[0]["wise_designation"] is None
    with pytest.raises(ValueError):
        crossmatch_nearest(left, right, how="right")


def test_crowded_cell_without_left_rows_is_left_out(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0)], SCHEMA_LEFT)
    right = spark.createDataFrame([(i, 80.0, 1e-9 * i) for i in range(200)] + [(999, 10.0, 0.0)], SCHEMA_RIGHT)
    got = crossmatch_nearest(left, right, options=CROWDED).collect()
    assert [r.wise_designation for r in got] == [999]


def test_plan_is_an_equi_join(spark):
    left = spark.createDataFrame(scattered(50, 3), SCHEMA_LEFT)
    plan = plan_text(crossmatch_nearest(left, spark.createDataFrame(scattered(50, 4), SCHEMA_RIGHT)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "PythonUDF" not in plan


def test_salted_join_equals_plain_join(spark):
    many = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    one = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    many = many.withColumn("k", F.col("k").cast("int"))
    assert hot_keys(many, ["k"], 100).count() == 1
    for how in ("inner", "left"):
        plain = sorted(map(tuple, many.join(one, "k", how).select("row", "k", "v").collect()))
        salted = sorted(map(tuple, salted_join(many, one, ["k"], "row", how, 100).select("row", "k", "v").collect()))
        assert salted == plain
