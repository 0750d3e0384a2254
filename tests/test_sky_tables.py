"""Catalogs by sky cell, the coarse filter, many clusters, local density and adaptive bins, against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from conftest import plan_text
from pyspark.sql import functions as F
from test_assignment import ranked_by_hand, separation, sky

from skyweft.operators import clusters, density, nearest, quadtree
from skyweft.operators.nearest import NearestOptions, crossmatch_nearest
from skyweft.sources import skycells


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(11)
    places = sky(draw, 300, (10.0, 89.999), 0.01) + sky(draw, 300, (0.0, 3.0), 0.01) + sky(draw, 200, (200.0, -45.0), 5.0)
    left = [(i, r, d) for i, (r, d) in enumerate(places)] + [(5000, None, 3.0)]
    right = [(f"w{i:04d}", (r + draw.gauss(0, 3e-4)) % 360.0, max(-90.0, min(90.0, d + draw.gauss(0, 3e-4)))) for i, (r, d) in enumerate(places)]
    right += [("none", 1.0, None)]
    return (spark.createDataFrame(left, "source_id long, ra double, dec double"),
            spark.createDataFrame(right, "designation string, ra double, dec double"), left[:-1], [(*r, 0) for r in right[:-1]])


def test_cone_cells_hold_every_direction_of_the_cone(spark):
    draw = random.Random(1)
    for cone in ((10.0, 89.9, 1.0), (359.9, 0.0, 3.0), (120.0, -60.0, 0.3), (0.0, 0.0, 0.01), (77.0, -90.0, 20.0)):
        covered = set(skycells.cone_cells(cone))
        points = [p for p in sky(draw, 300, cone[:2], cone[2] / 2) if separation(p, cone[:2]) <= cone[2] * 3600]
        frame = skycells.with_cells(spark.createDataFrame(points, "ra double, dec double"))
        assert {r.sky_cell for r in frame.select("sky_cell").distinct().collect()} <= covered
        assert len(covered) < 60 and all(isinstance(c, int) for c in covered)


def test_cells_are_hierarchical(spark):
    points = sky(random.Random(2), 200, (180.0, 0.0), 60.0)
    frame = skycells.with_cells(spark.createDataFrame(points, "ra double, dec double"))
    up = skycells.parent_number(F.col("fine_cell"), skycells.FINE_LEVEL, skycells.COARSE_LEVEL)
    assert frame.filter(up != F.col("sky_cell")).count() == 0


def test_landed_table_is_pruned_and_stays_in_place(spark, tables):
    left, right, lefts, rights = tables
    landed = skycells.land_by_cell(left, buckets=4)
    cone = (0.0, 3.0, 0.02)
    scan = skycells.landed_cone(landed, cone)
    assert {r.source_id for r in scan.collect()} == {k for k, r, d in lefts if separation((r, d), cone[:2]) <= cone[2] * 3600}
    plan = plan_text(scan)
    assert "PartitionFilters: [" in plan and "sky_cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for found, exchanges in (
            (skycells.nearest_of_landed(landed, right, threshold_arcsec=3.0), 1),
            (skycells.nearest_in_landed(left, skycells.land_by_cell(right, buckets=4), threshold_arcsec=3.0), 2),
        ):
            # One exchange brings the other side's copies to the table's buckets; the second, of what is found, is by key.
            plan = plan_text(found)
            assert plan.count("Exchange hashpartitioning") == exchanges and "Bucketed: true" in plan
            expected = {k: n[0] for k, n in ranked_by_hand(lefts, rights, 1, 3.0).items() if n}
            rows = {r.gaia_source_id: r for r in found.collect()}
            assert rows.keys() == expected.keys()
            assert all(abs(rows[k].distance_arcsec - s) < 1e-7 and rows[k].wise_designation == name for k, (s, name) in expected.items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_landed_table_is_attached_again(spark, tables, tmp_path):
    left, *_ = tables
    skycells.land_by_cell(left, buckets=4, path=str(tmp_path / "t"), name="skyweft_once")
    again = skycells.attach_landed(
        spark, str(tmp_path / "t"), "skyweft_again", "source_id long, ra double, dec double, fine_cell long, sky_cell long", 4)
    assert sorted(again.select("source_id").collect()) == sorted(left.select("source_id").collect())


def test_coarse_filter_drops_far_rows_and_loses_none(spark, tables):
    left, right, *_ = tables
    few = left.filter("source_id BETWEEN 300 AND 309")
    reach = nearest._reach(3.0)
    placed = [nearest._with_geometry(t.filter(nearest._has_place("ra", "dec")), "ra", "dec", True) for t in (right, few)]
    kept = nearest.near_occupied(placed[0], placed[1], reach)
    assert 10 <= kept.count() <= 330 < placed[0].count()
    plan = plan_text(kept)
    assert "BroadcastHashJoin" in plan and plan.index("BroadcastHashJoin") >= 0 and "NestedLoop" not in plan
    for how in ("inner", "left"):
        plain, filtered = (
            sorted(map(repr, crossmatch_nearest(few, right, threshold_arcsec=3.0, how=how, options=o).collect()))
            for o in (NearestOptions(), NearestOptions(coarse_filter=True)))
        assert plain == filtered and len(plain) > 0


def test_clusters_equal_brute_force(spark):
    draw = random.Random(4)
    groups = [(f"c{i:02d}", *sky(draw, 1, (40.0, 89.0 if i % 3 else 10.0), 1.5)[0], draw.choice([0.3, 1.0, 2.5]), draw.uniform(1, 3),
               draw.uniform(0.5, 2), draw.uniform(-3, 3), 3.0, draw.uniform(-3, 3), 2.5) for i in range(24)]
    stars = [(i, *p, draw.choice([None, draw.uniform(0, 4)]) if i % 50 == 0 else draw.uniform(0, 4), draw.gauss(0, 3), draw.gauss(0, 3))
             for i, p in enumerate(sky(draw, 400, (40.0, 89.0), 1.5) + sky(draw, 300, (40.0, 10.0), 1.5))]
    table = spark.createDataFrame(groups, "name string, ra double, dec double, radius_deg double, parallax double, parallax_width double,"
                                          " pmra double, pmra_width double, pmdec double, pmdec_width double")
    sources = spark.createDataFrame(stars, "source_id long, ra double, dec double, parallax double, pmra double, pmdec double")
    expected = {}
    for key, ra, dec, *values in stars:
        near = []
        for name, cra, cdec, radius, *boxes in groups:
            off = [None if v is None else (v - c) / w for v, c, w in zip(values, boxes[::2], boxes[1::2], strict=True)]
            if None not in off and all(abs(o) < 1 for o in off) and separation((ra, dec), (cra, cdec)) < radius * 3600:
                near.append((math.sqrt(sum(o * o for o in off)), name))
        expected[key] = (min(near)[1] if near else None, len(near))
    found = {r.source_id: (r.cluster, r.n_clusters) for r in clusters.best_cluster(sources, table).collect()}
    assert found == expected and sum(n > 1 for _, n in expected.values()) > 10
    counted = {r.name: r.n_members for r in clusters.member_counts(sources, table).collect()}
    own = Counter(name for name, _ in expected.values() if name)
    assert counted == {g[0]: own[g[0]] for g in groups}
    assert clusters.best_cluster(sources, table.limit(0)).filter("n_clusters > 0").count() == 0
    plan = plan_text(clusters.join_clusters(sources, table))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_density_counts_each_source_over_its_halo(spark):
    draw = random.Random(8)
    points = sky(draw, 150, (0.0, 2.0), 0.6) + sky(draw, 60, (0.0, 89.6), 0.6) + [(0.0, 90.0), (359.9999, -90.0), (360.0, 1.0)]
    frame = spark.createDataFrame(points, "ra double, dec double")
    step = 0.5
    found = {(r.band, r.place): r for r in density.local_density(frame, step=step).collect()}

    def steps(b):
        low, high = b * step - 90, (b + 1) * step - 90
        return max(1, int(360 / step * (1 if low < 0 < high else math.cos(math.radians(min(abs(low), abs(high)))))))

    def area(b):
        return 2 * math.pi * (math.sin(math.radians((b + 1) * step - 90)) - math.sin(math.radians(b * step - 90))) / steps(b)

    own = Counter()
    for ra, dec in points:
        b = min(int((dec + 90) // step), 359)
        own[b, min(int(ra % 360 / 360 * steps(b)), steps(b) - 1)] += 1

    def touching(b, p):
        out = set()
        for b2 in range(max(0, b - 1), min(359, b + 1) + 1):
            n, m = steps(b), steps(b2)
            for q in range(m):
                # Closed arcs of a circle meet, in exact fractions.
                for turn in (-1, 0, 1):
                    if (p * m <= (q + 1 + turn * m) * n) and ((q + turn * m) * n <= (p + 1) * m):
                        out.add((b2, q))
        return out

    assert {c: r.n for c, r in found.items() if r.n} == dict(own)
    for cell in own:
        near = touching(*cell)
        expected = sum(own[c] for c in near) / sum(area(c[0]) for c in near)
        assert abs(found[cell].density / expected - 1) < 1e-9, cell
    whole = density.local_density(frame.limit(0))
    assert whole.count() == 0


def test_bins_add_up_and_are_bounded(spark):
    draw = random.Random(5)
    rows = [(draw.gauss(0, 1), draw.gauss(5, 2)) for _ in range(3000)] + [(0.25, 5.0)] * 2000 + [(None, 1.0), (float("nan"), 1.0), (1.0, None)]
    frame = spark.createDataFrame(rows, "x double, y double")
    found = quadtree.adaptive_bins(frame, "x", "y", depth=6, share=64).collect()
    assert sum(r.n for r in found) == 5000 and len(found) <= quadtree.most_bins(6, 64)
    assert all(r.n * 64 <= 5000 or r.level == 6 for r in found) and any(r.level == 6 for r in found)
    valid = rows[:5000]
    high_x, high_y = max(x for x, _ in valid), max(y for _, y in valid)
    for r in found:
        inside = sum(r.x_low <= x + 1e-12 and (x < r.x_high - 1e-12 or (x == high_x and r.x_high >= high_x - 1e-9))
                     and r.y_low <= y + 1e-12 and (y < r.y_high - 1e-12 or (y == high_y and r.y_high >= high_y - 1e-9)) for x, y in valid)
        assert inside == r.n
    areas = sum((r.x_high - r.x_low) * (r.y_high - r.y_low) for r in found)
    assert areas <= (high_x - min(x for x, _ in valid)) * (high_y - min(y for _, y in valid)) + 1e-6
    one = quadtree.adaptive_bins(spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double"), "x", "y").collect()
    assert [r.n for r in one] == [3] and quadtree.adaptive_bins(frame.limit(0), "x", "y").count() == 0
