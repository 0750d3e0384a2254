"""Ranked neighbours, all pairs and general assignments against brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from conftest import plan_text

from skyweft.operators.assign import assign_components, auction, cheapest_matching
from skyweft.operators.components import connected_components
from skyweft.operators.nearest import NearestOptions, crossmatch_k_nearest, pairs_within


def separation(a: tuple[float, float], b: tuple[float, float]) -> float:
    (r1, d1), (r2, d2) = (map(math.radians, x) for x in (a, b))
    dl = r2 - r1
    across = math.hypot(math.cos(d2) * math.sin(dl), math.cos(d1) * math.sin(d2) - math.sin(d1) * math.cos(d2) * math.cos(dl))
    return math.degrees(math.atan2(across, math.sin(d1) * math.sin(d2) + math.cos(d1) * math.cos(d2) * math.cos(dl))) * 3600


def sky(draw: random.Random, n: int, centre: tuple[float, float], spread: float) -> list[tuple[float, float]]:
    ra, dec = centre
    out = []
    for _ in range(n):
        d = max(-90.0, min(90.0, dec + draw.gauss(0, spread)))
        out.append(((ra + draw.gauss(0, spread) / max(0.02, math.cos(math.radians(d)))) % 360.0, d))
    return out


@pytest.fixture(scope="module")
def catalogs(spark):
    """A field, a crowded cluster with copies of places, the pole, the 0/360 seam, and rows without places."""
    draw = random.Random(5)
    right = sky(draw, 150, (120.0, -60.0), 0.004) + sky(draw, 200, (80.0, 20.0), 0.0004) + sky(draw, 40, (10.0, 89.9995), 0.001)
    right += sky(draw, 40, (0.0, 5.0), 0.002)
    right += [right[160]] * 6 + [right[170]] * 3
    left = [(r + draw.gauss(0, 2e-4), max(-90.0, min(90.0, d + draw.gauss(0, 2e-4)))) for r, d in right[::2]] + [right[160], right[170], right[160]]
    left = [(r % 360.0, d) for r, d in left]
    lefts = [(i, r, d) for i, (r, d) in enumerate(left)] + [(9001, None, 1.0), (9002, float("nan"), 1.0)]
    rights = [(f"w{i:04d}", r, d, i) for i, (r, d) in enumerate(right)] + [("w9001", None, 2.0, 0)]
    return (spark.createDataFrame(lefts, "source_id long, ra double, dec double"),
            spark.createDataFrame(rights, "designation string, ra double, dec double, rank long"), lefts[:-2], rights[:-1])


def ranked_by_hand(lefts, rights, k: int, radius: float) -> dict:
    out = {}
    for key, ra, dec in lefts:
        near = sorted((s, name) for name, r, d, _ in rights if (s := separation((ra, dec), (r, d))) < radius)
        out[key] = near[:k]
    return out


@pytest.mark.parametrize("k", [1, 2, 5])
@pytest.mark.parametrize("options", [
    NearestOptions(), NearestOptions(max_candidates=3, leaf_rows=2, salt_left=True, max_left_rows=10)])
def test_k_nearest_equals_brute_force(catalogs, k, options):
    left, right, lefts, rights = catalogs
    found = {}
    for r in crossmatch_k_nearest(left, right, k=k, threshold_arcsec=6.0, options=options).collect():
        found.setdefault(r.gaia_source_id, []).append((r["rank"], r.distance_arcsec, r.wise_designation))
    expected = {key: near for key, near in ranked_by_hand(lefts, rights, k, 6.0).items() if near}
    assert found.keys() == expected.keys()
    for key, near in expected.items():
        own = sorted(found[key])
        assert [n for n, _, _ in own] == list(range(1, len(near) + 1))
        assert np.allclose([s for _, s, _ in own], [s for s, _ in near], rtol=0, atol=1e-7)
        if len({round(s, 6) for s, _ in near}) == len(near):
            assert [name for _, _, name in own] == [name for _, name in near]


@pytest.mark.parametrize("k, block_rows, batch", [(1, 20, 5), (3, 20, 5), (3, 4096, 5)])
def test_k_nearest_in_blocks_of_any_size(catalogs, spark, k, batch, block_rows):
    left, right, _, _ = catalogs
    options = NearestOptions(max_candidates=3, block_rows=block_rows, leaf_rows=2, max_left_rows=10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = crossmatch_k_nearest(left, right, k=k, threshold_arcsec=6.0, options=options).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = crossmatch_k_nearest(left, right, k=k, threshold_arcsec=6.0, options=NearestOptions(block_rows=1000)).collect()
    plain = lambda found: sorted((r.gaia_source_id, r["rank"], r.wise_designation, r.distance_arcsec) for r in found)
    assert plain(rows) == plain(expected)


def test_k_nearest_keeps_rows_without_neighbours(catalogs):
    left, right, lefts, _ = catalogs
    found = crossmatch_k_nearest(left, right, k=3, threshold_arcsec=0.0001, how="left").collect()
    assert {r.gaia_source_id for r in found} == {key for key, _, _ in lefts} | {9001, 9002}
    assert all((r["rank"] is None) == (r.wise_designation is None) for r in found)
    with pytest.raises(ValueError):
        crossmatch_k_nearest(left, right, k=0)
    assert crossmatch_k_nearest(left.limit(0), right, k=2).count() == crossmatch_k_nearest(left, right.limit(0), k=2).count() == 0


@pytest.mark.parametrize("options", [NearestOptions(cell_factor=1.0), NearestOptions(cell_factor=3.0, salt_left=True, max_left_rows=20)])
def test_pairs_within_equal_brute_force(catalogs, options):
    left, right, lefts, rights = catalogs
    found = sorted((r.gaia_source_id, r.wise_designation) for r in pairs_within(left, right, radius_arcsec=4.0, options=options).collect())
    expected = sorted((key, name) for key, near in ranked_by_hand(lefts, rights, 10**6, 4.0).items() for _, name in near)
    assert found == expected and len(expected) > 2000


def test_pairs_within_is_an_equi_join(catalogs):
    left, right, *_ = catalogs
    plan = plan_text(pairs_within(left, right))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_components_of_chains_and_rings(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)]
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    draw = random.Random(2)
    mixed = [(f"x{draw.randint(0, 60):02d}", f"x{draw.randint(0, 60):02d}") for _ in range(45)]
    frame = spark.createDataFrame(chain + ring + mixed, "a string, b string")
    found = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    parent = {n: n for e in chain + ring + mixed for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in chain + ring + mixed:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert found == {n: root(n) for n in parent}


def matching_by_hand(edges: dict[tuple, float]) -> tuple[int, float]:
    """(size, cost) of the best matching, by trying all."""
    lefts = sorted({a for a, _ in edges})
    best = [(0, 0.0)]

    def go(i: int, used: frozenset, n: int, cost: float) -> None:
        if i == len(lefts):
            best[0] = min(best[0], (-n, cost))
            return
        go(i + 1, used, n, cost)
        for (a, b), c in edges.items():
            if a == lefts[i] and b not in used:
                go(i + 1, used | {b}, n + 1, cost + c)

    go(0, frozenset(), 0, 0.0)
    return -best[0][0], best[0][1]


def random_graph(draw: random.Random, n: int, m: int, edges: int) -> dict[tuple, float]:
    places = draw.sample([(a, b) for a in range(n) for b in range(m)], edges)
    return {p: round(draw.uniform(-30, 30), draw.choice([0, 3])) for p in places}


def test_cheapest_matching_equals_brute_force():
    draw = random.Random(7)
    for _ in range(400):
        n, m = draw.randint(1, 6), draw.randint(1, 6)
        graph = random_graph(draw, n, m, draw.randint(1, n * m))
        lists = [[(b, c) for (a, b), c in graph.items() if a == left] for left in range(n)]
        chosen = cheapest_matching(lists)
        picked = [(a, b) for a, b in enumerate(chosen) if b is not None]
        assert len({b for _, b in picked}) == len(picked) and all(p in graph for p in picked)
        size, cost = matching_by_hand(graph)
        assert len(picked) == size and abs(sum(graph[p] for p in picked) - cost) < 1e-6


def as_pairs(spark, graphs: list[dict[tuple, float]]):
    rows = [(1000 * i + a, f"{i}:{b}", -c, a + b) for i, graph in enumerate(graphs) for (a, b), c in graph.items()]
    return spark.createDataFrame(rows, "gaia_source_id long, wise_designation string, ln_b double, other long")


def totals(found, n: int) -> list[tuple[int, float]]:
    out = [[0, 0.0] for _ in range(n)]
    for r in found:
        out[r.gaia_source_id // 1000][0] += 1
        out[r.gaia_source_id // 1000][1] -= r.ln_b
    return [tuple(x) for x in out]


def test_assignment_equals_brute_force(spark):
    draw = random.Random(9)
    graphs = [random_graph(draw, n, m, draw.randint(1, n * m)) for n, m in (
        (draw.randint(1, 5), draw.randint(1, 5)) for _ in range(60))]
    graphs += [{(a, 0): float(a) for a in range(40)}, {(0, b): float(-b) for b in range(40)}]
    pairs = as_pairs(spark, graphs)
    found = assign_components(pairs.union(pairs.limit(5))).collect()
    assert len({r.gaia_source_id for r in found}) == len({r.wise_designation for r in found}) == len(found)
    for own, graph in zip(totals(found, len(graphs)), graphs, strict=True):
        size, cost = matching_by_hand(graph) if len(graph) <= 25 else (1, min(graph.values()))
        assert own[0] == size and abs(own[1] - cost) < 1e-6
    assert found[0].asDict().keys() == {"gaia_source_id", "wise_designation", "ln_b", "other"}
    assert assign_components(pairs.limit(0)).count() == 0


def test_auction_equals_brute_force(spark):
    """Components too large for a task, here all, are settled by bids."""
    draw = random.Random(3)
    graph = {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 1.5, (1, 1): 9.0, (2, 1): 2.5, (2, 2): 3.0, (3, 2): 0.25, (1, 3): 4.0}
    graph |= {(a + 10, b + 10): c for (a, b), c in random_graph(draw, 4, 4, 9).items()}
    rows = [(a, f"{b}", c) for (a, b), c in graph.items()]
    picked = [(r._left, int(r._right)) for r in auction(spark.createDataFrame(rows, "_left long, _right string, _cost double")).collect()]
    assert len({a for a, _ in picked}) == len({b for _, b in picked}) == len(picked)
    size, cost = matching_by_hand(graph)
    assert len(picked) == size and abs(sum(graph[p] for p in picked) - cost) < 1e-6


def test_large_components_go_to_the_auction(spark):
    graph = {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 1.5, (1, 1): 3.0}
    found = assign_components(as_pairs(spark, [graph]), max_edges=3).collect()
    assert totals(found, 1) == [(2, 3.5)]


def test_all_orders_of_insertion_give_one_total():
    graph = {(0, 0): 1.0, (0, 1): 5.0, (1, 0): 2.0, (2, 1): 1.0, (2, 2): 4.0}
    for order in itertools.permutations(range(3)):
        chosen = cheapest_matching([[(b, c) for (a, b), c in graph.items() if a == left] for left in order])
        assert sum(graph[order[i], b] for i, b in enumerate(chosen) if b is not None) == 11.0 and None not in chosen
