"""How much of a block is verified, beside the recall."""

from __future__ import annotations

import numpy as np
import pytest

from skyweft.llm import nearest_vectors


def block_of(kind: str, rows: int = 4096) -> np.ndarray:
    draw = np.random.default_rng(7)
    matrix = draw.standard_normal((rows, 64))
    if kind != "random":
        matrix = draw.standard_normal((40, 64))[draw.integers(0, 40, rows)] + 0.8 * matrix
    matrix /= np.sqrt((matrix**2).sum(axis=1))[:, None]
    if kind == "log-normal":
        matrix *= draw.lognormal(0, 0.5, rows)[:, None]
    return matrix


@pytest.mark.parametrize("kind, most", [("clustered", 0.15), ("log-normal", 0.5), ("random", 1.0)])
def test_recall_and_verified_share(kind, most):
    matrix = block_of(kind)
    asked = matrix[::64]
    hits = verified = 0
    for q, rows in nearest_vectors.NormBands(matrix).candidates(asked, 20):
        assert len(set(rows.tolist())) == len(rows)
        best = np.argsort(-(matrix @ asked[q]), kind="stable")[:20]
        hits += len(set(best.tolist()) & set(rows.tolist()))
        verified += len(rows)
    recall, share = hits / (20 * len(asked)), verified / (len(matrix) * len(asked))
    print(f"{kind}: recall {recall:.3f}, verified share {share:.3f}")
    assert recall >= 0.9 and share <= most


def test_windows_hold_what_a_plain_count_finds():
    matrix = block_of("clustered", 700)
    index = nearest_vectors.ProjectionIndex(matrix, 1.0)
    rest = np.sqrt(np.maximum(1.0 - (matrix**2).sum(axis=1), 0.0))
    values = np.column_stack([matrix, rest]) @ index.directions
    for q in range(0, 700, 50):
        own = index.places_of(matrix[q])
        for reach in (0.0, 0.05, 0.4, 3.0, 1e9):
            plain = np.flatnonzero((np.abs(values - own) <= reach).sum(axis=1) >= index.least)
            assert abs(len(plain) - len(index.colliding(own, reach))) <= 1  # the query's own row at a window of nothing
            if reach:
                assert plain.tolist() == index.colliding(own, reach).tolist()
