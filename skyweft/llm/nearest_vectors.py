"""Approximate nearest neighbours by collision-counting hashing.

A block's vectors fall into bands of similar norm. In a band, largest inner product
becomes least distance: every vector gets one more component that brings it to the
band's largest norm, queries get 0 there and are scaled to that norm. Each of
``PROJECTIONS`` random directions is one hash function; its values are kept as a sorted
array. A query opens windows around its own value in all arrays and counts how
often a vector falls into them; vectors that collide in at least ``COLLISIONS`` of all
directions are verified with their true inner product. Windows widen by ``WIDER`` in
each round (virtual rehashing) until as many as wanted are found, then to ``REACH`` times
the distance that the query's current last wanted score means in the band, whatever
share of the band has been verified by then. A band whose largest norm cannot give that
score is not opened.

Vectors and queries are dealt to blocks by hash; each pair of blocks is one task
of bounded size, and the best of every query's blocks are merged. Equal vectors of
a block are searched once: only the smallest ids can be among the nearest.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those of another length than most have, or rows
with a null id. A query does not find its own id. Fewer candidates than asked for
are all returned; equal scores go to the smaller id; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyweft.llm.common import land, prepare, spread

NEAREST = 20
PROJECTIONS = 64
#: Share of the directions in which a vector has to collide.
COLLISIONS = 0.75
WIDER = 1.1
#: First window, as a share of the spread of the projected values.
FIRST_WINDOW = 0.1
#: Windows of so many distances: a vector nearer than that collides often enough in 98 of 100 draws.
REACH = 1.4
#: Ratio of the largest to the smallest norm of a band.
BAND = 1.2
#: Bands of at most so many vectors are verified whole.
WHOLE_ROWS = 64
#: Rows that tell where the first window opens.
TRIAL_ROWS = 512
VECTOR_ROWS, QUERY_ROWS = 8192, 2048
SEED = 20


class ProjectionIndex:
    """Sorted projections of a band's vectors, and each vector's place in every sorted array."""

    def __init__(self, vectors: np.ndarray, largest_norm: float):
        chance = np.random.default_rng(SEED)
        self.directions = chance.standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        self.norm, self.rows = largest_norm, len(vectors)
        rest = np.sqrt(np.maximum(largest_norm**2 - (vectors**2).sum(axis=1), 0.0))
        values = np.column_stack([vectors, rest]) @ self.directions
        order = np.argsort(values, axis=0, kind="stable")
        # The sorted arrays one after the other, each moved past the one before, so that one search serves all.
        self.limit = 1.0 + float(np.abs(values).max())
        self.starts = np.arange(PROJECTIONS)
        self.sorted = (np.take_along_axis(values, order, axis=0).T + 4.0 * self.limit * self.starts[:, None]).ravel()
        self.kind = np.uint16 if self.rows < 1 << 16 else np.uint32
        self.place = np.empty((PROJECTIONS, self.rows), self.kind)
        np.put_along_axis(self.place, order.T, np.arange(self.rows, dtype=self.kind)[None, :], axis=1)
        self.trial = values[chance.permutation(self.rows)[:TRIAL_ROWS]]
        self.least_window = FIRST_WINDOW * float(values.std(axis=0).mean()) or 1.0
        self.least = int(np.ceil(COLLISIONS * PROJECTIONS))

    def places_of(self, unit_query: np.ndarray) -> np.ndarray:
        """The query's value in every direction, once scaled to the band's norm."""
        return (unit_query * self.norm) @ self.directions[:-1]

    def first_window(self, values: np.ndarray, wanted: int) -> float:
        """The window in which about ``wanted`` rows collide, as the trial rows tell."""
        reaches = np.partition(np.abs(self.trial - values), self.least - 1, axis=1)[:, self.least - 1]
        at = min(len(reaches) - 1, wanted * len(reaches) // self.rows)
        return max(self.least_window, float(np.partition(reaches, at)[at]))

    def colliding(self, values: np.ndarray, reach: float) -> np.ndarray:
        """Rows that lie in the query-centred windows of enough sorted arrays."""
        moved = 4.0 * self.limit * self.starts
        # Two limits away lies between an array and its neighbours.
        low, high = (np.clip(values + side, -2.0 * self.limit, 2.0 * self.limit) + moved for side in (-reach, reach))
        low = np.searchsorted(self.sorted, low, side="left") - self.starts * self.rows
        high = np.searchsorted(self.sorted, high, side="right") - self.starts * self.rows
        # Places before ``low`` wrap around to large numbers.
        inside = (self.place - low[:, None].astype(self.kind)) < (high - low)[:, None].astype(self.kind)
        return np.flatnonzero(inside.view(np.uint8).sum(axis=0, dtype=np.uint8) >= self.least)


class NormBands:
    """A block's vectors in bands of similar norm, the longest first; each but small ones has its index."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        norms = np.sqrt((vectors**2).sum(axis=1))
        measured = np.isfinite(norms) & (norms > 0)  # squares of extreme components overflow or vanish
        self.bands: list[tuple[float, np.ndarray, ProjectionIndex | None]] = []
        if not measured.all():
            self.bands.append((np.inf, np.flatnonzero(~measured), None))
        rows = np.flatnonzero(measured)
        rows = rows[np.argsort(-norms[rows], kind="stable")]
        while len(rows):
            largest = float(norms[rows[0]])
            n = int((norms[rows] >= largest / BAND).sum())
            band, rows = rows[:n], rows[n:]
            self.bands.append((largest, band, ProjectionIndex(vectors[band], largest) if n > WHOLE_ROWS else None))

    def candidates(self, queries: np.ndarray, nearest: int):
        """For each query the verified rows, among which its nearest are."""
        wanted = nearest + 1  # the query itself may be one of them
        lengths = np.sqrt((queries**2).sum(axis=1))
        for q, query in enumerate(queries):
            length = float(lengths[q]) if np.isfinite(lengths[q]) and lengths[q] > 0 else None
            best, verified = np.empty(0), []

            def verify(rows: np.ndarray) -> None:
                nonlocal best
                verified.append(rows)  # noqa: B023
                scores = (self.vectors @ query)[rows] if 2 * len(rows) > len(self.vectors) else self.vectors[rows] @ query  # noqa: B023
                best = np.r_[best, scores]  # noqa: B023
                if len(best) > wanted:
                    best = np.partition(best, -wanted)[-wanted:]

            for largest, rows, index in self.bands:
                last = float(best.min()) if len(best) == wanted else -np.inf
                if length and length * largest < last - 1e-9 * abs(last):
                    continue
                if index is None or not length:
                    verify(rows)
                    continue
                values = index.places_of(query / length)
                unseen = np.ones(index.rows, bool)
                window = index.first_window(values, wanted)
                while unseen.any():
                    # The distance that the last wanted score means when both lie on the band's sphere.
                    last = float(best.min()) if len(best) == wanted else -np.inf
                    end = REACH * np.sqrt(max(0.0, 2 * largest * (largest - last / length)))
                    window = window if np.isinf(end) else end
                    found = index.colliding(values, window)
                    found = found[unseen[found]]
                    unseen[found] = False
                    verify(rows[found])
                    if window >= end:
                        break
                    window *= WIDER
            yield q, np.concatenate(verified) if verified else np.empty(0, int)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _searched(queries: pa.Table, vectors: pa.Table, nearest: int) -> pa.Table:
    """The best of one block of vectors for one block of queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not queries.num_rows or not vectors.num_rows:
        return schema.empty_table()
    ids = vectors.column("vec_id").to_numpy()
    matrix = _matrix(vectors.column("vector"), len(ids))
    distinct, kind = np.unique(matrix, axis=0, return_inverse=True)
    by_kind = np.lexsort((ids, kind.ravel()))
    firsts = np.r_[0, np.cumsum(np.bincount(kind.ravel()))]
    index = NormBands(distinct)
    asked, asked_ids = _matrix(queries.column("vector"), queries.num_rows), queries.column("vec_id").to_pylist()
    out: list[tuple[int, int, float]] = []
    for q, rows in index.candidates(asked, nearest):
        own, best = asked_ids[q], []
        close = (distinct @ asked[q])[rows] if 2 * len(rows) > len(distinct) else distinct[rows] @ asked[q]
        if len(rows) > nearest + 1:  # a last digit may differ from the score itself
            least = np.partition(close, -nearest - 1)[-nearest - 1]
            rows = rows[~(close < least - 1e-9 * max(1.0, abs(least)))]
        scores = (distinct[rows] * asked[q]).sum(axis=1)
        for row, score in sorted(zip(rows.tolist(), scores.tolist(), strict=True), key=lambda x: -x[1]):
            if len(best) > nearest and score < best[nearest - 1][0]:
                break
            same = ids[by_kind[firsts[row] : firsts[row + 1]][: nearest + 1]]
            best += [(score, v) for v in same.tolist() if v != own]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[nearest + 1 :]
        out += [(own, v, score) for score, v in best[:nearest]]
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    given = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    given = given.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    given = given.filter(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0.0))
    lengths = given.groupBy(F.size("vector").alias("_size")).count().orderBy(F.desc("count"), "_size").limit(1)
    return given.join(F.broadcast(lengths), F.size("vector") == F.col("_size")).select("vec_id", "vector")


def search(
    vectors: DataFrame, is_query: Column, nearest: int = NEAREST, vector_rows: int = VECTOR_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query. ``vectors``: (vec_id, vector)."""
    prepare(vectors.sparkSession)
    landed = land(vectors)
    facts = landed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_query).alias("queries")).first()
    n_vectors = max(1, -(-facts.rows // vector_rows))
    n_queries = max(1, -(-facts.queries // query_rows))
    everywhere = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    queries = landed.filter(is_query).select(
        "*", spread(["vec_id"], F.lit(n_queries)).cast("int").alias("_q"), everywhere(n_vectors, "_v"))
    blocks = landed.select(
        "*", spread(["vec_id"], F.lit(n_vectors)).cast("int").alias("_v"), everywhere(n_queries, "_q"))
    found = queries.groupBy("_q", "_v").cogroup(blocks.groupBy("_q", "_v")).applyInArrow(
        lambda q, v: _searched(q, v, nearest), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
