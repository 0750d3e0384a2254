"""Isolation forest (Liu, Ting & Zhou 2008): random trees isolate outliers early.

Spark draws the subsamples and deals them to trees, every tree is grown in its
own group of at most ``max_samples`` rows, and scoring is one pass over Arrow
batches. The only thing that reaches the driver is the model, whose size
``trees * (2 * max_samples - 1)`` nodes does not depend on the data.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyweft.functions.once import with_columns_once

#: Draws and splits come from MD5 and this prime alone, so any engine can repeat them.
PRIME, FACTOR = 2**31 - 1, 1103515245
EULER_GAMMA = 0.5772156649015329
LEAF = -1
_MODEL_SCHEMA = "tree int, node int, feature int, threshold double, low int, high int, path double"


@dataclass(frozen=True)
class Forest:
    """Fitted trees as arrays of shape (tree, node); ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    path: np.ndarray
    samples: int
    depth: int


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def depth_limit(samples: int) -> int:
    return max(1, math.ceil(math.log2(max(samples, 2))))


def _grow(rows: pd.DataFrame, features: Sequence[str], seed: int) -> pd.DataFrame:
    """One tree over one subsample, as a table of nodes.

    A side of a split that no drawn row takes is a leaf that adds nothing to a path.
    """
    tree = int(rows["tree"].iloc[0])
    data = rows.sort_values("_draw")[list(features)].to_numpy(float)
    limit = depth_limit(len(data))
    nodes: list[list] = []
    pending = [(np.arange(len(data)), 0, None, None, 1)]
    while pending:
        members, depth, parent, side, place = pending.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent][side] = number
        if len(members) == 0:  # a threshold between neighbouring numbers can round up to the largest of them
            nodes.append([tree, number, LEAF, 0.0, LEAF, LEAF, 0.0])
            continue
        part = data[members]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
        if depth >= limit or len(members) <= 1 or len(spread) == 0:
            nodes.append([tree, number, LEAF, 0.0, LEAF, LEAF, depth + average_path(len(members))])
            continue
        digest = hashlib.md5(f"{seed}:{tree}:{place}".encode()).hexdigest()
        feature = int(spread[int(digest[:7], 16) % len(spread)])
        column = part[:, feature]
        threshold = float(column.min() + int(digest[7:14], 16) / 2.0**28 * (column.max() - column.min()))
        nodes.append([tree, number, feature, threshold, LEAF, LEAF, 0.0])
        below = column <= threshold
        pending.append((members[~below], depth + 1, number, 5, 2 * place + 1))
        pending.append((members[below], depth + 1, number, 4, 2 * place))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "low", "high", "path"])


def draw_subsamples(
    df: DataFrame, n_rows: int, features: Sequence[str], key: str | Sequence[str], trees: int, max_samples: int, seed: int
) -> DataFrame:
    """``max_samples`` rows per tree, drawn without replacement from the whole table by hash of the row key.

    In one pass every row is offered to all trees; a tree takes it when its own
    draw is below a threshold that lets about twice as many rows through as it
    needs, and keeps those with the smallest. A row's key is hashed once, to two
    numbers below ``PRIME``; each tree combines them with its own factor. Rows are offered
    by a plain explode, which is compiled, unlike functions over arrays.
    """
    keys = [key] if isinstance(key, str) else list(key)
    below = F.lit(int(min(1.0, 2 * max_samples / max(1, n_rows)) * PRIME * (PRIME + 1)))

    def draw(tree: Column) -> Column:
        own = (tree.cast("long") + 1) * FACTOR % PRIME
        return (F.col("_h") * own + F.col("_k")) % PRIME * (PRIME + 1) + (F.col("_k") * own + F.col("_h")) % PRIME

    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key")))
    number = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long") % PRIME
    hashed = with_columns_once(df.select(text.alias("_key"), *features), {"_h": number(1), "_k": number(9)})
    offered = hashed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).filter(draw(F.col("tree")) <= below)
    first = Window.partitionBy("tree").orderBy("_draw", "_key")
    drawn = offered.withColumn("_draw", draw(F.col("tree"))).withColumn("_rank", F.row_number().over(first))
    return drawn.filter(F.col("_rank") <= max_samples).drop("_h", "_k")


def fit_isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    key: str | Sequence[str],
    *,
    trees: int = 100,
    max_samples: int = 256,
    seed: int = 42,
) -> Forest | None:
    """Grow the trees on rows whose features are all finite; None without any row."""
    features = list(features)
    n_rows = df.count()
    if n_rows == 0:
        return None

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        return _grow(rows, features, seed)

    drawn = draw_subsamples(df, n_rows, features, key, trees, max_samples, seed)
    grown = drawn.select("tree", "_draw", *features).groupBy("tree").applyInPandas(grow, _MODEL_SCHEMA).toPandas()
    shape = (trees, int(grown["node"].max()) + 1)
    places = (grown["tree"].to_numpy(), grown["node"].to_numpy())
    kinds = {"feature": np.int16, "threshold": float, "low": np.int32, "high": np.int32, "path": float}
    arrays = {}
    for name, kind in kinds.items():
        arrays[name] = np.zeros(shape, dtype=kind)
        arrays[name][places] = grown[name].to_numpy()
    samples = min(max_samples, n_rows)
    return Forest(**arrays, samples=samples, depth=depth_limit(samples))


def path_lengths(forest: Forest, data: np.ndarray) -> np.ndarray:
    """Mean path length of each row over all trees.

    At a leaf both sides lead to the leaf itself, so every row takes the same steps.
    """
    total = np.zeros(len(data))
    flat, width = np.ascontiguousarray(data).ravel(), data.shape[1]
    first = np.arange(len(data)) * width
    own = np.arange(forest.feature.shape[1])
    for t in range(len(forest.feature)):
        leaf = forest.feature[t] < 0
        feature = np.where(leaf, 0, forest.feature[t]).astype(np.int64)
        sides = np.column_stack([np.where(leaf, own, forest.high[t]), np.where(leaf, own, forest.low[t])]).astype(np.int64).ravel()
        node = np.zeros(len(data), dtype=np.int64)
        for _ in range(forest.depth):
            below = flat.take(first + feature.take(node)) <= forest.threshold[t].take(node)
            node = sides.take(2 * node + below)
        total += forest.path[t].take(node)
    return total / len(forest.feature)


def anomaly_scores(forest: Forest, data: np.ndarray) -> np.ndarray:
    """Score in (0, 1]; the larger, the more isolated."""
    return np.power(2.0, -path_lengths(forest, data) / max(average_path(forest.samples), 1e-12))


def score_isolation_forest(
    df: DataFrame, forest: Forest | None, features: Sequence[str], valid: str, output: str = "anomaly_score"
) -> DataFrame:
    """Add the anomaly score where the boolean column ``valid`` holds, NULL elsewhere."""
    if forest is None:
        return df.withColumn(output, F.lit(None).cast("double"))
    model = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            data = np.column_stack([s.to_numpy(float) for s in batch])
            result = np.full(len(data), np.nan)
            usable = np.isfinite(data).all(axis=1)
            if usable.any():
                result[usable] = anomaly_scores(model.value, data[usable])
            yield pd.Series(result)

    # Rows that are not valid go in as NULL and come out as NaN.
    masked = [F.when(F.col(valid), F.col(f)) for f in features]
    scored = df.withColumn(output, score(*masked))
    return scored.withColumn(output, F.when(F.col(valid), F.col(output)))
