"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is how often each of its documents should be
taken. The whole part is taken outright, the fraction is an inclusion probability.
The cube method moves these probabilities three documents at a time along the
direction in which neither the sum of sizes nor the number of documents changes,
until one of the three is 0 or 1. A source's documents are dealt to groups of
bounded size; what a group cannot settle, at most two documents, goes on to the
next level, where groups are dealt anew. The last group of a source stops a dozen
documents short: that small landing problem is solved by trying all its ends.

Chance comes from hashes of doc_id, size and ``seed`` alone, so reruns agree. Only where
more rows of a source than half a group have one doc_id and size, the number of a row in
its input deals them to groups; such rows are alike in all that the operator returns.

Defined cases: a null or empty text has size 0 and adds nothing; null sources are
a source, ordered last; a source without words has target 0; repeated rows are
taken each for itself; no documents give no rows; other columns are not looked at.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skyweft.llm.common import WORD, land, prepare, spread

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
GROUP_ROWS = 2000
#: Documents of a source that are spared for the landing; with two more it has 2 ** (LANDED + 2) ends.
LANDED = 10
SETTLED = 1e-9


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, n_docs, target from a table (source, size); one row per source.

    Sources by code point, nulls last, take the weights in turn. Sharing out what
    capped sources leave until none is above its cap ends where every source has
    the smaller of its cap and a common level times its weight; the level comes
    from running sums over the sources in the order in which they reach their caps.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    table = sums.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    table = table.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    table = table.withColumn("_full_at", F.col("_cap") / F.col("_weight"))
    order = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    level = (everything - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    # Beyond the first source that stays below its cap the expression only falls, so its maximum is the level.
    table = table.withColumn("_level", F.when(level <= F.col("_full_at"), level))
    target = F.least("_cap", F.max("_level").over(Window.partitionBy()) * F.col("_weight"))
    return table.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def flight(sizes: list[int], chances: list[float], draw: random.Random, spared: int = 0) -> list[float]:
    """Chances after moving them in threes; beside the last ``spared``, at most two are left that are neither 0 nor 1."""
    left = list(chances)
    open_: list[int] = []
    for i in range(max(0, len(left) - spared)):
        if not SETTLED < left[i] < 1 - SETTLED:
            left[i] = float(round(left[i]))
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = (sizes[k] for k in open_)
        way = (b - c, c - a, a - b) if (a, b) != (b, c) else (1, -1, 0)
        up = down = float("inf")
        for k, w in zip(open_, way, strict=True):
            if w > 0:
                up, down = min(up, (1 - left[k]) / w), min(down, left[k] / w)
            elif w < 0:
                up, down = min(up, -left[k] / w), min(down, (left[k] - 1) / w)
        step = up if draw.random() * (up + down) < down else -down
        for k, w in zip(open_, way, strict=True):
            left[k] += step * w
            if not SETTLED < left[k] < 1 - SETTLED:
                left[k] = float(round(left[k]))
        open_ = [k for k in open_ if 0 < left[k] < 1]
    return left


def landing(sizes: list[int], chances: list[float]) -> list[float]:
    """Settle the few open chances at the end whose sizes, then number, are nearest to what they ask for."""
    open_ = [i for i, p in enumerate(chances) if 0 < p < 1]
    taken = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    size, chance = np.array([sizes[i] for i in open_], float), np.array([chances[i] for i in open_], float)
    off = np.round(np.abs(taken @ size - size @ chance), 6)
    number = np.round(np.abs(taken.sum(axis=1) - chance.sum()), 6)
    end = taken[np.lexsort((number, off))[0]]
    settled = list(chances)
    for i, s in zip(open_, end.tolist(), strict=True):
        settled[i] = float(s)
    return settled


def _dealt(rows: DataFrame, seed: int, level: int, group_rows: int) -> DataFrame:
    """``rows`` with their order and the part of their source, of ``_parts``, that they are settled in."""
    sizes = rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("_parts"))
    sizes = sizes.select(F.col("source").alias("_source"), "_parts")
    dealt = rows.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    alike = rows.groupBy("source", "doc_id", "size").count().filter(F.col("count") > group_rows // 2).select(
        F.col("source").alias("_of_source"), F.col("doc_id").alias("_doc"), F.col("size").alias("_of_size"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("size") == F.col("_of_size"))
    dealt = dealt.join(alike, same & F.col("source").eqNullSafe(F.col("_of_source")), "left")
    order = F.xxhash64("doc_id", "size", F.lit(seed), F.lit(level))
    own = F.xxhash64("_row", F.lit(seed), F.lit(level))
    dealt = dealt.withColumn("_order", F.when(F.col("_of_size").isNull(), order).otherwise(own)).drop("_of_source", "_doc", "_of_size")
    return dealt.withColumn("_part", F.pmod("_order", "_parts"))


def _moved(group: pd.DataFrame, seed: int) -> pd.DataFrame:
    last = int(group["_parts"].iloc[0]) == 1  # there the largest are landed: their sizes combine to nearly any sum
    group = group.sort_values(["size", "_order", "doc_id"] if last else ["_order", "doc_id", "size"], kind="stable")
    sizes, draw = group["size"].tolist(), random.Random(int(group["_order"].iloc[0]) ^ seed)
    left = flight(sizes, group["chance"].tolist(), draw, LANDED if last else 0)
    if last:
        left = landing(sizes, left)
    return group.assign(chance=left).drop(columns=["_order", "_part", "_parts"])


def cube_sample(rows: DataFrame, seed: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Settle ``chance`` of (_row, doc_id, source, size, chance, ...) rows at 0 or 1, balanced by source."""
    prepare(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
    done, level = rows.filter(~is_open), 0
    open_ = rows.filter(is_open)
    while True:
        dealt = _dealt(open_, seed, level, group_rows)
        moved = land(dealt.groupBy("source", "_part").applyInPandas(lambda group: _moved(group, seed), schema))
        done = done.union(moved.filter(~is_open))
        open_ = moved.filter(is_open)
        level += 1
        if open_.isEmpty():
            return done


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 0,
    group_rows: int = GROUP_ROWS, row: str | None = None,
) -> DataFrame:
    """_row, doc_id, size, source_size, target, taken, repeats of every document.

    _row is the column that ``row`` names, or else numbers the rows.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    sized = land(docs.select(number.alias("_row"), "doc_id", "source", size.alias("size")))
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "_source")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_row", "doc_id", "source", "size", "source_size", "target", F.round(times, 12).alias("_times"))
    whole = F.floor("_times")
    rows = land(rows.select("_row", "doc_id", "source", "size", "source_size", "target", whole.cast("int").alias("_whole"),
                            F.round(F.col("_times") - whole, 12).alias("chance")))
    repeats = F.col("_whole") + F.col("chance").cast("int")
    return cube_sample(rows, seed, group_rows).select(
        "_row", "doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_documents`` takes it."""
    numbered = land(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_all")))
    measured = numbered.select("_row", "_all.doc_id", "_all.text", "_all.source")
    taken = mix_documents(measured, **how, row="_row").filter(F.col("repeats") > 0).select("_row", "repeats")
    rows = numbered.join(taken, "_row")
    rows = rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return rows.select(*[F.col("_all")[c].alias(c) for c in docs.columns])
