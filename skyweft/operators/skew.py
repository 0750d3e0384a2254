"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SALT = "_salt"
PARTS = "_parts"


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Keys with more than ``min_rows`` rows; ``_parts`` says into how many pieces of that size each has to be split."""
    return split_keys(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, "_rows", min_rows)


def split_keys(tally: DataFrame, keys: Sequence[str], rows: str, min_rows: int) -> DataFrame:
    """The hot ones among counted keys, as ``hot_keys`` gives them."""
    return tally.filter(F.col(rows) > min_rows).select(
        *keys, F.ceil(F.col(rows) / F.lit(float(min_rows))).cast("int").alias(PARTS)
    )


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    how: str = "inner",
    min_rows: int = 500_000,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join rows to a table with at most one row per key, splitting hot keys.

    Rows of a hot key in ``many`` are spread over several tasks by the hash of
    ``spread_by``; only the matching rows of ``one`` are copied to them. ``hot``
    spares counting the keys where the caller has done so.
    """
    keys = list(keys)
    hot = hot_keys(many, keys, min_rows) if hot is None else hot
    parts = F.coalesce(F.col(PARTS), F.lit(1))
    spread = many.join(hot, keys, "left").withColumn(SALT, F.pmod(F.xxhash64(spread_by), parts).cast("int"))
    copies = one.join(hot, keys, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.drop(PARTS).join(copies.drop(PARTS), [*keys, SALT], how).drop(SALT)
