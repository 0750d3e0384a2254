"""One missing marker: NaN becomes NULL at ingestion, flags are never NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace NaN with NULL in the given or else in every floating-point column."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if columns is not None:
        floating &= set(columns)
    return df.select(
        *[
            F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def flag(predicate: Column) -> Column:
    """A predicate whose missing outcome counts as false."""
    return F.coalesce(predicate, F.lit(False))


def is_finite(value: Column) -> Column:
    """True for a present value that is neither NaN nor infinite."""
    return flag(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; a missing value stays missing."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)
