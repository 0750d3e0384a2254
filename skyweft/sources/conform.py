"""Bring tables with varying columns into a known shape while the plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyweft.functions.nulls import nan_to_null


def find_column(columns: Sequence[str], names: Sequence[str], ignore_case: bool = False) -> str | None:
    """First of ``columns`` that goes by one of ``names``, or None."""
    wanted = {n.lower() for n in names} if ignore_case else set(names)
    return next((c for c in columns if (c.lower() if ignore_case else c) in wanted), None)


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def _cast(df: DataFrame, field: T.StructField) -> Column:
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType).alias(field.name)
    arriving = df.schema[field.name].dataType
    if isinstance(field.dataType, T.StringType) and isinstance(arriving, (T.DoubleType, T.FloatType)):
        raise TypeError(f"{field.name}: an identifier kept as a float has lost digits; supply it as long or string")
    return F.col(f"`{field.name}`").cast(field.dataType).alias(field.name)


def conform(df: DataFrame, schema: T.StructType, clean: bool = True) -> DataFrame:
    """Exactly the columns of ``schema``: cast, absent ones NULL, NaN made NULL.

    ``clean=False`` leaves values alone, for a table whose NaNs are NULL already.
    """
    shaped = df.select(*[_cast(df, f) for f in schema.fields])
    return nan_to_null(shaped) if clean else shaped
