"""Computed columns that later filters name without repeating their formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_columns_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for long formulas that filters are written on.

    Spark moves a filter below the columns it names and copies their formulas into it,
    once for every mention. Formulas of formulas then fill a generated method of more than
    8,000 bytes of bytecode, which the JVM interprets instead of compiling. The one-element array
    keeps the filter above the values.
    """
    values = F.explode(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    names = [*df.columns, *[name for name in columns if name not in df.columns]]
    return df.select("*", values.alias("_once")).select(
        *[F.col("_once").getField(c).alias(c) if c in columns else F.col(f"`{c}`") for c in names])
