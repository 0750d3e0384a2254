"""Plot data: equal-width histograms and colour-magnitude columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _scale(low: Column, high: Column) -> tuple[Column, Column]:
    """Start and width of the binned range; a single value sits in a unit-wide range."""
    flat = low == high
    return F.when(flat, low - F.lit(0.5)).otherwise(low), F.when(flat, F.lit(1.0)).otherwise(high - low)


def _edge(number: Column, low: Column, high: Column, bins: int) -> Column:
    start, width = _scale(low, high)
    return number * (width / F.lit(float(bins))) + start


def _binned(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number over [low, high], last bin closed, agreeing with the edges as reported."""
    start, width = _scale(low, high)
    last = F.lit(bins - 1)
    guess = F.least(F.floor((value - start) / width * F.lit(float(bins))), last)
    return (
        F.when(value < _edge(guess, low, high, bins), guess - 1)
        .when((guess < last) & (value >= _edge(guess + 1, low, high, bins)), guess + 1)
        .otherwise(guess)
        .cast("int")
    )


def _histograms(long: DataFrame, bins: int) -> DataFrame:
    """Histograms of (name, v) rows, each name over its own range: one scan for all ranges, one for all counts."""
    present = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    limits = present.groupBy("name").agg(F.min("v").alias("_lowest"), F.max("v").alias("_highest"))
    lowest, highest = F.col("_lowest"), F.col("_highest")
    number = _binned(F.col("v"), lowest, highest, bins).alias("bin")
    counts = present.join(F.broadcast(limits), "name")  # as many rows as the caller names columns or categories
    counts = counts.groupBy("name", "_lowest", "_highest", number).agg(F.count(F.lit(1)).alias("n"))
    filled = counts.groupBy("name", "_lowest", "_highest").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_counts"))  # at most ``bins`` entries
    return filled.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "name", "bin",
        _edge(F.col("bin"), lowest, highest, bins).alias("low"),
        _edge(F.col("bin") + 1, lowest, highest, bins).alias("high"),
        F.coalesce(F.element_at("_counts", F.col("bin")), F.lit(0)).alias("n"),
    )


def histogram_columns(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """A histogram per listed column (named in ``column``), each over the range of its present values.

    Empty bins are reported as zero; no present value means no bins.
    """
    values = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]
    return _histograms(df.select(F.explode(F.array(*values)).alias("_v")).select("_v.*"), bins).withColumnRenamed(
        "name", "column")


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts of ``bins`` equal-width bins of one column."""
    return histogram_columns(df, [value], bins).drop("column")


def histogram_by(df: DataFrame, value: str, category: str, categories: Sequence[str], bins: int = 30) -> DataFrame:
    """A histogram per listed category, each over its own range."""
    listed = df.filter(F.col(category).isin(*categories)).select(
        F.col(category).alias("name"), F.col(value).cast("double").alias("v"))
    return _histograms(listed, bins).withColumnRenamed("name", category)


def color_magnitude(matches: DataFrame, color: str = "gaia_bp_rp", magnitude: str = "gaia_phot_g_mean_mag") -> DataFrame:
    """The two columns of a colour-magnitude diagram, complete rows only."""
    return matches.select(color, magnitude).na.drop()
