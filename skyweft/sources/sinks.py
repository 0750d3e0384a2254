"""Writers. Large results stay partitioned; small reports become one file."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line in every part file."""
    df.write.mode(mode).option("header", True).csv(path)


def write_small_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file, for a report that the caller knows to be small."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_text(spark, text: str, path: str, mode: str = "overwrite") -> None:
    """UTF-8 text, through Spark's writer so that any file system works."""
    lines = spark.createDataFrame([(text,)], "value string")
    lines.coalesce(1).write.mode(mode).text(path)
