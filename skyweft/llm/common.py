"""Helpers that several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyweft.session import ship_code, shared_folder

#: A word is a run of anything but space and the five ASCII line and tab characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 16 << 20
SLICE_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Send the package to the Python workers and bound the bytes of an Arrow batch, so long texts fit in memory."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def land(df: DataFrame) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    Later stages neither repeat the work nor depend on any executor's disk.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_slices(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE_ROWS
) -> DataFrame:
    """Apply ``function`` to slices of at most ``rows`` rows; no task ever holds more than a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield function(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def spread(columns: list[str], parts: Column) -> Column:
    """Number from 0 to ``parts`` - 1 by the hash of ``columns``."""
    return F.pmod(F.xxhash64(*columns), parts)
