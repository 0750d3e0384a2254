"""Matching a stream of alerts against a catalog at rest.

Alerts arrive as files, or from any other streaming source, with an identifier, a
time and a place. Repeated alerts are dropped within a watermark, so the state holds
the identifiers of one watermark's length. Every micro-batch is then matched as an
ordinary DataFrame, with the plans of ``crossmatch_nearest``, and written to a folder of its own
number: a batch that is repeated after a failure overwrites what it wrote before, so
each alert is matched once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skyweft.operators.nearest import NearestOptions, crossmatch_nearest
from skyweft.session import cut_lineage, own_tables

BATCH = "_batch"


def read_alerts(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def match_alerts(
    alerts: DataFrame, catalog: DataFrame, out: str, checkpoint: str, *, key: str = "alert_id", time: str = "time",
    watermark: str = "1 day", available_now: bool = True, options: NearestOptions = NearestOptions(coarse_filter=True),
    **match,
) -> StreamingQuery:
    """Start matching: each alert with the nearest catalog row, one parquet folder in ``out`` a micro-batch.

    ``checkpoint`` is where the stream's progress and state live; a query started again
    with it goes on where it stopped. Alerts without a match are not written. Alerts whose
    time is older than the watermark by the latest seen are late and left out. Further arguments go to ``crossmatch_nearest``.
    """
    once = alerts.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])

    @own_tables
    def write(spark: SparkSession, batch: DataFrame, number: int) -> None:
        # Written first: the join goes over the batch several times, each of which would repeat the deduplication and its state.
        matched = crossmatch_nearest(cut_lineage(batch), catalog, left_key=key, options=options, **match)
        matched.write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")

    def run(batch: DataFrame, number: int) -> None:
        write(batch.sparkSession, batch, number)

    writer = once.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_matched(spark: SparkSession, out: str) -> DataFrame:
    """All matched alerts written so far."""
    return spark.read.parquet(out).drop(BATCH)


def catch_up(query: StreamingQuery) -> None:
    """Wait until a query over what is available has ended, and raise what it failed with."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def alert_rates(alerts: DataFrame, *, time: str = "time", window: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Alerts in each window of time, as a streaming aggregation that closes windows behind the watermark."""
    counted = alerts.withWatermark(time, watermark).groupBy(F.window(time, window).alias("_window"))
    return counted.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), "n")
