"""Sources, windowed views, sinks and live settings of streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replay_source(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A recorded frame table as a stream, a few files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def event_time(frames: DataFrame, ts: str) -> DataFrame:
    """Timestamps without a zone become instants, which a watermark requires."""
    return frames.withColumn(ts, F.col(ts).cast("timestamp"))


def recent_history(frames: DataFrame, ts: str, keys: list[str], value: str, span: str = "5 seconds", hop: str = "1 second",
                   lateness: str = "10 seconds") -> DataFrame:
    """Sliding view of the last ``span``: frame count, mean and maximum per key."""
    return (
        frames.withWatermark(ts, lateness).groupBy(F.window(ts, span, hop), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak"))
    )


def tumbling_counts(frames: DataFrame, ts: str, keys: list[str], span: str, lateness: str) -> DataFrame:
    return frames.withWatermark(ts, lateness).groupBy(F.window(ts, span), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(frames: DataFrame, ts: str, key: str, active: Column, gap: str, lateness: str) -> DataFrame:
    """Speech sessions: active frames closer than ``gap`` belong together."""
    return (
        frames.filter(active).withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), key)
        .agg(F.count(F.lit(1)).alias("n_frames"))
    )


def without_repeats(frames: DataFrame, ts: str, ids: list[str], lateness: str) -> DataFrame:
    return frames.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(ids)


def append_sink(events: DataFrame, folder: str, checkpoint: str, available_now: bool = False):
    """Triggers to an append-only table; the checkpoint makes restarts exact."""
    writer = events.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def with_live_settings(
    frames: DataFrame, settings_path: str, handle: Callable[[DataFrame, dict, int], None], checkpoint: str, available_now: bool = False
):
    """Micro-batches handled under settings re-read from a one-row table each time."""
    spark = frames.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        # One row of settings; the batch itself stays distributed.
        handle(batch, spark.read.parquet(settings_path).first().asDict(), number)

    writer = frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
