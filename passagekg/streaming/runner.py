"""Streaming form of the resumable run (an extension; the batch runner is operators.runner).

New passages are extracted as they arrive. Exactly-once comes from the checkpoint and from writing each micro-batch
under its epoch, which a repeated batch overwrites; ``within_watermark`` bounds the state for late duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekg.operators.runner import Extractor


def stream_results(passages: DataFrame, extractor: Extractor, path: str, checkpoint: str, available_now: bool = True):
    """Start the query; ``passages`` is a streaming DataFrame with the passages columns."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = extractor(batch.dropDuplicates(["passage_id"])).withColumn("run_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    writer = passages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and value sums per type in tumbling windows, with a watermark for late events (batch or stream)."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def replayed(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder as a stream, for replays and tests."""
    return spark.readStream.schema(schema).parquet(path)
