"""Event-time aggregations that run alike in batch and in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str) -> DataFrame:
    """Counts and sums a window and event type; ts must be a timestamp, with a watermark if the input is a stream."""
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


def event_stream(spark: SparkSession, folder: str, late: str = "10 minutes") -> DataFrame:
    """Stored events as a stream of files, with event time and a watermark."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_available(result: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the sink is Parquet, so a restart goes on from the checkpoint."""
    q = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def deduplicated(events: DataFrame) -> DataFrame:
    """One event of each id inside the stream's watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])
