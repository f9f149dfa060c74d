"""Streams over the events table, next to their batch twins.

The same transformation serves both; a streamed result equals the batch result
once the watermark has passed its windows (or in complete mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "10 minutes"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of parquet files; event times carry a zone, as watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    return _windowed(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "1 day", step: str = "12 hours", late: str = LATE) -> DataFrame:
    return _windowed(events, F.window("ts", width, step), late)


def _windowed(events: DataFrame, window, late: str) -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run(result: DataFrame, table: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream over all that is there into a table in memory."""
    writer = result.writeStream.outputMode(mode).format("memory").queryName(table).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return query
