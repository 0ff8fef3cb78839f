"""Streaming extension: frozen transforms and windowed statistics over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files with event time as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling count, mean and population sd by event type; rows later than the watermark are dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    out = by.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "sd")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users that end after ``gap`` without an event."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n", "total")


def score(events: DataFrame, fitted: list) -> DataFrame:
    """Frozen transforms applied to a stream: projections without state."""
    from pixelframe.operators.transforms import apply_chain

    return apply_chain(events, fitted)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all that is there into a memory table; for tests and small jobs."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)
