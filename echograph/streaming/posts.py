"""Structured Streaming front-end: first sightings and reuse tallies as posts arrive.

A late post with an earlier date changes a text's origin, so streamed tallies are provisional; the batch
result over the stored posts is the authoritative one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_sightings(posts: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first post of each (key, channel) within the watermark."""
    return posts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key", "channel"])


def hourly_volume(posts: DataFrame, delay: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Posts per channel and (tumbling or sliding) window."""
    timed = posts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "channel").agg(F.count("*").alias("n"))


def sessions(posts: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of one channel's posts."""
    timed = posts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.session_window("ts", gap), "channel").agg(F.count("*").alias("n"))


def tally_sink(path: str):
    """A foreachBatch function that appends each batch's sightings; edges are then a batch query over path.
    The batch id makes a replayed batch overwrite itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
