"""Extension: uploads as a stream, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage


def merge_uploads(uploads: DataFrame, folder: str, checkpoint: str):
    """Start a stream that upserts each micro-batch of nodes into the table at ``folder``; batch_id marks what a batch wrote."""
    def step(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("batch_id", F.lit(str(batch_id)))
        try:
            old = storage.latest(batch.sparkSession, folder)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = new.limit(0)
        storage.save(storage.upsert(old, new, ["node_id"]), folder)

    return uploads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n): tumbling or sliding counts with a watermark; of a stream or a table (ts, event_type)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n): sessions that end after a gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
