"""File events that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyquill.operators import events as ev


def session_stream(events: DataFrame, gap_seconds: int = ev.ACTIVITY_SECONDS, late: str = "1 hour") -> DataFrame:
    """Closed activity sessions per path; the watermark bounds what is kept open."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.session_window("ts", f"{gap_seconds} seconds")
    return (
        timed.groupBy("path", window.alias("session"))
        .agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))
        .select("path", "started", "ended", "events")
    )


def fold_batches(path: str):
    """Sink that keeps each batch's last event per path; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last = F.max_by(F.struct("event", "fingerprint", "ts", "event_id"), F.struct("ts", "event_id"))
        folded = batch.groupBy("path").agg(last.alias("last")).select("path", "last.*")
        folded.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """Current files from the folded batches."""
    return ev.current_files(spark.read.parquet(path))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write one last event per path as batch -1 of a new folder, deletions included, so that readers no longer
    go over all history. The stream that has stopped goes on with ``fold_batches(target)``."""
    events = spark.read.parquet(path)
    last = F.max_by(F.struct("event", "fingerprint", "ts", "event_id"), F.struct("ts", "event_id"))
    events.groupBy("path").agg(last.alias("last")).select("path", "last.*").write.parquet(f"{target}/batch=-1")
