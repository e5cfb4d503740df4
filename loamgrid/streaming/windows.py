"""Event-time windows over a file stream of events: tumbling, sliding and session windows with a watermark; runs what is there, then stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files with the schema that the files have now; ``ts`` becomes an instant in the session's time zone."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def window_of(kind: str) -> Column:
    return {"tumbling": F.window("ts", "1 hour"), "sliding": F.window("ts", "1 hour", "30 minutes"), "session": F.session_window("ts", "30 minutes")}[kind]


def windowed_counts(events: DataFrame, kind: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and event type (per user for sessions). Works on streams and tables alike; rows without ``ts`` have no window."""
    keys = [window_of(kind).alias("w"), "user_id" if kind == "session" else "event_type"]
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.where("ts IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), keys[1], "n", "total")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all files that are there; with the same checkpoint a later run continues after them, so every file counts once."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
