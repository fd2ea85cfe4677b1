"""Event-time aggregation of a stream of events: daily windows per event type, with a watermark.

Events may come late and more than once. Repeats of an event id are dropped within the watermark, late events count as
long as their day's window is open, and a window is written, once, when the watermark (the latest event time seen less
``delay``) has passed its end. State holds the open windows and the ids of ``delay``, so it does not grow with the stream.
The sink is Spark's file sink, whose log makes every window appear exactly once, also after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELAY = "2 days"
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
WINDOWS = "day timestamp, event_type string, n_events long, n_valued long, value_cents long"


def daily_windows(events: DataFrame) -> DataFrame:
    """Per day and event type: events, those with a value, and the values' sum in cents (whole, so that order does not matter)."""
    cents = F.round(F.col("value") * 100).cast("long")
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.count("value").alias("n_valued"), F.coalesce(F.sum(cents), F.lit(0)).alias("value_cents")) \
        .select(F.col("w.start").alias("day"), "event_type", "n_events", "n_valued", "value_cents")


def daily_stream(spark: SparkSession, source_dir: str, target: str, checkpoint: str, delay: str = DELAY, files_per_batch: int | None = None):
    """Start the job over the files of ``source_dir`` and return the ``StreamingQuery`` (trigger: all available files)."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(source_dir).where("ts IS NOT NULL").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return (daily_windows(events).writeStream.outputMode("append").format("parquet").option("path", target)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_windows(spark: SparkSession, target: str) -> DataFrame:
    """The windows written so far."""
    return spark.read.schema(WINDOWS).parquet(target)
