"""Monthly activity (A5) maintained incrementally with Structured Streaming.

The viewing log arrives as files. Each micro-batch is aggregated to (user, month) and written as that batch's own
partition of a plain parquet table, ``p_mt=<YYYYMM>/batch=<id>``, by dynamic partition overwrite: a replayed batch
replaces what it had written, and no batch reads or rewrites what others wrote. Readers add the parts up, which month
filters prune by directory. Restricting to known users is a stream-static semi-join. The checkpoint lives in the shared
checkpoint folder, so a restarted query resumes from its last committed batch.

No state is kept, so events may be as late as they like.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions.months import month_of
from tenure.session import ensure_checkpoint_dir

KEYS = ("user_id", "p_mt")
SUMS = ("vod_view_cnt", "vod_use_tms_sum")


def monthly_stream(spark: SparkSession, source_dir: str, schema, users: DataFrame | None, start: int, end: int,
                   target: str, checkpoint: str | None = None, files_per_batch: int = 2):
    """Start the incremental job and return the ``StreamingQuery`` (trigger: all available files)."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    ev = events.filter(F.col("strt_dt").isNotNull()).withColumn("p_mt", month_of("strt_dt")) \
               .filter(F.col("p_mt").between(start, end))
    if users is not None:
        ev = ev.join(users.select("user_id").distinct(), "user_id", "left_semi")

    def add(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("vod_view_cnt"), F.coalesce(F.sum("use_tms"), F.lit(0)).cast("bigint").alias("vod_use_tms_sum"))
        (part.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("p_mt", "batch").parquet(target))

    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "stream", "monthly_activity")
    return ev.writeStream.foreachBatch(add).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


def read_monthly(spark: SparkSession, target: str) -> DataFrame:
    """The table's current state: the parts of all batches added up."""
    parts = spark.read.schema("user_id long, vod_view_cnt long, vod_use_tms_sum long, p_mt int, batch long").parquet(target)
    return parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
