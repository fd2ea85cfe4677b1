"""Spark session helpers.

Library code never creates its own session: every operator takes DataFrames and
returns DataFrames. These helpers exist for tests, bench runs and command-line
jobs, and for the one place where lineage must be cut (``checkpoint_dir``).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on. AQE re-plans joins at runtime (broadcast only
# when the measured side is under the threshold, sort-merge otherwise) and
# splits skewed shuffle partitions; the session time zone is fixed so that
# month strings derived from timestamps do not depend on the machine.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # tables bucketed by user are joined on (user, month) without a shuffle
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def scale_conf(shuffle_bytes: int, split_bytes: int = 256 << 20, target_partition_bytes: int = 256 << 20,
               max_partitions: int | None = None) -> dict:
    """Sizing for a cluster run, from the bytes the largest shuffle is expected to move.

    The initial shuffle partition count keeps each reduce partition near
    ``target_partition_bytes`` (so it sorts and aggregates in executor memory
    without spilling); AQE then coalesces small partitions to the advisory
    size, and splits a partition above the skew threshold (a user with a
    third of the log) across tasks. Scan splits of ``split_bytes`` keep the
    task count of a 100 TB scan in the hundreds of thousands, not millions.
    A launcher applies these only for keys it has not set itself. ``max_partitions`` bounds the number of
    partitions, which then hold more than the target; by default there is no bound.
    """
    parts = max(200, -(-int(shuffle_bytes) // int(target_partition_bytes)))
    if max_partitions:
        parts = min(parts, max_partitions)
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tenure", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults.

    ``master`` and ``shuffle_partitions`` are only for local runs; on a cluster
    the launcher decides them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared file system; a session on a
    cluster without it is an error, as a folder of one machine would be lost
    with it. Only a local session (tests) gets a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[[^]]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="tenure-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a plan is read twice and must see the same rows both times
    (range partition bounds are sampled, so re-running the sort could move
    rows between partitions). Survives executor loss, unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # keep the rows while the checkpoint job writes them, so the plan runs once, not twice
    df = df.persist()
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
