"""Small helpers the operators share: table reads, written intermediate tables, seeded hashes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.session import ensure_checkpoint_dir

#: The word pattern of all text operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the cluster's shared folder and read it back.

    The folder is the session's ``spark.checkpoint.dir``. Later reads prune columns and survive the loss of
    any executor. The files stay until ``drop_written`` or the owner of the folder removes them.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Remove every table ``written`` left in this session's shared folder; returns how many.

    Call it when no DataFrame that reads them is needed any more.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("llm-")] if fs.exists(root) else []
    for p in found:
        fs.delete(p, True)
    return len(found)


def seeded_hex(seed: int, *cols: str | Column) -> Column:
    """md5 hex over the seed and the columns as text (null: ``~``); the same text in DuckDB gives the same hex."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hex_int(hex_col: Column, first: int, digits: int) -> Column:
    """``digits`` hex digits from position ``first`` (1-based) as a long."""
    return F.conv(F.substring(hex_col, first, digits), 16, 10).cast("long")


def fold_of(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def numbered(df: DataFrame, group: list[str], hash_col: str, order: list[str], out: str, rows_per_bucket: int = 20_000, total: str = "_total") -> DataFrame:
    """Add ``total``, the rows of the group, and ``out``: each row's 0-based place in its group, ordered by ``hash_col`` (a long, 0 to 2^32 - 1) and ``order``.

    No group is sorted in one task: rows are dealt by (group, top bits of the hash) and the places of earlier
    buckets are added. The number of buckets follows the row count; places do not depend on it. Rows equal in
    all of ``hash_col`` and ``order`` are numbered in any order. Null group values are groups of their own.
    """
    n = df.count()
    bits = min(24, max(4, (max(n // rows_per_bucket, 1)).bit_length() + 4))
    df = df.withColumn("_b", F.shiftright(F.col(hash_col), 32 - bits))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(total, F.sum("_n").over(Window.partitionBy(*group)))
    placed = df.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(hash_col, *order)) - 1)
    o = offsets.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(group)], F.col("_b").alias("_ob"), "_at", total)
    match = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(group)]
    cond = F.col("_b") == F.col("_ob")
    for m in match:
        cond = cond & m
    return placed.join(o, cond).withColumn(out, (F.col("_at") + F.col("_r")).cast("long")).drop("_b", "_r", "_ob", "_at", *[f"_o{i}" for i in range(len(group))])


def package_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (local runs, shared homes).

    Where the package is installed on the workers or shipped with ``--py-files``, the extra path does nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
