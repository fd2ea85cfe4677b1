"""File ingest and sinks.

CSV files are read one per path and united by column name: a single
multi-file ``spark.read.csv`` maps columns by position and would silently
mislabel files whose headers differ (trap 8). Rows that do not parse are
dropped (``DROPMALFORMED``, the closest Spark mode to ignoring errors).
Writes go to the shared folder named by ``spark.checkpoint.dir`` or to a
caller-given path, never to a machine-local temp folder.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.session import ensure_checkpoint_dir

WHOLE = r"^[+-]?\d+$"
NUMBER = r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?Infinity)$"
DAY = r"^\d{4}-\d{2}-\d{2}"


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path inside the cluster's shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths matching a glob, resolved by the cluster file system (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    statuses = path.getFileSystem(conf).globStatus(path)
    return sorted(str(s.getPath().toString()) for s in (statuses or []))


def type_columns(text: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Type the text columns of ``text`` from all their values, in one aggregate.

    A column gets the first of int, bigint, double, boolean, date and timestamp that every non-null value can be
    read as; a column with other values, or none, stays text. ``types`` declares types that are not guessed; a
    value that does not fit a declared type becomes null.
    """
    types = dict(types or {})
    guessed = [c for c in text.columns if c not in types]

    def fits(column: str) -> dict[str, Column]:
        v = F.trim(F.col(f"`{column}`"))
        return {"int": v.rlike(WHOLE) & v.try_cast("int").isNotNull(),
                "bigint": v.rlike(WHOLE) & v.try_cast("bigint").isNotNull(),
                "double": v.rlike(NUMBER) & v.try_cast("double").isNotNull(),
                "boolean": F.lower(v).isin("true", "false"),
                "date": v.rlike(DAY + "$") & v.try_cast("date").isNotNull(),
                "timestamp": v.rlike(DAY + "[ T]") & v.try_cast("timestamp").isNotNull()}

    tests = [(c, t, test) for c in guessed for t, test in fits(c).items()]
    held = [F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), test)).alias(str(i)) for i, (c, _, test) in enumerate(tests)]
    row = text.agg(*held).first() if tests else []
    for (c, t, _), holds in zip(tests, row):
        if holds:
            types.setdefault(c, t)
    return text.select(*[F.col(f"`{c}`").try_cast(types.get(c, "string")).alias(c) for c in text.columns])


def read_csv_union(spark: SparkSession, paths: Sequence[str], header: bool = True, infer_schema: bool = True,
                   mode: str = "DROPMALFORMED", types: Mapping[str, str] | None = None) -> DataFrame:
    """Each CSV path read as text on its own, united by column name, then typed once over the union.

    Types found per file would clash where one file has a column's numbers and another its text.
    """
    frames = [spark.read.option("header", header).option("mode", mode).csv(p) for p in paths]
    if not frames:
        raise FileNotFoundError("no CSV paths")
    text = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return type_columns(text, types) if infer_schema else text


def read_first_csv(spark: SparkSession, pattern: str, **kw) -> DataFrame:
    """The first matching path in sorted order (the reference took an arbitrary first match)."""
    paths = list_paths(spark, pattern)
    if not paths:
        raise FileNotFoundError(pattern)
    return read_csv_union(spark, paths[:1], **kw)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Parquet sink, partitioned (by month) so later month filters prune directories."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header (UTF-8 without the byte-order mark the reference added)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON-lines report."""
    df.write.mode(mode).json(path)
    return path


def save_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> dict[str, str]:
    """A persistent store of named tables as parquet directories under one root."""
    out = {}
    for name, df in tables.items():
        out[name] = write_parquet(df, os.path.join(root, name), mode=mode)
    return out


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """A catalog table under ``path``, bucketed and sorted by ``key``.

    Joins and aggregates on the key read tables of the same number of buckets without a shuffle; the number should
    give buckets of a few hundred MB. A session joins on more keys than the bucketed one without a shuffle only with
    ``spark.sql.requireAllClusterKeysForCoPartition`` off, as ``session.DEFAULT_CONF`` has it.
    """
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
       .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return df.sparkSession.table(table)


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, name))
