"""Reading the driver's parquet tables with column pruning."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SCHEMAS: dict[tuple[str, str], object] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one parquet table; ``columns`` reaches the scan as ``ReadSchema``.

    The table's schema is discovered once per application and then given to
    the reader, so later scans of the same table skip the footer-reading job
    that schema inference launches.
    """
    path = table_path(sf_dir, name)
    key = (spark.sparkContext.applicationId, path)
    schema = _SCHEMAS.get(key)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[key] = df.schema
    else:
        df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df
