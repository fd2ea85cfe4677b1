"""Catalog operators: schema-aware column pick (P12) and keyword title match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """First candidate present in the schema. Missing and required -> error."""
    for c in candidates:
        if c in df.columns:
            return c
    if required:
        raise ValueError(f"none of {list(candidates)} in columns {df.columns}")
    return None


def keyword_table(spark: SparkSession, keywords: dict[int, Sequence[str]] | Sequence[tuple[int, str]]) -> DataFrame:
    """(p_mt, keyword) rows from a month -> keywords mapping; size is the parameter's size."""
    if isinstance(keywords, dict):
        rows = [(int(m), str(k)) for m, ks in keywords.items() for k in ks]
    else:
        rows = [(int(m), str(k)) for m, k in keywords]
    return spark.createDataFrame(rows, "p_mt int, keyword string")


def keyword_assets(catalog: DataFrame, keywords: DataFrame, title_col: str = "asset_nm",
                   id_col: str = "asset_id") -> DataFrame:
    """(p_mt, asset_id) for every catalog title containing one of that month's keywords.

    Spaces are removed from the title before matching (``LIKE '%kw%'``). The
    keyword list is bounded by its parameter, so it is broadcast and the
    catalog streams through a broadcast nested-loop join; the catalog is never
    replicated.
    """
    title = F.replace(F.col(title_col), F.lit(" "), F.lit(""))
    kw = F.broadcast(keywords.select("p_mt", "keyword"))
    cat = catalog.select(F.col(id_col).alias("asset_id"), title.alias("_title"))
    return (cat.join(kw, F.col("_title").contains(F.col("keyword")), "inner")
               .select("p_mt", "asset_id").distinct())
