"""Leakage and data-quality checks (Q1, Q3-Q7); Q2 lives with the models."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.months import valid_month
from tenure.operators.stats import varied_columns
from tenure.functions.numeric import fix

# Leakage thresholds and name tokens.
CORR_CRITICAL = 0.95
DOMINANCE_WARN = 0.5
TEMPORAL_RISK_TOKENS = {"END", "CANCEL", "STOP"}


def target_correlation(df: DataFrame, cols: Sequence[str], target: str, critical: float = CORR_CRITICAL) -> DataFrame:
    """Q1: Pearson r of every (encoded, filled) feature with the target, in one aggregate; null where either is constant."""
    varied = varied_columns(df, [*cols, target])
    row = df.agg(*[(F.corr(F.col(c).cast("double"), F.col(target).cast("double")) if {c, target} <= varied else F.max(F.lit(None).cast("double"))).alias(f"c{i}")
                   for i, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("r")) for i, c in enumerate(cols)])
    long = row.select(F.explode(items).alias("_x")).select("_x.feature", "_x.r")
    return long.select("feature", fix("r").alias("corr_with_target"),
                       F.coalesce(F.abs(F.col("r")) >= critical, F.lit(False)).alias("critical"))


_RISK_NAME = "(?i)(^|_)(" + "|".join(sorted(TEMPORAL_RISK_TOKENS)) + ")(_|$)"


def has_risk_token(name: str) -> bool:
    """Q3: END, CANCEL or STOP stands in the name between underscores or ends (so SEND does not match)."""
    return re.search(_RISK_NAME, name) is not None


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q4: every key that occurs more than once, with its count (the report keeps the count + 20 samples)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)


def month_format_issues(df: DataFrame, month_col: str, name: str) -> DataFrame:
    """Q6: rows whose month's last two digits are outside 1..12."""
    return df.agg(F.lit(name).alias("column"), F.count_if(~valid_month(month_col)).alias("invalid"),
                  F.count(F.lit(1)).alias("n"))


# check -> (level it raises, whether its columns are recommended for dropping)
CHECKS = {"target_correlation": ("critical", True), "name_token": ("critical", True), "duplicate_keys": ("critical", False),
          "dominance": ("warn", False), "id_in_features": ("warn", False), "month_format": ("warn", False)}


def findings(df: DataFrame, features: Sequence[str], id_cols: Sequence[str], corr: DataFrame, keys: Sequence[str], month_col: str,
             dominance: DataFrame | None = None) -> DataFrame:
    """Every finding as (check, column, value): Q1 correlations, Q3 names, Q4 repeated keys, Q5 ids, Q6 months, Q2 dominance.

    Name and id findings count the non-null rows of the column in ``df``. ``dominance`` has feature and share.
    """
    one = lambda check, name, value: F.struct(F.lit(check).alias("check"), name.alias("column"), value.cast("double").alias("value"))
    named = [(check, c) for check, hit in (("name_token", has_risk_token), ("id_in_features", lambda c: c in id_cols)) for c in features if hit(c)]
    parts = [corr.where("critical").select(one("target_correlation", F.col("feature"), F.col("corr_with_target")).alias("f")),
             duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(one("duplicate_keys", F.lit(",".join(keys)), F.col("n")).alias("f")),
             month_format_issues(df, month_col, month_col).where("invalid > 0").select(one("month_format", F.col("column"), F.col("invalid")).alias("f"))]
    if named:
        counts = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, (_, c) in enumerate(named)])
        parts.append(counts.select(F.explode(F.array(*[one(check, F.lit(c), F.col(f"n{i}")) for i, (check, c) in enumerate(named)])).alias("f")))
    if dominance is not None:
        parts.append(dominance.where(F.col("share") > DOMINANCE_WARN).select(one("dominance", F.col("feature"), F.col("share")).alias("f")))
    return reduce(DataFrame.unionAll, parts).select("f.*")


def severity(found: DataFrame) -> DataFrame:
    """Q7: the findings rolled up to one row: worst level, counts per check, columns to drop."""
    is_a = lambda *checks: F.col("check").isin(*checks)
    of_level = lambda level: is_a(*[c for c, (at, _) in CHECKS.items() if at == level])
    n = lambda check: F.count_if(is_a(check)).cast("int")
    total = lambda check: F.coalesce(F.sum(F.when(is_a(check), F.col("value"))), F.lit(0)).cast("long")
    drop = F.when(is_a(*[c for c, (_, d) in CHECKS.items() if d]), F.col("column"))
    return found.agg(
        F.when(F.count_if(of_level("critical")) > 0, "critical").when(F.count_if(of_level("warn")) > 0, "warn").otherwise("none").alias("severity"),
        n("target_correlation").alias("n_high_corr"), n("name_token").alias("n_temporal"), total("duplicate_keys").alias("duplicate_key_count"),
        n("id_in_features").alias("n_id_leaks"), total("month_format").alias("invalid_months"), n("dominance").alias("n_dominance"),
        F.array_join(F.array_sort(F.collect_set(drop)), ", ").alias("drop_recommendations"))
