"""Exact, linearly interpolated quantiles without gathering a column in one task.

``percentile()`` is exact but merges every distinct value of a group into one
aggregation buffer. Here values are first reduced to (group, value, count)
rows, which collapses hot values (most users watch 0 minutes), then a
distributed running sum of the counts gives every value its rank range, and
the wanted ranks are picked by a join-free filter + aggregate. Interpolation
is the one of pandas / ``quantile_cont``: ``lo + (hi - lo) * frac`` at
position ``p * (n - 1)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.operators.ranking import running_sums


def grouped_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups..., p, q): exact quantiles of the non-null values of ``value_col`` per group."""
    groups = list(group_cols)
    v = F.col(value_col).cast("double")
    vc = (df.filter(v.isNotNull() & ~F.isnan(v))
            .groupBy(*groups, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    cum = running_sums(vc, ["_v"], ["_c"], group_cols=groups, total_prefix="n")
    first = F.col("cum__c") - F.col("_c") + 1
    pos = F.col("p") * (F.col("n_c") - 1)
    lo_r = F.floor(pos) + 1
    hi_r = F.ceil(pos) + 1
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    picked = (cum.select(*groups, "_v", first.alias("_first"), F.col("cum__c").alias("_last"), "n_c",
                         F.explode(probs_arr).alias("p"))
                 .filter(((F.col("_first") <= lo_r) & (F.col("_last") >= lo_r))
                         | ((F.col("_first") <= hi_r) & (F.col("_last") >= hi_r))))
    agg = picked.groupBy(*groups, "p").agg(
        F.max(F.when((F.col("_first") <= lo_r) & (F.col("_last") >= lo_r), F.col("_v"))).alias("_lo"),
        F.max(F.when((F.col("_first") <= hi_r) & (F.col("_last") >= hi_r), F.col("_v"))).alias("_hi"),
        F.first(pos - F.floor(pos)).alias("_frac"))
    return agg.select(*groups, "p",
                      F.when(F.col("_frac") == 0, F.col("_lo"))
                       .otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("q"))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Scalar quantiles of one column (a per-column statistic; a few numbers reach the driver)."""
    got = {float(r["p"]): r["q"] for r in grouped_quantiles(df, col, probs).collect()}
    return [got.get(float(p)) for p in probs]


def column_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Scalar quantiles of several columns in one pass: ``{column: [q for each p]}``.

    The columns go to a long (column, value) form and share one running sum,
    so the input is read once however many columns are asked for.
    """
    cols = list(wanted)
    probs = sorted({float(p) for ps in wanted.values() for p in ps})
    rows = grouped_quantiles(melt(df, cols, "column", "value"), "value", probs, ["column"]).collect()
    got = {(r["column"], float(r["p"])): r["q"] for r in rows}
    return {c: [got.get((c, float(p))) for p in wanted[c]] for c in cols}


def exact_median(df: DataFrame, col: str) -> float | None:
    return exact_quantiles(df, col, [0.5])[0]


def melt(df: DataFrame, cols: Sequence[str], name_col: str = "column", value_col: str = "value",
         cast: str = "double") -> DataFrame:
    """Long form of several columns (one row per row x column), for per-column statistics in one pass."""
    items = F.array(*[F.struct(F.lit(c).alias(name_col), F.col(c).cast(cast).alias(value_col)) for c in cols])
    return df.select(F.explode(items).alias("_kv")).select(f"_kv.{name_col}", f"_kv.{value_col}")
