"""Model inputs: column typing, codes, median fill, standardizing (M1-M3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.operators.quantiles import grouped_quantiles, melt
from tenure.operators.ranking import global_rank

NUMERIC_MIN_DISTINCT = 20
#: A sketch that estimates more saw more than 100 values.
MANY_DISTINCT = 150
BROADCAST_CODES = 100_000


def column_kinds(df: DataFrame, cols: Sequence[str], hints: Sequence[str] = (),
                 min_distinct: int = NUMERIC_MIN_DISTINCT) -> dict[str, str]:
    """M1: numeric when an int/float column has more than 20 distinct values (or is hinted);
    booleans, strings and low-cardinality numbers are categorical.

    One pass sketches all columns, a second counts exactly those that may have few values: up to 100 values fill at most
    100 of the sketch's 512 registers, and its estimate then is the linear count of those, below 112."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    numeric_type = [c for c in cols if isinstance(types[c], (T.IntegerType, T.LongType, T.DoubleType, T.FloatType))]
    counts = {}
    if numeric_type and min_distinct <= 100:
        rough = df.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in numeric_type]).first()
        counts = {c: n for c, n in rough.asDict().items() if n > MANY_DISTINCT}
    if few := [c for c in numeric_type if c not in counts]:
        counts |= df.agg(*[F.countDistinct(c).alias(c) for c in few]).first().asDict()
    out = {}
    for c in cols:
        if c in numeric_type and (counts[c] > min_distinct or c in hints):
            out[c] = "numeric"
        else:
            out[c] = "categorical"
    return out


def code_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value text, code): codes are positions of the distinct non-null values in their
    natural order (numbers numerically, text by code point). Columns here are categorical
    by M1, so at most 20 numeric values or a bounded set of labels each."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, code int")
    types = dict((f.name, f.dataType) for f in df.schema.fields)

    def item(c):
        v = F.col(c)
        num = v.cast("double") if isinstance(types[c], (T.NumericType, T.BooleanType)) else F.lit(None).cast("double")
        txt = F.lit(None).cast("string") if isinstance(types[c], (T.NumericType, T.BooleanType)) else v.cast("string")
        return F.struct(F.lit(c).alias("column"), v.cast("string").alias("value"), num.alias("k"), txt.alias("t"))
    long = df.select(F.explode(F.array(*[item(c) for c in cols])).alias("_i")).select("_i.*") \
             .filter(F.col("value").isNotNull()).distinct()
    ranked = global_rank(long, ["k", "t"], group_cols=["column"], rank_col="_r")
    return ranked.select("column", "value", (F.col("_r") - 1).cast("int").alias("code"))


def apply_codes(df: DataFrame, cols: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """M2 codes: value -> code, null (or a value unseen in the dictionary) -> -1.

    A column's dictionary is broadcast up to ``BROADCAST_CODES`` values; a longer one (an id or title passed as a
    category) is left to the planner, which joins it by a shuffle with skewed partitions split.
    """
    if not cols:
        return df
    sizes = {r["column"]: r["n"] for r in dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for c in cols:
        d = dictionary.filter(F.col("column") == c) \
                      .select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_code_{c}"))
        if sizes.get(c, 0) <= BROADCAST_CODES:
            d = F.broadcast(d)
        out = out.join(d, F.col(c).cast("string") == F.col(f"_v_{c}"), "left") \
                 .withColumn(c, F.coalesce(F.col(f"_code_{c}"), F.lit(-1))).drop(f"_v_{c}", f"_code_{c}")
    return out


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column (one distributed pass for all columns)."""
    if not cols:
        return {}
    q = grouped_quantiles(melt(df, cols, "column", "value"), "value", [0.5], ["column"]).collect()
    got = {r["column"]: r["q"] for r in q}
    return {c: got.get(c) for c in cols}


def median_fill(df: DataFrame, cols: Sequence[str], fitted: dict[str, float | None] | None = None) -> DataFrame:
    """M2 impute: nulls -> the column median (fitted on ``df`` unless given, e.g. from the train split)."""
    med = fitted if fitted is not None else medians(df, cols)
    out = df
    for c in cols:
        if med.get(c) is not None:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))))
        else:
            out = out.withColumn(c, F.col(c).cast("double"))
    return out


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """M3 fit: mean and population standard deviation (ddof 0) per column, in one aggregate."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: Sequence[str], fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """M3 apply: (x - mean) / sd with sd = 0 treated as 1 (as a standard scaler does)."""
    st = fitted if fitted is not None else scaler_stats(df, cols)
    out = df
    for c in cols:
        m, s = st[c]
        s = s if s else 1.0
        out = out.withColumn(c, (F.col(c).cast("double") - F.lit(float(m or 0.0))) / F.lit(float(s)))
    return out
