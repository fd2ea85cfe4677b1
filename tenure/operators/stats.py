"""Hypothesis tests and effect sizes.

Each test reduces the data to a handful of numbers per column (counts,
moments, rank sums, contingency cells) and turns them into a statistic and a
p-value as columns (``functions.tails``). All columns of a sweep are reduced
together over a long (column, value) form, so the number of jobs does not
grow with the number of columns. The scalar forms are for single results.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions import distributions as dist
from tenure.functions import tails
from tenure.operators.ranking import global_rank, running_sums
from tenure.operators.sampling import hash32

ALPHA = 0.05


# ---------------------------------------------------------------- moments
def group_moments(df: DataFrame, cols: Sequence[str], group_col: str) -> DataFrame:
    """(column, group, n, mean, var (ddof 1), skew (biased), kurt (non-excess)) for every column."""
    long = df.select(group_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_kv")) \
        .select("_kv.column", F.col(group_col).alias("group"), "_kv.value")
    return (long.filter(F.col("value").isNotNull() & F.col("group").isNotNull())
                .groupBy("column", "group")
                .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                     F.var_samp("value").alias("var"), F.skewness("value").alias("skew"),
                     (F.kurtosis("value") + 3.0).alias("kurt")))


def welch_t(m0: Mapping, m1: Mapping) -> tuple[float, float]:
    """Welch t statistic (group 0 minus group 1) and two-sided p."""
    se2 = m0["var"] / m0["n"] + m1["var"] / m1["n"]
    t = (m0["mean"] - m1["mean"]) / math.sqrt(se2) if se2 > 0 else float("nan")
    dof = se2 ** 2 / ((m0["var"] / m0["n"]) ** 2 / (m0["n"] - 1) + (m1["var"] / m1["n"]) ** 2 / (m1["n"] - 1)) \
        if se2 > 0 else float("nan")
    return t, dist.t_two_sided_p(t, dof)


def pooled_t(m0: Mapping, m1: Mapping) -> tuple[float, float]:
    """Equal-variance t statistic and two-sided p."""
    n0, n1 = m0["n"], m1["n"]
    sp2 = ((n0 - 1) * m0["var"] + (n1 - 1) * m1["var"]) / (n0 + n1 - 2)
    se = math.sqrt(sp2 * (1.0 / n0 + 1.0 / n1))
    t = (m0["mean"] - m1["mean"]) / se if se > 0 else float("nan")
    return t, dist.t_two_sided_p(t, n0 + n1 - 2)


def cohens_d(a: Mapping, b: Mapping) -> float:
    """(mean_a - mean_b) / pooled sd (ddof 1); 0 when the pooled sd is 0."""
    na, nb = a["n"], b["n"]
    pooled = math.sqrt(((na - 1) * a["var"] + (nb - 1) * b["var"]) / (na + nb - 2))
    return (a["mean"] - b["mean"]) / pooled if pooled > 0 else 0.0


def moments_table(df: DataFrame, cols: Sequence[str], group_col: str) -> DataFrame:
    """T1/T2/T8 as a DataFrame: per column n, mean, var by group, Welch t, pooled t, their two-sided p, Cohen's d (1 vs 0).

    Without variance in both groups t and p are null.
    """
    m = group_moments(df, cols, group_col)
    g0 = m.filter(F.col("group") == 0).select("column", *[F.col(c).alias(f"{c}0") for c in ("n", "mean", "var")])
    g1 = m.filter(F.col("group") == 1).select("column", *[F.col(c).alias(f"{c}1") for c in ("n", "mean", "var")])
    j = g0.join(g1, "column", "inner")
    se2 = F.col("var0") / F.col("n0") + F.col("var1") / F.col("n1")
    sp2 = F.try_divide((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1"), F.col("n0") + F.col("n1") - 2)
    part0, part1 = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    dof = F.try_divide(se2 * se2, F.try_divide(part0 * part0, F.col("n0") - 1) + F.try_divide(part1 * part1, F.col("n1") - 1))
    pooled = F.sqrt(sp2 * (1.0 / F.col("n0") + 1.0 / F.col("n1")))
    t = j.select("column", "n0", "n1", "mean0", "mean1", "var0", "var1",
                 F.try_divide(F.col("mean0") - F.col("mean1"), F.sqrt(se2)).alias("welch_t"), dof.alias("welch_dof"),
                 F.try_divide(F.col("mean0") - F.col("mean1"), pooled).alias("pooled_t"),
                 F.when(sp2 > 0, F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(sp2))).otherwise(0.0).alias("cohens_d"))
    t = t.withColumn("pooled_dof", (F.col("n0") + F.col("n1") - 2).cast("double"))
    return tails.with_t_two_sided(t, {"welch_p": ("welch_t", "welch_dof"), "pooled_p": ("pooled_t", "pooled_dof")})


# ---------------------------------------------------------------- normality
def normality(moments: Mapping) -> tuple[float, float] | None:
    """D'Agostino K2 (statistic, p) from n / skew / kurt; None when it cannot be computed."""
    try:
        return dist.dagostino_k2(int(moments["n"]), float(moments["skew"]), float(moments["kurt"]))
    except (ValueError, ZeroDivisionError, TypeError):
        return None


def normality_columns(moments: DataFrame) -> DataFrame:
    """T3 as columns: ``group_moments`` rows with ``k2`` and ``p_value`` (null below 8 rows or without variance).

    K2 is the sum of two squared normal scores, Johnson's SU of the skewness and Anscombe and Glynn's cube root of
    the kurtosis; with two degrees of freedom its tail is exp(-K2 / 2).
    """
    n, y, b2 = F.col("n").cast("double"), F.col("skew"), F.col("kurt")
    y = y * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    spread = F.sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1
    by_skew = F.asinh(F.when(y == 0, 1.0).otherwise(y) * F.sqrt((spread - 1) / 2)) / F.sqrt(F.ln(spread) / 2)
    x = (b2 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    lean = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / lean * (2 / lean + F.sqrt(1 + 4 / (lean * lean)))
    under = F.nullif(1 + x * F.sqrt(2 / (a - 4)), F.lit(0.0))
    by_kurt = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / under)) / F.sqrt(2 / (9 * a))
    defined = (F.col("n") >= 8) & F.col("skew").isNotNull() & ~F.isnan("skew") & ~F.isnan("kurt")
    out = moments.withColumn("k2", F.when(defined, by_skew * by_skew + by_kurt * by_kurt))
    return out.withColumn("p_value", F.exp(-F.col("k2") / 2))


# ---------------------------------------------------------------- Mann-Whitney
def rank_sums(long: DataFrame, split_col: str = "is_pos", value_col: str = "value",
              group_cols: Sequence[str] = ("column",)) -> DataFrame:
    """Per group, n_pos, n_neg, sum of average ranks of the positives, and the tie term sum(t^3 - t).

    Values are first counted per distinct value (hot values collapse), ranks
    come from a distributed running sum of those counts.
    """
    groups = list(group_cols)
    vc = (long.filter(F.col(value_col).isNotNull() & F.col(split_col).isNotNull())
              .groupBy(*groups, F.col(value_col).alias("_v"))
              .agg(F.count_if(F.col(split_col)).alias("_c1"), F.count_if(~F.col(split_col)).alias("_c0"))
              .withColumn("_t", F.col("_c1") + F.col("_c0")))
    cum = running_sums(vc, ["_v"], ["_t"], group_cols=groups)
    avg_rank = (F.col("cum__t") - F.col("_t")).cast("double") + (F.col("_t") + 1).cast("double") / 2.0
    return cum.groupBy(*groups).agg(
        F.sum("_c1").alias("n_pos"), F.sum("_c0").alias("n_neg"),
        F.sum(F.col("_c1").cast("double") * avg_rank).alias("rank_sum_pos"),
        F.sum(F.pow(F.col("_t").cast("double"), 3) - F.col("_t").cast("double")).alias("tie_term"))


def mann_whitney_from(n1: float, n2: float, r1: float, tie: float) -> tuple[float, float, float]:
    """T4: (U for the first sample, z, two-sided p), tie-corrected normal with continuity correction."""
    u1 = r1 - n1 * (n1 + 1) / 2.0
    u2 = n1 * n2 - u1
    n = n1 + n2
    mu = n1 * n2 / 2.0
    s = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - tie / (n * (n - 1)))) if n > 1 else 0.0
    u = max(u1, u2)
    z = (u - mu - 0.5) / s if s > 0 else float("nan")
    p = min(1.0, 2.0 * dist.norm_sf(z)) if s > 0 else float("nan")
    return u1, z, p


#: Without ties U has an exact distribution: used where a sample has at most ``EXACT_ROWS`` rows, as the usual automatic
#: choice has it, and the distribution at most ``EXACT_SUMS`` values; else it is close to normal.
EXACT_ROWS = 8
EXACT_SUMS = 4096


def mann_whitney_columns(sums: DataFrame) -> DataFrame:
    """T4/T5: rows of ``rank_sums`` with u_pos, z, rank_biserial and the two-sided p_value (exact for small samples without ties).

    The statistics are columns before the p-value is taken from them, so that its folds read values, not whole formulas.
    """
    n1, n2, tie = F.col("n_pos").cast("double"), F.col("n_neg").cast("double"), F.col("tie_term")
    out = sums.withColumn("u_pos", F.col("rank_sum_pos") - n1 * (n1 + 1) / 2.0)
    n = n1 + n2
    s = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(tie, n * (n - 1))))
    z = F.try_divide(F.greatest(F.col("u_pos"), n1 * n2 - F.col("u_pos")) - n1 * n2 / 2.0 - 0.5, s)
    out = out.withColumns({"z": z, "rank_biserial": F.try_divide(2.0 * F.col("u_pos"), n1 * n2) - 1.0})
    small = F.least(n1, n2).between(1, EXACT_ROWS) & (n1 * n2 <= EXACT_SUMS) & (tie == 0)
    out = out.withColumns({"_small": small, "_half": F.when(F.col("z") > 0, F.col("z") * F.col("z") / 2.0)})
    pick = lambda c, other: F.when(F.col("_small"), F.col(c)).otherwise(F.lit(other))
    # where the exact form does not apply it gets the smallest case, so that nothing is counted
    out = out.withColumns({"_u": pick("u_pos", 0.0), "_a": pick("n_pos", 1), "_b": pick("n_neg", 1)})
    p = F.when(F.col("_small"), tails.rank_sum_exact(F.col("_u"), F.col("_a"), F.col("_b"))).when(F.col("z") <= 0, 1.0).otherwise(tails.gamma_q(0.5, F.col("_half")))
    return out.withColumn("p_value", p).drop("_small", "_half", "_u", "_a", "_b")


def rank_biserial(u: float, n1: float, n2: float) -> float:
    """T5: 2U / (n1 n2) - 1."""
    return 2.0 * u / (n1 * n2) - 1.0


# ---------------------------------------------------------------- chi-square
def contingency(df: DataFrame, cols: Sequence[str], group_col: str) -> DataFrame:
    """(column, value, group, cnt) for categorical columns; nulls excluded (as a crosstab does)."""
    long = df.select(F.col(group_col).alias("group"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_kv")) \
        .select("_kv.column", "_kv.value", "group")
    return long.filter(F.col("value").isNotNull() & F.col("group").isNotNull()) \
               .groupBy("column", "value", "group").agg(F.count(F.lit(1)).alias("cnt"))


def chi_square(table: np.ndarray, correction: bool = True) -> tuple[float, int, float]:
    """Pearson chi-square (Yates-corrected when dof == 1), dof, p."""
    obs = np.asarray(table, dtype=float)
    n = obs.sum()
    expected = np.outer(obs.sum(axis=1), obs.sum(axis=0)) / n
    dof = (obs.shape[0] - 1) * (obs.shape[1] - 1)
    if dof == 1 and correction:
        diff = expected - obs
        obs = obs + np.minimum(0.5, np.abs(diff)) * np.sign(diff)
    stat = float(((obs - expected) ** 2 / expected).sum())
    return stat, int(dof), dist.chi2_sf(stat, dof)


def chi_square_columns(counts: DataFrame) -> DataFrame:
    """T6/T7 of every column's crosstab (column, value, group, cnt), as columns: chi2, dof, p_value, n, cramers_v.

    The grid of a column's values and groups holds the empty cells; the sums stay in Spark, whatever the
    number of values. Tables smaller than 2x2 have no row.
    """
    by_value = counts.groupBy("column", "value").agg(F.sum("cnt").alias("rt"))
    by_group = counts.groupBy("column", "group").agg(F.sum("cnt").alias("ct"))
    size = by_value.groupBy("column").agg(F.count(F.lit(1)).alias("r"), F.sum("rt").alias("n")).join(
        by_group.groupBy("column").agg(F.count(F.lit(1)).alias("k")), "column")
    grid = by_value.join(by_group, "column").join(counts, ["column", "value", "group"], "left").join(size, "column").where("r > 1 AND k > 1")
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    expected = F.col("rt").cast("double") * F.col("ct").cast("double") / F.col("n").cast("double")
    gap = F.abs(F.coalesce("cnt", F.lit(0)).cast("double") - F.col("e"))
    gap = gap - F.when(F.col("dof") == 1, F.least(F.lit(0.5), gap)).otherwise(0.0)
    out = grid.withColumns({"dof": dof, "e": expected}).groupBy("column", "dof", "n", "r", "k").agg(F.sum(gap * gap / F.col("e")).alias("chi2"))
    out = out.withColumns({"_a": F.col("dof") / 2.0, "_x": F.col("chi2") / 2.0})
    return out.select("column", "chi2", F.col("dof").cast("long").alias("dof"), F.col("n").cast("long").alias("n"),
                      tails.gamma_q(F.col("_a"), F.col("_x")).alias("p_value"), F.sqrt(F.col("chi2") / F.col("n") / F.least(F.col("r") - 1, F.col("k") - 1)).alias("cramers_v"))


# ---------------------------------------------------------------- sweep
def _numeric_tests(df: DataFrame, group_col: str, cols: Sequence[str], alpha: float, least: int) -> DataFrame:
    """T9, numeric side: Welch's t where both groups are normal, else Mann-Whitney; a row per column."""
    normal = normality_columns(group_moments(df, cols, group_col)).where("group IN (0, 1)").groupBy("column").agg(
        F.bool_and(F.coalesce(F.col("p_value") > alpha, F.lit(False))).alias("normal"))
    split = df.select((F.col(group_col) == 0).alias("is_pos"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("kv"))
    ranks = mann_whitney_columns(rank_sums(split.select("kv.column", "kv.value", "is_pos")))
    table = moments_table(df, cols, group_col).where((F.col("n0") >= least) & (F.col("n1") >= least)).join(normal, "column")
    table = table.join(ranks.select("column", F.col("u_pos").alias("u"), F.col("p_value").alias("u_p")), "column")
    pick = lambda a, b: F.when(F.col("normal"), F.col(a)).otherwise(F.col(b))
    return table.select("column", F.when(F.col("normal"), "t-test").otherwise("Mann-Whitney U").alias("test"), pick("welch_t", "u").alias("statistic"),
                        pick("welch_p", "u_p").alias("p_value"), F.coalesce("cohens_d", F.lit(0.0)).alias("effect"), "mean0", "mean1")


def eda_sweep(df: DataFrame, group_col: str, numeric: Sequence[str], categorical: Sequence[str], alpha: float = ALPHA,
              min_group: int = 5) -> DataFrame:
    """One test per column, a row each: column, test, statistic, p_value, effect, mean0, mean1, significant.

    Numeric: normality from the moments of all rows; both groups normal -> Welch t, else Mann-Whitney; effect =
    Cohen's d (group 1 minus group 0); groups under ``min_group`` rows are left out. Categorical: chi-square and
    Cramer's V (tables under 2x2 are left out). Bonferroni from 10 tests on, counting columns left out.
    """
    parts = [_numeric_tests(df, group_col, numeric, alpha, min_group)] if numeric else []
    if categorical:
        none = F.lit(None).cast("double")
        parts.append(chi_square_columns(contingency(df, categorical, group_col)).select(
            "column", F.lit("chi2").alias("test"), F.col("chi2").alias("statistic"), "p_value", F.col("cramers_v").alias("effect"), none.alias("mean0"), none.alias("mean1")))
    tests = len(numeric) + len(categorical)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("significant", F.coalesce(F.col("p_value") < (alpha / tests if tests >= 10 else alpha), F.lit(False)))


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "ns"


# ---------------------------------------------------------------- correlation / VIF
def varied_columns(df: DataFrame, cols: Sequence[str]) -> set[str]:
    """The columns with two values or more: ``corr`` divides by zero on the others."""
    row = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in cols]).first()
    return {c for c in cols if row[c]}


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for every pair, in one aggregate (k*(k-1)/2 ``corr`` expressions); null where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    varied = varied_columns(df, cols)
    row = df.agg(*[(F.corr(F.col(a).cast("double"), F.col(b).cast("double")) if {a, b} <= varied else F.max(F.lit(None).cast("double"))).alias(f"{i}")
                   for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}").alias("r"))
                      for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("_p")).select("_p.*")


#: A pivot under this is a column that the others already determine; a residual share under it makes R2 count as 1.
NO_PIVOT = 1e-10
INFINITE_R2 = 0.9999


def vif_columns(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """T12 from correlation pairs (col_a, col_b, r): feature and VIF = 1 / (1 - R2); infinite from an R2 of 0.9999 on.

    For each feature the other columns are swept out of the correlation matrix, the one with the largest remaining
    pivot first; columns without a pivot left (equal columns, constant ones) add nothing. What is left on the
    feature's diagonal is 1 - R2. The matrices are arrays of k x k numbers, one row per feature.
    """
    k, order = len(names), list(names)
    place = lambda c: F.array_position(F.array(*[F.lit(n) for n in order]), F.col(c))
    r = F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0))
    cells = pairs.select(place("col_a").alias("i"), place("col_b").alias("j"), r.alias("r"))
    cells = cells.union(cells.select("j", "i", "r"))
    packed = cells.agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * (k + 1) + F.col("j")).alias("at"), "r"))).alias("cells"))  # k (k - 1) numbers
    at = lambda i, j: F.when(i == j, 1.0).otherwise(F.coalesce(F.try_element_at("cells", (i * (k + 1) + j).cast("long")), F.lit(0.0)))
    every = F.sequence(F.lit(1), F.lit(k))
    matrix = F.transform(every, lambda i: F.transform(every, lambda j: at(i, j)))
    start = packed.select(matrix.alias("m")).select("m", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in order]).alias("feature"), every.alias("own"))).alias("f"))
    start = start.select("m", "f.feature", "f.own")

    def sweep(m, _):
        diagonal = F.transform(every, lambda i: F.when(i == F.col("own"), -1.0).otherwise(F.get(F.get(m, i - 1), i - 1)))
        best = F.array_max(diagonal)
        row = F.get(m, F.array_position(diagonal, best).cast("int") - 1)
        p = F.array_position(diagonal, best).cast("int") - 1
        swept = F.transform(m, lambda line: F.zip_with(line, row, lambda x, y: x - F.get(line, p) * F.try_divide(y, best)))
        return F.when(best > NO_PIVOT, swept).otherwise(m)

    left = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, k - 1))), F.col("m"), sweep, lambda m: F.get(F.get(m, F.col("own") - 1), F.col("own") - 1))
    out = start.select("feature", left.alias("rest"))
    return out.select("feature", F.when(F.col("rest") <= 1 - INFINITE_R2, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col("rest"))).alias("vif"))
