"""Tail probabilities as Spark columns, with DuckDB twins for the oracles.

Spark has no gamma, beta or error function, so they are folds over a fixed number of steps: the regularised
incomplete gamma function by its series and its continued fraction, the incomplete beta function by its continued
fraction, log-gamma by Stirling's series. A row's arithmetic stays in the JVM; nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 400
_SHIFT = 10
# The coefficients of Stirling's series.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: What a continued fraction has in place of 0.
_TINY = 1e-300


def _d(x) -> Column:
    return (F.lit(float(x)) if isinstance(x, (int, float)) else x).cast("double")


def _rest(z: Column) -> Column:
    """log Gamma(z) - ((z - 1/2) log z - z + log(2 pi) / 2): Stirling's series, small z shifted up first."""
    up = z + _SHIFT
    series = sum((F.lit(c) / F.pow(up, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))
    product = F.lit(1.0)
    for k in range(_SHIFT):
        product = product * (z + k)
    shifted = (up - 0.5) * F.ln(up) - up + series - F.ln(product) - ((z - 0.5) * F.ln(z) - z)
    return F.when(z > 30, sum((F.lit(c) / F.pow(z, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))).otherwise(shifted)


def log_gamma(z: Column) -> Column:
    """log Gamma(z) for z > 0."""
    z = _d(z)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + _rest(z)


def log_beta(a: Column, b: Column) -> Column:
    """log B(a, b); large arguments do not cancel."""
    a, b = _d(a), _d(b)
    n = a + b
    return a * F.log1p(-b / n) + b * F.log1p(-a / n) + 0.5 * F.ln(2 * math.pi * n / (a * b)) + _rest(a) + _rest(b) - _rest(n)


def _some(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def gamma_q(a: Column | float, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x); null where x is null or NaN or a is not above 0."""
    a, x = _d(a), _d(x)
    sure = x.isNotNull() & ~F.isnan(x) & (a > 0)
    a = F.when(sure, a).otherwise(1.0)
    steps = F.sequence(F.lit(1), F.lit(STEPS))
    low = F.aggregate(steps, F.struct((1.0 / a).alias("term"), (1.0 / a).alias("total")),
                      lambda s, k: F.struct((s.term * x / (a + k)).alias("term"), (s.total + s.term * x / (a + k)).alias("total")), lambda s: s.total)
    first = 1.0 / _some(x + 1.0 - a)

    def fraction(s, k):
        b, top = x + 1.0 - a + 2.0 * k, -k * (k - a)
        d, c = 1.0 / _some(top * s.d + b), _some(b + top / s.c)
        return F.struct(c.alias("c"), d.alias("d"), (s.h * c * d).alias("h"))
    high = F.aggregate(steps, F.struct(F.lit(1 / _TINY).alias("c"), first.alias("d"), first.alias("h")), fraction, lambda s: s.h)
    front = F.exp(-x + a * F.ln(x) - log_gamma(a))
    return (F.when(F.coalesce(~sure, F.lit(True)), F.lit(None).cast("double")).when(x <= 0, F.lit(1.0))
            .when(x < a + 1.0, F.lit(1.0) - low * front).otherwise(high * front))


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    return gamma_q(_d(dof) / 2.0, _d(statistic) / 2.0)


def normal_two_sided(z: Column) -> Column:
    """2 (1 - Phi(z)), at most 1."""
    z = _d(z)
    return F.when(z <= 0, F.lit(1.0)).otherwise(gamma_q(0.5, z * z / 2.0))


def with_t_two_sided(df: DataFrame, tails: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with two-sided p-values of Student's t: per new column, the columns of t and of its degrees of freedom.

    Null where t is null or NaN or there are no degrees of freedom. p is the regularised incomplete beta function
    I_x(dof / 2, 1 / 2) at x = dof / (dof + t^2), by its continued fraction on the side where that converges fast. Each
    step's values are columns before the next step reads them, so that the fold holds no whole formulas.
    """
    steps: list[dict[str, Column]] = [{}, {}, {}]
    for name, (t, dof) in tails.items():
        t, dof = _d(F.col(t)), _d(F.col(dof))
        sure = F.coalesce(t.isNotNull() & ~F.isnan(t) & (dof > 0), F.lit(False))
        square, n = F.when(sure, t * t).otherwise(0.0), F.when(sure, dof).otherwise(1.0)
        c = lambda part, name=name: F.col(f"_{part} {name}")
        steps[0] |= {f"_sure {name}": sure, f"_a {name}": n / 2.0, f"_x {name}": n / (n + square), f"_y {name}": square / (n + square)}
        swap = c("x") >= (c("a") + 1.0) / (c("a") + 2.5)
        steps[1] |= {f"_swap {name}": swap, f"_p {name}": F.when(swap, 0.5).otherwise(c("a")), f"_q {name}": F.when(swap, c("a")).otherwise(0.5),
                     f"_t {name}": F.when(swap, c("y")).otherwise(c("x")),
                     f"_front {name}": F.exp(c("a") * F.ln(c("x")) + 0.5 * F.ln(c("y")) - log_beta(c("a"), F.lit(0.5)))}
        part = c("front") * _beta_fraction(c("p"), c("q"), c("t")) / c("p")
        steps[2] |= {name: F.when(~c("sure"), F.lit(None).cast("double")).when(c("y") <= 0, 1.0).when(c("x") <= 0, 0.0).when(c("swap"), 1.0 - part).otherwise(part)}
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.select(*df.columns, *tails)


def _beta_fraction(p: Column, q: Column, t: Column) -> Column:
    first = 1.0 / _some(1.0 - (p + q) * t / (p + 1.0))

    def fraction(s, k):
        even = k * (q - k) * t / ((p - 1.0 + 2.0 * k) * (p + 2.0 * k))
        d, c = 1.0 / _some(1.0 + even * s.d), _some(1.0 + even / s.c)
        odd = -(p + k) * (p + q + k) * t / ((p + 2.0 * k) * (p + 1.0 + 2.0 * k))
        d2, c2 = 1.0 / _some(1.0 + odd * d), _some(1.0 + odd / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (s.h * d * c * d2 * c2).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), fraction, lambda s: s.h)


def rank_sum_exact(u: Column, n1: Column, n2: Column) -> Column:
    """Exact two-sided p of Mann-Whitney's U (of either sample) without ties.

    The number of orders with each U are the coefficients of the Gaussian binomial, the product over i to n1 of
    (1 - q^(n2 + i)) / (1 - q^i): a fold over i that subtracts a shifted copy and sums with stride i.
    """
    n1, n2 = n1.cast("int"), n2.cast("int")
    small, other = F.least(n1, n2), F.greatest(n1, n2)
    top = small * other

    def factor(counts, i):
        less = F.transform(counts, lambda c, k: c - F.when(k >= other + i, F.get(counts, k - other - i)).otherwise(0.0))
        return F.transform(less, lambda _, k: F.aggregate(F.sequence(k % i, k, i), F.lit(0.0), lambda s, j: s + F.get(less, j)))
    first = F.transform(F.sequence(F.lit(0), top), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), small), first, factor)
    least = F.least(u, top - u)
    tail = F.aggregate(F.slice(counts, 1, F.floor(least).cast("int") + 1), F.lit(0.0), lambda s, c: s + c)
    every = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    return F.least(F.lit(1.0), 2.0 * tail / every)


# ---------------------------------------------------------------- the same for the oracles
def gamma_q_sql(name: str, source: str, keys: Sequence[str], a: str, x: str) -> str:
    """CTEs (for WITH RECURSIVE) that end in ``name``: keys and ``q``, Q(a, x) of every row of ``source``."""
    k = ", ".join(keys)
    b = "(x + 1 - a + 2 * (k + 1))"
    top = "(-(k + 1) * (k + 1 - a))"
    return f"""{name}_steps AS (
  SELECT {k}, CAST({a} AS DOUBLE) AS a, CAST({x} AS DOUBLE) AS x, 0 AS k, 1 / CAST({a} AS DOUBLE) AS term, 1 / CAST({a} AS DOUBLE) AS total,
         CAST(1e300 AS DOUBLE) AS c, 1 / CAST({x} + 1 - {a} AS DOUBLE) AS d, 1 / CAST({x} + 1 - {a} AS DOUBLE) AS h FROM {source}
  UNION ALL
  SELECT {k}, a, x, k + 1, term * x / (a + k + 1), total + term * x / (a + k + 1), {b} + {top} / c, 1 / ({top} * d + {b}),
         h * ({b} + {top} / c) / ({top} * d + {b}) FROM {name}_steps WHERE k < {STEPS}),
{name} AS (SELECT {k}, CASE WHEN x <= 0 THEN 1.0 WHEN x < a + 1 THEN 1 - total * EXP(-x + a * LN(x) - LGAMMA(a)) ELSE h * EXP(-x + a * LN(x) - LGAMMA(a)) END AS q
  FROM {name}_steps WHERE k = {STEPS})"""


def t_two_sided_sql(name: str, source: str, keys: Sequence[str], t: str, dof: str) -> str:
    """CTEs (for WITH RECURSIVE) that end in ``name``: keys and ``p``, the two-sided p of every row of ``source``."""
    k = ", ".join(keys)
    even = "((k + 1) * (q - k - 1) * t / ((p + 1 + 2 * k) * (p + 2 + 2 * k)))"
    odd = "(-(p + k + 1) * (p + q + k + 1) * t / ((p + 2 + 2 * k) * (p + 3 + 2 * k)))"
    return f"""{name}_in AS (SELECT {k}, CAST({dof} AS DOUBLE) / 2 AS a, CAST({dof} / ({dof} + {t} * {t}) AS DOUBLE) AS x, CAST({t} * {t} / ({dof} + {t} * {t}) AS DOUBLE) AS y FROM {source}),
{name}_side AS (SELECT *, x >= (a + 1) / (a + 2.5) AS swapped FROM {name}_in),
{name}_steps AS (
  SELECT {k}, a, x, y, swapped, CASE WHEN swapped THEN 0.5 ELSE a END AS p, CASE WHEN swapped THEN a ELSE 0.5 END AS q, CASE WHEN swapped THEN y ELSE x END AS t,
         0 AS k, CAST(1 AS DOUBLE) AS c, 1 / (1 - (a + 0.5) * CASE WHEN swapped THEN y / 1.5 ELSE x / (a + 1) END) AS d,
         1 / (1 - (a + 0.5) * CASE WHEN swapped THEN y / 1.5 ELSE x / (a + 1) END) AS h FROM {name}_side
  UNION ALL
  SELECT {k}, a, x, y, swapped, p, q, t, k + 1, 1 + {odd} / c1, 1 / (1 + {odd} * d1), h * c1 * d1 * (1 + {odd} / c1) / (1 + {odd} * d1)
  FROM (SELECT *, 1 + {even} / c AS c1, 1 / (1 + {even} * d) AS d1 FROM {name}_steps WHERE k < {STEPS}) s),
{name} AS (SELECT {k}, CASE WHEN swapped THEN 1 - f ELSE f END AS p FROM (
  SELECT *, EXP(a * LN(x) + 0.5 * LN(y) + LGAMMA(a + 0.5) - LGAMMA(a) - LGAMMA(0.5)) * h / p AS f FROM {name}_steps WHERE k = {STEPS}) z)"""
