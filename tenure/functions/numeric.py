"""Numeric helpers shared by operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fix(col, digits: int = 12) -> Column:
    """Round a double that came out of a floating-point sum to ``digits`` decimals.

    Sums of doubles depend on the order rows are added in, which differs
    between partitions, runs and engines by a unit in the last place. Rounding
    the result to 12 decimals (far below any reported precision) makes it
    reproducible. Same shape as the SQL ``ROUND(x * 1e12) / 1e12`` used in the
    oracles.
    """
    scale = float(10 ** digits)
    # "+ 0.0" turns a negative zero into 0.0 so that both engines print the same value
    return F.round(_c(col) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def fix_sql(expr: str, digits: int = 12) -> str:
    return f"(ROUND(({expr}) * 1e{digits}) / 1e{digits} + CAST(0.0 AS DOUBLE))"


def ratio(num, den, zero: float = 0.0) -> Column:
    """``num / den`` as double, ``zero`` when the denominator is 0 or null."""
    d = _c(den)
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(zero)).otherwise(_c(num).cast("double") / d.cast("double"))


def exact_mean(col) -> Column:
    """Mean of an integer column: exact integer sum divided once (order-independent)."""
    c = _c(col)
    return F.sum(c).cast("double") / F.count(c).cast("double")


def mean(col, digits: int = 12) -> Column:
    """Mean of a double column, reproducible to ``digits`` decimals."""
    return fix(F.avg(_c(col)), digits)


def clip(col, lo=None, hi=None) -> Column:
    c = _c(col)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def fix_sig(col, digits: int = 12) -> Column:
    """Round to ``digits`` significant digits (for statistics whose magnitude varies, e.g. variances).

    Written as scientific-notation text and read back, which both engines do
    the same way (the SQL twin is ``CAST(printf('%.{d-1}e', x) AS DOUBLE)``).
    """
    c = _c(col)
    return F.when(c.isNull() | F.isnan(c), c).otherwise(
        F.format_string(f"%.{digits - 1}e", c).cast("double") + F.lit(0.0))


def fix_sig_sql(expr: str, digits: int = 12) -> str:
    return f"(CAST(printf('%.{digits - 1}e', ({expr})) AS DOUBLE) + CAST(0.0 AS DOUBLE))"
