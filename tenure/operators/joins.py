"""Join operators.

Strategy is left to Catalyst + AQE: a side is broadcast only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` (a checked bound), and
sort-merge with AQE skew splitting is used otherwise. The only explicit
``broadcast`` hints in the engine are on tables whose size is fixed by a
parameter (keyword lists, strategy tables) or counted first (category
dictionaries).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.months import next_month


def restrict_to_users(log: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Keep log rows whose user appears in ``users`` (EXISTS, no fan-out)."""
    return log.join(users.select(user_col), user_col, "left_semi")


def multiplicity(rows: DataFrame, user_col: str = "user_id", name: str = "_mult") -> DataFrame:
    """Rows per user in ``rows``: the factor by which a plain inner join (J2) repeats a log row."""
    return rows.groupBy(user_col).agg(F.count(F.lit(1)).alias(name))


def attach(base: DataFrame, extra: DataFrame, keys: list[str] | str,
           fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left join aggregates onto ``base`` and replace misses with defaults.

    ``fill`` maps column -> default (literal or Column). Columns not in ``fill``
    keep nulls for misses.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = base.join(extra, keys, "left")
    for col, default in (fill or {}).items():
        d = default if hasattr(default, "_jc") else F.lit(default)
        out = out.withColumn(col, F.coalesce(F.col(col), d))
    return out


def calendar_lag(base: DataFrame, monthly: DataFrame, value_cols: Iterable[str],
                 user_col: str = "user_id", month_col: str = "p_mt", prefix: str = "lagged_",
                 fill=0) -> DataFrame:
    """Attach the value of the previous *calendar* month.

    The lookup side is shifted one month forward (its month becomes the month
    it is the lag for) and equi-joined on (user, month), so gaps in a user's
    months give the fill value rather than the last existing row, and January
    looks up December of the previous year. Equi-join: shuffles on the key,
    no window over a user's whole history.
    """
    cols = list(value_cols)
    shifted = monthly.select(
        F.col(user_col), next_month(month_col).alias(month_col),
        *[F.col(c).alias(prefix + c) for c in cols])
    return attach(base, shifted, [user_col, month_col], {prefix + c: fill for c in cols})


def with_lag(monthly: DataFrame, value_cols: Iterable[str], lag_cols: Iterable[str], user_col: str = "user_id",
             month_col: str = "p_mt", prefix: str = "lagged_") -> DataFrame:
    """J6/W6 from a single read of ``monthly`` (one row per user and month): a month's values beside those of the
    calendar month before, a row for every (user, month) that has either; the side it lacks is null.

    Each row is given out twice, as its own month and as the next month's lag, and the two meet in one aggregate;
    the input, often an aggregate over the whole log, is not planned a second time as a lookup side.
    """
    cols, lags = list(value_cols), list(lag_cols)
    none = {f.name: F.lit(None).cast(f.dataType) for f in monthly.schema.fields}
    own = F.struct(F.col(month_col), *[F.col(c) for c in cols], *[none[c].alias(prefix + c) for c in lags])
    later = F.struct(next_month(month_col).alias(month_col), *[none[c].alias(c) for c in cols],
                     *[F.col(c).alias(prefix + c) for c in lags])
    rows = monthly.select(user_col, F.explode(F.array(own, later)).alias("_m")).select(user_col, "_m.*")
    return rows.groupBy(user_col, month_col).agg(*[F.max(c).alias(c) for c in [*cols, *[prefix + c for c in lags]]])


def full_outer_fill(left: DataFrame, right: DataFrame, keys: list[str] | str, fill=0) -> DataFrame:
    """Full outer join on ``keys`` with value columns of either side filled."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = left.join(right, keys, "full_outer")
    values = [c for c in out.columns if c not in keys]
    if fill is None:
        return out
    return out.fillna(fill, subset=values)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop replaced rows (anti-join on ``key``), then append the new ones."""
    kept = existing.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
