"""The reference's datasets, composed from operators.

* ``churn_v1``       panel rows + per-user view count, time, distinct assets (A2, J4)
* ``churn_v2``       + kids/movie flags, recency, total/log time, OTT flags (A3, A4, F1, F2)
* ``churn_v3``       + trend views, ratio, flag per month (J8, A8, F4)
* ``purchase``       + monthly views by product type and the previous calendar month's paid views (A7, J5, J6, F3)
* ``channel``        log time, adult / free / trend mix and attributes per user-month (A9, F5)
* ``panel_monthly``  panel rows + that month's activity, zeros for misses (J13)

``fanout=True`` reproduces the reference's join of the log to a panel with
several rows per user (trap 1); the default counts each event once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.numeric import fix, ratio
from tenure.operators import activity as act
from tenure.operators.joins import attach, with_lag
from tenure.operators.sampling import seeded_sample

V1_COLS = ("vod_view_cnt", "vod_use_tms_sum", "vod_asset_cnt")


def churn_v1(panel_rows: DataFrame, log: DataFrame, fanout: bool = False,
             user_col: str = "user_id") -> DataFrame:
    # the left join onto the panel rows keeps panel users only, so the aggregate needs no
    # semi-join of its own (which would build the panel a second time)
    a2 = act.user_activity(log, user_col=user_col, fanout=fanout, user_rows=panel_rows)
    return attach(panel_rows, a2, user_col, {c: 0 for c in V1_COLS}) \
        .select(*panel_rows.columns, *[F.col(c).cast("bigint").alias(c) for c in V1_COLS])


def churn_v2(v1: DataFrame, log: DataFrame, ref_date: str, no_event: int = 999, fanout: bool = False,
             user_col: str = "user_id", ott_col: str = "ott_yn") -> DataFrame:
    fr = act.flags_and_recency(log, ref_date, user_col=user_col, fanout=fanout, user_rows=v1)
    out = attach(v1, fr, user_col, {"flag_kids": 0, "flag_movie": 0, "recency": no_event,
                                    "total_watch_time": F.col("vod_use_tms_sum")})
    ott = F.col(ott_col)
    return out.select(
        *v1.columns, "flag_kids", "flag_movie", "recency", "total_watch_time",
        fix(F.log(F.lit(1.0) + F.col("total_watch_time"))).alias("log_watch_time"),
        F.when(ott, 1).otherwise(0).alias("is_ott"),
        F.when((F.coalesce(F.col("flag_kids"), F.lit(0)) == 1) & ott, 1).otherwise(0).alias("risk_kids_ott"))


def churn_v1v2(panel_rows: DataFrame, log: DataFrame, ref_date: str, no_event: int = 999, fanout: bool = False,
               user_col: str = "user_id", ott_col: str = "ott_yn") -> DataFrame:
    """``churn_v2(churn_v1(...))`` from a single aggregation pass over the log (same columns and values)."""
    # attached by a left join from the panel rows: no separate semi-join to the panel users
    feats = act.user_features(log, ref_date, user_col=user_col, fanout=fanout, user_rows=panel_rows)
    out = attach(panel_rows, feats, user_col, {c: 0 for c in V1_COLS})
    out = out.select(*panel_rows.columns, *[F.col(c).cast("bigint").alias(c) for c in V1_COLS],
                     F.coalesce(F.col("flag_kids"), F.lit(0)).alias("flag_kids"),
                     F.coalesce(F.col("flag_movie"), F.lit(0)).alias("flag_movie"),
                     F.coalesce(F.col("recency"), F.lit(no_event)).alias("recency"),
                     F.coalesce(F.col("total_watch_time"), F.col("vod_use_tms_sum")).alias("total_watch_time"))
    ott = F.col(ott_col)
    return out.select(
        "*", fix(F.log(F.lit(1.0) + F.col("total_watch_time"))).alias("log_watch_time"),
        F.when(ott, 1).otherwise(0).alias("is_ott"),
        F.when((F.col("flag_kids") == 1) & ott, 1).otherwise(0).alias("risk_kids_ott"))


def churn_v3(base: DataFrame, log: DataFrame, trend_assets: DataFrame, start: int, end: int,
             user_col: str = "user_id", month_col: str = "p_mt") -> DataFrame:
    users = base.select(user_col)
    tc = act.monthly_trend_counts(log, trend_assets, start, end, users=users, user_col=user_col,
                                  month_col=month_col)
    out = attach(base, tc, [user_col, month_col], {"trend_watch_cnt": 0, "total_vod_cnt": 0})
    return out.select(
        *base.columns,
        F.col("trend_watch_cnt").cast("bigint").alias("trend_watch_cnt"),
        ratio("trend_watch_cnt", "total_vod_cnt").alias("trend_watch_ratio"),
        F.when(F.col("trend_watch_cnt") > 0, 1).otherwise(0).cast("int").alias("trend_flag"))


def purchase(base: DataFrame, log: DataFrame, catalog: DataFrame, start: int, end: int,
             user_col: str = "user_id", month_col: str = "p_mt") -> DataFrame:
    """Purchase panel: target = paid views that month; feature = paid views the calendar month before."""
    users = base.select(user_col)
    monthly = act.monthly_counts_by_type(log, catalog, start, end, users=users, user_col=user_col,
                                         month_col=month_col)
    types = ("fod_cnt", "rvod_cnt", "svod_cnt")
    both = with_lag(monthly, types, ["rvod_cnt"], user_col, month_col)
    lagged = attach(base, both, [user_col, month_col], {c: 0 for c in (*types, "lagged_rvod_cnt")})
    return lagged.select(*base.columns,
                         *[F.col(c).cast("bigint").alias(c) for c in ("fod_cnt", "rvod_cnt", "svod_cnt")],
                         F.col("rvod_cnt").cast("bigint").alias("vod_purchase_cnt"),
                         F.col("lagged_rvod_cnt").cast("bigint").alias("lagged_rvod_cnt"))


def channel(base: DataFrame, log: DataFrame, catalog: DataFrame, trend_assets: DataFrame,
            user_totals: DataFrame, start: int, end: int, y_col: str,
            attributes: Mapping[str, float] | None = None, adult_col: str | None = "adult_yn",
            sample_n: int | None = None, seed: int = 42, user_col: str = "user_id",
            month_col: str = "p_mt") -> DataFrame:
    """Channel-viewing dataset (F5): y plus log time, adult / free / trend shares.

    ``user_totals`` carries the whole-log ``vod_use_tms_sum`` per user (v1).
    ``attributes`` maps extra base columns to their fill value after a safe
    cast to double. ``sample_n`` draws a seeded fixed-size sample of the base
    first (L3); ``None`` keeps every row.
    """
    rows = base.filter(F.col(month_col).between(start, end) & F.col(y_col).isNotNull())
    if sample_n is not None:
        rows = seeded_sample(rows, sample_n, [user_col, month_col], seed)
    users = rows.select(user_col)
    mix = act.content_mix(log, catalog, trend_assets, start, end, users=users, user_col=user_col,
                          adult_col=adult_col, month_col=month_col)
    out = rows.join(mix, [user_col, month_col], "left") \
              .join(user_totals.select(user_col, "vod_use_tms_sum"), user_col, "left")
    attrs = dict(attributes or {})
    return out.select(
        user_col, month_col, F.col(y_col).alias("y"),
        fix(F.log(F.lit(1.0) + F.coalesce(F.col("vod_use_tms_sum"), F.lit(0)))).alias("log_vod_time"),
        ratio("adult_cnt", "total_cnt").alias("adult"),
        ratio("fod_tms", "total_tms").alias("fod"),
        ratio(F.coalesce(F.col("trend_cnt"), F.lit(0)), "total_cnt").alias("trend"),
        *[F.coalesce(F.col(c).try_cast("double"), F.lit(float(v))).alias(c) for c, v in attrs.items()])


def panel_monthly(panel_rows: DataFrame, monthly: DataFrame | None, user_totals: DataFrame | None = None,
                  user_col: str = "user_id", month_col: str = "p_mt") -> DataFrame:
    """Panel rows with that month's views and time (zeros for misses).

    Without a monthly table the whole-log totals are used instead (the
    reference's fallback), made explicit here as ``monthly=None``.
    """
    if monthly is not None:
        out = attach(panel_rows, monthly.select(user_col, month_col, "vod_view_cnt", "vod_use_tms_sum"),
                     [user_col, month_col], {"vod_view_cnt": 0, "vod_use_tms_sum": 0})
    else:
        out = attach(panel_rows, user_totals.select(user_col, "vod_view_cnt", "vod_use_tms_sum"),
                     user_col, {"vod_view_cnt": 0, "vod_use_tms_sum": 0})
    return out
