"""Activity aggregates over the viewing log.

Every aggregate groups first and filters by the user set afterwards (semi-join
on the already-aggregated rows). Grouping first lets Spark combine map-side,
so a user holding a third of the log still sends only one partial row per
map task to the shuffle; the semi-join then works on one row per user or
user-month. Distinct counts use Spark's two-level distinct plan whose first
shuffle is keyed by (user, asset), which spreads a hot user as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.months import key_date, month_of, with_day_key
from tenure.operators.joins import multiplicity, restrict_to_users


def _zero_sum(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def with_month(log: DataFrame, strt_col: str = "strt_dt", month_col: str = "p_mt") -> DataFrame:
    """Derive the int month once from the event time.

    A log that already carries ``month_col`` keeps it: a table stored
    partitioned by month, or a view that derived the month from its source
    timestamp. Such a column must equal the month of ``strt_col`` (null when
    the event time is null); month filters on it then prune partitions and
    cost an int comparison instead of cutting text per event.
    """
    if month_col in log.columns:
        return log
    return log.withColumn(month_col, month_of(strt_col))


def dated(log: DataFrame, strt_col: str = "strt_dt") -> DataFrame:
    """Drop events without a time."""
    return log.filter(F.col(strt_col).isNotNull())


def in_months(log: DataFrame, start: int, end: int, month_col: str = "p_mt") -> DataFrame:
    """Month range filter (partition pruning when the log is partitioned by month)."""
    return log.filter(F.col(month_col).between(start, end))


def user_activity(log: DataFrame, users: DataFrame | None = None, user_col: str = "user_id",
                  asset_col: str = "asset", time_col: str = "use_tms", fanout: bool = False,
                  user_rows: DataFrame | None = None) -> DataFrame:
    """A2: views, total time and distinct assets per user.

    ``fanout=True`` reproduces a plain join of the log to a panel with several
    rows per user (trap 1): counts and sums are multiplied by the user's row
    count in ``user_rows`` while the distinct count is not. The product is
    computed from per-user aggregates, so no row is ever repeated.
    """
    agg = log.groupBy(user_col).agg(
        F.count(F.lit(1)).alias("vod_view_cnt"),
        _zero_sum(time_col).alias("vod_use_tms_sum"),
        F.countDistinct(asset_col).alias("vod_asset_cnt"))
    if fanout:
        rows = user_rows if user_rows is not None else users
        m = multiplicity(rows, user_col)
        return agg.join(m, user_col, "inner").select(
            user_col,
            (F.col("vod_view_cnt") * F.col("_mult")).alias("vod_view_cnt"),
            (F.col("vod_use_tms_sum") * F.col("_mult")).alias("vod_use_tms_sum"),
            "vod_asset_cnt")
    if users is not None:
        agg = restrict_to_users(agg, users, user_col)
    return agg


def flags_and_recency(log: DataFrame, ref_date: str | Column, users: DataFrame | None = None,
                      user_col: str = "user_id", class_col: str = "ct_cl", strt_col: str = "strt_dt",
                      time_col: str = "use_tms", kids_code: int = 14, movie_code: int = 12,
                      fanout: bool = False, user_rows: DataFrame | None = None) -> DataFrame:
    """A3/A4: kids / movie flags, watch time and days since the last event.

    Recency is ``ref_date - last day``, floored at 0; users without events get
    the caller's default when attached (see ``features.churn_v2``).
    """
    ref = F.lit(ref_date).cast("date") if isinstance(ref_date, str) else ref_date
    ev = with_day_key(dated(log, strt_col), strt_col, "_day")
    agg = ev.groupBy(user_col).agg(
        F.max(F.when(F.col(class_col) == kids_code, 1).otherwise(0)).alias("flag_kids"),
        F.max(F.when(F.col(class_col) == movie_code, 1).otherwise(0)).alias("flag_movie"),
        _zero_sum(time_col).alias("total_watch_time"),
        F.datediff(ref, key_date(F.max("_day"))).alias("_recency_raw"))
    agg = agg.withColumn("recency", F.when(F.col("_recency_raw") < 0, 0).otherwise(F.col("_recency_raw"))) \
             .drop("_recency_raw")
    if fanout:
        m = multiplicity(user_rows if user_rows is not None else users, user_col)
        return agg.join(m, user_col, "inner") \
                  .withColumn("total_watch_time", F.col("total_watch_time") * F.col("_mult")).drop("_mult")
    if users is not None:
        agg = restrict_to_users(agg, users, user_col)
    return agg


def monthly_activity(log: DataFrame, start: int, end: int, users: DataFrame | None = None,
                     user_col: str = "user_id", strt_col: str = "strt_dt", time_col: str = "use_tms",
                     month_col: str = "p_mt") -> DataFrame:
    """A5: views and total time per (user, month) inside [start, end]."""
    ev = in_months(with_month(dated(log, strt_col), strt_col, month_col), start, end, month_col)
    agg = ev.groupBy(user_col, month_col).agg(
        F.count(F.lit(1)).alias("vod_view_cnt"),
        _zero_sum(time_col).alias("vod_use_tms_sum"))
    if users is not None:
        agg = restrict_to_users(agg, users, user_col)
    return agg


def _typed_monthly(log: DataFrame, catalog: DataFrame, start: int, end: int, users, user_col,
                   asset_col, id_col, strt_col, month_col) -> DataFrame:
    ev = in_months(with_month(dated(log, strt_col), strt_col, month_col), start, end, month_col)
    cat = catalog.select(F.col(id_col).alias("_cat_id"), F.col("asset_prod").alias("_prod"))
    return ev.join(cat, ev[asset_col] == cat["_cat_id"], "left")


def monthly_time_by_type(log: DataFrame, catalog: DataFrame, start: int, end: int,
                         users: DataFrame | None = None, user_col: str = "user_id",
                         asset_col: str = "asset", id_col: str = "asset_id", time_col: str = "use_tms",
                         strt_col: str = "strt_dt", month_col: str = "p_mt") -> DataFrame:
    """Time per product type (0 free, 1 paid, 2 subscription) and in total.

    Unmatched assets count in the total only.
    """
    ev = _typed_monthly(log, catalog, start, end, users, user_col, asset_col, id_col, strt_col, month_col)

    def by_type(code: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_prod") == code, F.col(time_col)).otherwise(0)), F.lit(0)) \
                .cast("bigint")

    agg = ev.groupBy(user_col, month_col).agg(
        by_type(0).alias("fod_tms"), by_type(1).alias("rvod_tms"), by_type(2).alias("svod_tms"),
        _zero_sum(time_col).alias("total_tms"))
    if users is not None:
        agg = restrict_to_users(agg, users, user_col)
    return agg


def monthly_counts_by_type(log: DataFrame, catalog: DataFrame, start: int, end: int,
                           users: DataFrame | None = None, user_col: str = "user_id",
                           asset_col: str = "asset", id_col: str = "asset_id",
                           strt_col: str = "strt_dt", month_col: str = "p_mt") -> DataFrame:
    """Views per product type per (user, month) (``COUNT(*) FILTER``)."""
    ev = _typed_monthly(log, catalog, start, end, users, user_col, asset_col, id_col, strt_col, month_col)
    agg = ev.groupBy(user_col, month_col).agg(
        F.count_if(F.col("_prod") == 0).alias("fod_cnt"),
        F.count_if(F.col("_prod") == 1).alias("rvod_cnt"),
        F.count_if(F.col("_prod") == 2).alias("svod_cnt"))
    if users is not None:
        agg = restrict_to_users(agg, users, user_col)
    return agg


def monthly_trend_counts(log: DataFrame, trend_assets: DataFrame, start: int, end: int,
                         users: DataFrame | None = None, user_col: str = "user_id",
                         asset_col: str = "asset", strt_col: str = "strt_dt",
                         month_col: str = "p_mt") -> DataFrame:
    """All views and views of that month's trending assets, in one pass.

    ``trend_assets`` is (p_mt, asset_id); the log is left-joined on both keys
    to get a match flag, instead of scanning the log twice.
    """
    ev = in_months(with_month(dated(log, strt_col), strt_col, month_col), start, end, month_col)
    ta = trend_assets.select(F.col(month_col).alias("_t_mt"), F.col("asset_id").alias("_t_asset")) \
                     .distinct().withColumn("_hit", F.lit(True))
    joined = ev.join(ta, (ev[asset_col] == ta["_t_asset"]) & (ev[month_col] == ta["_t_mt"]), "left")
    agg = joined.groupBy(user_col, month_col).agg(
        F.count(F.lit(1)).alias("total_vod_cnt"),
        F.count_if(F.col("_hit")).alias("trend_watch_cnt"))
    if users is not None:
        agg = restrict_to_users(agg, users, user_col)
    return agg


def content_mix(log: DataFrame, catalog: DataFrame, trend_assets: DataFrame, start: int, end: int,
                users: DataFrame | None = None, user_col: str = "user_id", asset_col: str = "asset",
                id_col: str = "asset_id", adult_col: str | None = "adult_yn", time_col: str = "use_tms",
                strt_col: str = "strt_dt", month_col: str = "p_mt") -> DataFrame:
    """Per (user, month) free time, total time, views, adult views, trend views.

    ``adult_col=None`` (catalog without an adult flag) gives adult_cnt = 0.
    """
    ev = in_months(with_month(dated(log, strt_col), strt_col, month_col), start, end, month_col)
    cat_cols = [F.col(id_col).alias("_cat_id"), F.col("asset_prod").alias("_prod")]
    if adult_col:
        cat_cols.append(F.col(adult_col).cast("boolean").alias("_adult"))
    cat = catalog.select(*cat_cols)
    ta = trend_assets.select(F.col(month_col).alias("_t_mt"), F.col("asset_id").alias("_t_asset")) \
                     .distinct().withColumn("_hit", F.lit(True))
    joined = (ev.join(cat, ev[asset_col] == cat["_cat_id"], "left")
                .join(ta, (F.col(asset_col) == ta["_t_asset"]) & (F.col(month_col) == ta["_t_mt"]), "left"))
    adult = F.count_if(F.col("_adult")) if adult_col else F.lit(0).cast("bigint")
    agg = joined.groupBy(user_col, month_col).agg(
        F.coalesce(F.sum(F.when(F.col("_prod") == 0, F.col(time_col)).otherwise(0)), F.lit(0)).cast("bigint")
         .alias("fod_tms"),
        _zero_sum(time_col).alias("total_tms"),
        F.count(F.lit(1)).alias("total_cnt"),
        adult.alias("adult_cnt"),
        F.count_if(F.col("_hit")).alias("trend_cnt"))
    if users is not None:
        agg = restrict_to_users(agg, users, user_col)
    return agg


def recency_month_end(panel_rows: DataFrame, log: DataFrame, user_col: str = "user_id", month_col: str = "p_mt",
                      strt_col: str = "strt_dt", no_event: int = 999) -> DataFrame:
    """A4 point-in-time variant (``as_of='month_end'``): days from the last event on or before the
    end of each panel row's month to that month end; ``no_event`` when there is none yet.

    The log is first reduced to the last event day per (user, month); panel months and event
    months are then merged per user and a running max carries the latest day forward. The window
    runs over one user's months (not events), so a heavy user costs a few hundred rows.
    """
    from pyspark.sql import Window
    from tenure.functions.months import month_end

    last = (with_day_key(with_month(dated(log, strt_col), strt_col, month_col), strt_col, "_day")
            .groupBy(user_col, month_col).agg(key_date(F.max("_day")).alias("_last")))
    keys = panel_rows.select(user_col, month_col).distinct().withColumn("_last", F.lit(None).cast("date"))
    merged = last.unionByName(keys).groupBy(user_col, month_col).agg(F.max("_last").alias("_last"))
    w = Window.partitionBy(user_col).orderBy(month_col).rowsBetween(Window.unboundedPreceding, 0)
    upto = merged.withColumn("_upto", F.max("_last").over(w))
    days = F.datediff(month_end(month_col), F.col("_upto"))
    rec = upto.select(user_col, month_col,
                      F.when(days.isNull(), F.lit(no_event)).otherwise(F.greatest(days, F.lit(0)))
                      .alias("recency_month_end"))
    return panel_rows.join(rec, [user_col, month_col], "left")


def user_features(log: DataFrame, ref_date: str | Column, users: DataFrame | None = None,
                  user_col: str = "user_id", asset_col: str = "asset", time_col: str = "use_tms",
                  class_col: str = "ct_cl", strt_col: str = "strt_dt", kids_code: int = 14, movie_code: int = 12,
                  fanout: bool = False, user_rows: DataFrame | None = None) -> DataFrame:
    """A2 + A3 + A4 in one scan of the log: the v1 totals over all events and the v2 flags,
    dated watch time and last-event day over dated events, as conditional aggregates.

    Same values as ``user_activity`` and ``flags_and_recency`` combined; users
    without dated events get null flag / recency / dated time here (filled by the caller).
    """
    ref = F.lit(ref_date).cast("date") if isinstance(ref_date, str) else ref_date
    dated_row = F.col(strt_col).isNotNull()
    log = with_day_key(log, strt_col, "_day")  # null for undated events
    agg = log.groupBy(user_col).agg(
        F.count(F.lit(1)).alias("vod_view_cnt"),
        _zero_sum(time_col).alias("vod_use_tms_sum"),
        F.countDistinct(asset_col).alias("vod_asset_cnt"),
        F.count_if(dated_row).alias("_n_dated"),
        F.max(F.when(dated_row & (F.col(class_col) == kids_code), 1).when(dated_row, 0)).alias("flag_kids"),
        F.max(F.when(dated_row & (F.col(class_col) == movie_code), 1).when(dated_row, 0)).alias("flag_movie"),
        F.sum(F.when(dated_row, F.col(time_col))).alias("_dated_tms"),
        key_date(F.max("_day")).alias("_last_day"))
    raw = F.datediff(ref, F.col("_last_day"))
    agg = agg.select(
        user_col, "vod_view_cnt", "vod_use_tms_sum", "vod_asset_cnt", "flag_kids", "flag_movie",
        F.when(F.col("_n_dated") > 0, F.coalesce(F.col("_dated_tms"), F.lit(0)).cast("bigint")).alias("total_watch_time"),
        F.when(raw < 0, 0).otherwise(raw).alias("recency"))
    if fanout:
        m = multiplicity(user_rows if user_rows is not None else users, user_col)
        return agg.join(m, user_col, "inner").select(
            user_col, *[(F.col(c) * F.col("_mult")).alias(c) for c in ("vod_view_cnt", "vod_use_tms_sum")],
            "vod_asset_cnt", "flag_kids", "flag_movie",
            (F.col("total_watch_time") * F.col("_mult")).alias("total_watch_time"), "recency")
    if users is not None:
        agg = restrict_to_users(agg, users, user_col)
    return agg


#: The content class of children's programmes.
KIDS_CLASS = 14
SQL_KIDS = f"""kids AS (SELECT user_id, CAST(SUBSTR(strt_dt, 1, 6) AS INT) AS p_mt, COUNT(*) AS kids_views FROM activity
  WHERE strt_dt IS NOT NULL AND ct_cl = {KIDS_CLASS} GROUP BY 1, 2)"""


def kids_views(log: DataFrame, user_col: str = "user_id", class_col: str = "ct_cl", month_col: str = "p_mt") -> DataFrame:
    """Views of children's programmes per user and month, from the dated events of the log (which carries its month)."""
    return log.where((F.col(class_col) == KIDS_CLASS) & F.col(month_col).isNotNull()).groupBy(user_col, month_col).agg(F.count(F.lit(1)).alias("kids_views"))
