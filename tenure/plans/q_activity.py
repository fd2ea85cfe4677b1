"""Registered queries: activity aggregates, joins and the feature datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions.months import month_label
from tenure.functions.numeric import exact_mean, fix, fix_sql, mean
from tenure.operators import activity as act
from tenure.operators.catalog import keyword_assets, keyword_table, pick_column
from tenure.operators.joins import full_outer_fill
from tenure.plans import datasets as ds
from tenure.plans.fixture import KEYWORDS, REF_DATE, YEAR_END, YEAR_START
from tenure.plans.registry import register, with_views
from tenure.sources import views

Y0, Y1 = YEAR_START, YEAR_END
MONTH_SQL = "CAST(SUBSTR(a.strt_dt, 1, 6) AS INT)"
KW_VALUES = ", ".join(f"({m}, '{k}')" for m, k in KEYWORDS)

# ---------------------------------------------------------------- shared SQL pieces
SQL_YEAR_USERS = f"year_users AS (SELECT DISTINCT user_id FROM panel WHERE p_mt BETWEEN {Y0} AND {Y1})"
SQL_BASE = f"base AS (SELECT * FROM panel WHERE p_mt BETWEEN {Y0} AND {Y1})"
SQL_V1AGG = """v1agg AS (
  SELECT user_id, COUNT(*) AS vod_view_cnt, CAST(COALESCE(SUM(use_tms), 0) AS BIGINT) AS vod_use_tms_sum,
         COUNT(DISTINCT asset) AS vod_asset_cnt
  FROM activity WHERE user_id IN (SELECT user_id FROM panel) GROUP BY user_id)"""
SQL_V1 = """v1 AS (
  SELECT p.*, CAST(COALESCE(a.vod_view_cnt, 0) AS BIGINT) AS vod_view_cnt,
         CAST(COALESCE(a.vod_use_tms_sum, 0) AS BIGINT) AS vod_use_tms_sum,
         CAST(COALESCE(a.vod_asset_cnt, 0) AS BIGINT) AS vod_asset_cnt
  FROM panel p LEFT JOIN v1agg a ON p.user_id = a.user_id)"""
SQL_KW = f"""kw AS (SELECT * FROM (VALUES {KW_VALUES}) t(p_mt, keyword)),
trend_assets AS (SELECT DISTINCT k.p_mt, c.asset_id FROM content c
                 JOIN kw k ON REPLACE(c.asset_nm, ' ', '') LIKE '%' || k.keyword || '%')"""


def _inputs(spark, sf_dir, year: bool = False):
    """Panel, log and catalog; ``year=True`` restricts panel and log to the analysis year at the scan."""
    months = (Y0, Y1) if year else None
    return (views.panel(spark, sf_dir, months=months), views.activity(spark, sf_dir, with_month=True, months=months),
            views.content(spark, sf_dir))


def _year_users(panel):
    return panel.filter(F.col("p_mt").between(Y0, Y1)).select("user_id")


# Candidate names of the catalog's title and adult-flag columns.
TITLE_CANDIDATES = ["asset_nm", "prog_nm", "title", "content_nm", "vod_ttl", "ep_ttl"]
ADULT_CANDIDATES = ["adult_yn", "adult_fl", "is_adult", "adult_rate_yn", "adult"]


def _trend_assets(spark, sf_dir):
    content = views.content(spark, sf_dir)
    title = pick_column(content, TITLE_CANDIDATES)  # a missing title column is an error
    return keyword_assets(content, keyword_table(spark, KEYWORDS), title_col=title)


# ---------------------------------------------------------------- A5 (flagship)
@register("a5_monthly_activity", with_views(SQL_YEAR_USERS, f"""
SELECT a.user_id, {MONTH_SQL} AS p_mt, COUNT(*) AS vod_view_cnt,
       CAST(COALESCE(SUM(a.use_tms), 0) AS BIGINT) AS vod_use_tms_sum
FROM activity a JOIN year_users u ON a.user_id = u.user_id
WHERE a.strt_dt IS NOT NULL AND {MONTH_SQL} BETWEEN {Y0} AND {Y1}
GROUP BY a.user_id, {MONTH_SQL}"""))
def a5_monthly_activity(spark, sf_dir):
    panel, log, _ = _inputs(spark, sf_dir, year=True)
    return act.monthly_activity(log, Y0, Y1, users=_year_users(panel))


# ---------------------------------------------------------------- A2 / J1 / J4 (churn v1)
@register("a2_user_activity", with_views(SQL_V1AGG + ",\n" + SQL_V1, "SELECT * FROM v1"))
def a2_user_activity(spark, sf_dir):
    panel, log, _ = _inputs(spark, sf_dir)
    return ds.churn_v1(panel, log, fanout=False)


@register("j2_fanout_activity", with_views("""
fan AS (SELECT a.user_id, COUNT(*) AS vod_view_cnt, CAST(COALESCE(SUM(a.use_tms), 0) AS BIGINT) AS vod_use_tms_sum,
               COUNT(DISTINCT a.asset) AS vod_asset_cnt
        FROM activity a JOIN panel p ON a.user_id = p.user_id GROUP BY a.user_id)""", """
SELECT p.*, CAST(COALESCE(f.vod_view_cnt, 0) AS BIGINT) AS vod_view_cnt,
       CAST(COALESCE(f.vod_use_tms_sum, 0) AS BIGINT) AS vod_use_tms_sum,
       CAST(COALESCE(f.vod_asset_cnt, 0) AS BIGINT) AS vod_asset_cnt
FROM panel p LEFT JOIN fan f ON p.user_id = f.user_id"""))
def j2_fanout_activity(spark, sf_dir):
    panel, log, _ = _inputs(spark, sf_dir)
    return ds.churn_v1(panel, log, fanout=True)


# ---------------------------------------------------------------- A3 / A4 / F1 / F2 (churn v2)
SQL_FR = f"""fr AS (
  SELECT user_id, MAX(CASE WHEN ct_cl = 14 THEN 1 ELSE 0 END) AS flag_kids,
         MAX(CASE WHEN ct_cl = 12 THEN 1 ELSE 0 END) AS flag_movie,
         CAST(COALESCE(SUM(use_tms), 0) AS BIGINT) AS total_watch_time,
         CAST(DATEDIFF('day', MAX(CAST(STRPTIME(SUBSTR(strt_dt, 1, 8), '%Y%m%d') AS DATE)), DATE '{REF_DATE}') AS INT)
           AS recency_raw
  FROM activity WHERE strt_dt IS NOT NULL AND user_id IN (SELECT user_id FROM panel) GROUP BY user_id)"""
SQL_V2 = """v2 AS (
  SELECT v1.*, COALESCE(fr.flag_kids, 0) AS flag_kids, COALESCE(fr.flag_movie, 0) AS flag_movie,
         COALESCE(CASE WHEN fr.recency_raw < 0 THEN 0 ELSE fr.recency_raw END, 999) AS recency,
         COALESCE(fr.total_watch_time, v1.vod_use_tms_sum) AS total_watch_time
  FROM v1 LEFT JOIN fr ON v1.user_id = fr.user_id)"""


@register("a3_a4_churn_v2", with_views(",\n".join([SQL_V1AGG, SQL_V1, SQL_FR, SQL_V2]), f"""
SELECT *, {fix_sql('LN(1 + total_watch_time)')} AS log_watch_time,
       CASE WHEN ott_yn THEN 1 ELSE 0 END AS is_ott,
       CASE WHEN COALESCE(flag_kids, 0) = 1 AND ott_yn THEN 1 ELSE 0 END AS risk_kids_ott
FROM v2"""))
def a3_a4_churn_v2(spark, sf_dir):
    panel, log, _ = _inputs(spark, sf_dir)
    return ds.churn_v1v2(panel, log, REF_DATE)


# ---------------------------------------------------------------- A6 / J3
SQL_BYTYPE = f"""bytype AS (
  SELECT a.user_id, {MONTH_SQL} AS p_mt,
         CAST(COALESCE(SUM(CASE WHEN c.asset_prod = 0 THEN a.use_tms ELSE 0 END), 0) AS BIGINT) AS fod_tms,
         CAST(COALESCE(SUM(CASE WHEN c.asset_prod = 1 THEN a.use_tms ELSE 0 END), 0) AS BIGINT) AS rvod_tms,
         CAST(COALESCE(SUM(CASE WHEN c.asset_prod = 2 THEN a.use_tms ELSE 0 END), 0) AS BIGINT) AS svod_tms,
         CAST(COALESCE(SUM(a.use_tms), 0) AS BIGINT) AS total_tms
  FROM activity a JOIN year_users u ON a.user_id = u.user_id LEFT JOIN content c ON a.asset = c.asset_id
  WHERE a.strt_dt IS NOT NULL AND {MONTH_SQL} BETWEEN {Y0} AND {Y1}
  GROUP BY a.user_id, {MONTH_SQL})"""


@register("a6_monthly_time_by_type", with_views(SQL_YEAR_USERS + ",\n" + SQL_BYTYPE, "SELECT * FROM bytype"))
def a6_monthly_time_by_type(spark, sf_dir):
    panel, log, content = _inputs(spark, sf_dir, year=True)
    return act.monthly_time_by_type(log, content, Y0, Y1, users=_year_users(panel))


# ---------------------------------------------------------------- A7
SQL_COUNTS = f"""monthly AS (
  SELECT a.user_id, {MONTH_SQL} AS p_mt,
         COUNT(*) FILTER (WHERE c.asset_prod = 0) AS fod_cnt,
         COUNT(*) FILTER (WHERE c.asset_prod = 1) AS rvod_cnt,
         COUNT(*) FILTER (WHERE c.asset_prod = 2) AS svod_cnt
  FROM activity a JOIN (SELECT DISTINCT user_id FROM base) u ON a.user_id = u.user_id
  LEFT JOIN content c ON a.asset = c.asset_id
  WHERE a.strt_dt IS NOT NULL AND {MONTH_SQL} BETWEEN {Y0} AND {Y1}
  GROUP BY a.user_id, {MONTH_SQL})"""


@register("a7_monthly_counts_by_type", with_views(SQL_BASE + ",\n" + SQL_COUNTS, "SELECT * FROM monthly"))
def a7_monthly_counts_by_type(spark, sf_dir):
    panel, log, content = _inputs(spark, sf_dir, year=True)
    return act.monthly_counts_by_type(log, content, Y0, Y1, users=_year_users(panel))


# ---------------------------------------------------------------- J5 / J6 / F3 / W6 (purchase dataset)
@register("j6_purchase_dataset", with_views(SQL_BASE + ",\n" + SQL_COUNTS + """,
typed AS (
  SELECT b.*, CAST(COALESCE(m.fod_cnt, 0) AS BIGINT) AS fod_cnt, CAST(COALESCE(m.rvod_cnt, 0) AS BIGINT) AS rvod_cnt,
         CAST(COALESCE(m.svod_cnt, 0) AS BIGINT) AS svod_cnt
  FROM base b LEFT JOIN monthly m ON b.user_id = m.user_id AND b.p_mt = m.p_mt)""", """
SELECT t.*, t.rvod_cnt AS vod_purchase_cnt, CAST(COALESCE(l.rvod_cnt, 0) AS BIGINT) AS lagged_rvod_cnt
FROM typed t LEFT JOIN monthly l
  ON t.user_id = l.user_id AND l.p_mt = CASE WHEN t.p_mt % 100 = 1 THEN t.p_mt - 89 ELSE t.p_mt - 1 END"""))
def j6_purchase_dataset(spark, sf_dir):
    panel, log, content = _inputs(spark, sf_dir, year=True)
    base = panel.filter(F.col("p_mt").between(Y0, Y1))
    return ds.purchase(base, log, content, Y0, Y1)


# ---------------------------------------------------------------- J8
@register("j8_trend_assets", with_views(SQL_KW, "SELECT * FROM trend_assets"))
def j8_trend_assets(spark, sf_dir):
    return _trend_assets(spark, sf_dir)


# ---------------------------------------------------------------- A8 / J7 / F4 (churn v3)
SQL_TREND = f"""tot AS (
  SELECT a.user_id, {MONTH_SQL} AS p_mt, COUNT(*) AS total_vod_cnt
  FROM activity a WHERE a.user_id IN (SELECT user_id FROM base) AND a.strt_dt IS NOT NULL
    AND {MONTH_SQL} BETWEEN {Y0} AND {Y1}
  GROUP BY a.user_id, {MONTH_SQL}),
tr AS (
  SELECT a.user_id, {MONTH_SQL} AS p_mt, COUNT(*) AS trend_watch_cnt
  FROM activity a JOIN trend_assets ta ON a.asset = ta.asset_id AND {MONTH_SQL} = ta.p_mt
  WHERE a.user_id IN (SELECT user_id FROM base) AND a.strt_dt IS NOT NULL
  GROUP BY a.user_id, {MONTH_SQL})"""


@register("a8_churn_v3", with_views(",\n".join([SQL_BASE, SQL_KW, SQL_TREND]), """
SELECT b.*, CAST(COALESCE(tr.trend_watch_cnt, 0) AS BIGINT) AS trend_watch_cnt,
       CASE WHEN COALESCE(tot.total_vod_cnt, 0) = 0 THEN 0.0
            ELSE CAST(COALESCE(tr.trend_watch_cnt, 0) AS DOUBLE) / CAST(tot.total_vod_cnt AS DOUBLE) END
         AS trend_watch_ratio,
       CAST(CASE WHEN COALESCE(tr.trend_watch_cnt, 0) > 0 THEN 1 ELSE 0 END AS INTEGER) AS trend_flag
FROM base b LEFT JOIN tr ON b.user_id = tr.user_id AND b.p_mt = tr.p_mt
LEFT JOIN tot ON b.user_id = tot.user_id AND b.p_mt = tot.p_mt"""))
def a8_churn_v3(spark, sf_dir):
    panel, log, _ = _inputs(spark, sf_dir, year=True)
    base = panel.filter(F.col("p_mt").between(Y0, Y1))
    return ds.churn_v3(base, log, _trend_assets(spark, sf_dir), Y0, Y1)


# ---------------------------------------------------------------- A9 / F5 / P11 (channel dataset)
CHANNEL_ATTRS = {"last_view_grp": 0.0, "agmt_end_seg": 5.0}


@register("a9_channel_dataset", with_views(",\n".join([
    f"""base AS (SELECT user_id, p_mt, tv_hours AS y, last_view_grp, agmt_end_seg FROM panel
              WHERE p_mt BETWEEN {Y0} AND {Y1} AND tv_hours IS NOT NULL)""",
    SQL_KW, SQL_V1AGG,
    f"""mix AS (
  SELECT a.user_id, {MONTH_SQL} AS p_mt,
         COALESCE(SUM(CASE WHEN c.asset_prod = 0 THEN a.use_tms ELSE 0 END), 0) AS fod_tms,
         COALESCE(SUM(a.use_tms), 0) AS total_tms, COUNT(*) AS total_cnt,
         COUNT(*) FILTER (WHERE c.adult_yn = TRUE) AS adult_cnt
  FROM activity a LEFT JOIN content c ON a.asset = c.asset_id
  WHERE a.user_id IN (SELECT user_id FROM base) AND a.strt_dt IS NOT NULL AND {MONTH_SQL} BETWEEN {Y0} AND {Y1}
  GROUP BY a.user_id, {MONTH_SQL}),
tr AS (
  SELECT a.user_id, {MONTH_SQL} AS p_mt, COUNT(*) AS trend_cnt
  FROM activity a JOIN trend_assets ta ON a.asset = ta.asset_id AND {MONTH_SQL} = ta.p_mt
  WHERE a.user_id IN (SELECT user_id FROM base) AND a.strt_dt IS NOT NULL
  GROUP BY a.user_id, {MONTH_SQL})"""]), f"""
SELECT b.user_id, b.p_mt, b.y,
       {fix_sql('LN(1 + COALESCE(t.vod_use_tms_sum, 0))')} AS log_vod_time,
       CASE WHEN COALESCE(m.total_cnt, 0) = 0 THEN 0.0 ELSE CAST(m.adult_cnt AS DOUBLE) / CAST(m.total_cnt AS DOUBLE) END AS adult,
       CASE WHEN COALESCE(m.total_tms, 0) = 0 THEN 0.0 ELSE CAST(m.fod_tms AS DOUBLE) / CAST(m.total_tms AS DOUBLE) END AS fod,
       CASE WHEN COALESCE(m.total_cnt, 0) = 0 THEN 0.0
            ELSE CAST(COALESCE(tr.trend_cnt, 0) AS DOUBLE) / CAST(m.total_cnt AS DOUBLE) END AS trend,
       COALESCE(TRY_CAST(b.last_view_grp AS DOUBLE), 0.0) AS last_view_grp,
       COALESCE(TRY_CAST(b.agmt_end_seg AS DOUBLE), 5.0) AS agmt_end_seg
FROM base b LEFT JOIN mix m ON b.user_id = m.user_id AND b.p_mt = m.p_mt
LEFT JOIN tr ON b.user_id = tr.user_id AND b.p_mt = tr.p_mt
LEFT JOIN v1agg t ON b.user_id = t.user_id"""))
def a9_channel_dataset(spark, sf_dir):
    panel, log, content = _inputs(spark, sf_dir, year=True)
    totals = act.user_activity(_inputs(spark, sf_dir)[1])  # the join to the panel rows keeps their users only
    adult = pick_column(content, ADULT_CANDIDATES, required=False)  # no flag -> adult share 0
    return ds.channel(panel, log, content, _trend_assets(spark, sf_dir), totals, Y0, Y1, "tv_hours",
                      attributes=CHANNEL_ATTRS, adult_col=adult)


# ---------------------------------------------------------------- J9 / A13 / P10
@register("j9_monthly_tv_vod_by_type", with_views(",\n".join([SQL_YEAR_USERS, SQL_BYTYPE, f"""
tv AS (SELECT p_mt, {fix_sql('AVG(tv_hours)')} AS tv_avg FROM panel
       WHERE p_mt BETWEEN {Y0} AND {Y1} AND tv_hours IS NOT NULL GROUP BY p_mt),
vod AS (SELECT p_mt, CAST(SUM(fod_tms) AS DOUBLE) / COUNT(fod_tms) AS fod_avg,
               CAST(SUM(rvod_tms) AS DOUBLE) / COUNT(rvod_tms) AS rvod_avg,
               CAST(SUM(svod_tms) AS DOUBLE) / COUNT(svod_tms) AS svod_avg,
               CAST(SUM(total_tms) AS DOUBLE) / COUNT(total_tms) AS vod_total_avg
        FROM bytype GROUP BY p_mt)"""]), """
SELECT COALESCE(tv.p_mt, vod.p_mt) AS p_mt, COALESCE(tv.tv_avg, 0) AS tv_avg, COALESCE(vod.fod_avg, 0) AS fod_avg,
       COALESCE(vod.rvod_avg, 0) AS rvod_avg, COALESCE(vod.svod_avg, 0) AS svod_avg,
       COALESCE(vod.vod_total_avg, 0) AS vod_total_avg,
       SUBSTR(CAST(COALESCE(tv.p_mt, vod.p_mt) AS VARCHAR), 1, 4) || '-' ||
       SUBSTR(CAST(COALESCE(tv.p_mt, vod.p_mt) AS VARCHAR), 5, 2) AS p_mt_str
FROM tv FULL OUTER JOIN vod ON tv.p_mt = vod.p_mt"""))
def j9_monthly_tv_vod_by_type(spark, sf_dir):
    panel, log, content = _inputs(spark, sf_dir, year=True)
    tv = (panel.filter(F.col("p_mt").between(Y0, Y1) & F.col("tv_hours").isNotNull())
               .groupBy("p_mt").agg(mean("tv_hours").alias("tv_avg")))
    bytype = act.monthly_time_by_type(log, content, Y0, Y1, users=_year_users(panel))
    vod = bytype.groupBy("p_mt").agg(exact_mean("fod_tms").alias("fod_avg"), exact_mean("rvod_tms").alias("rvod_avg"),
                                     exact_mean("svod_tms").alias("svod_avg"),
                                     exact_mean("total_tms").alias("vod_total_avg"))
    out = full_outer_fill(tv, vod, "p_mt", fill=0)
    return out.withColumn("p_mt_str", month_label("p_mt"))


# ---------------------------------------------------------------- J13
SQL_YEAR_MONTHLY = f"""monthly_act AS (
  SELECT a.user_id, {MONTH_SQL} AS p_mt, COUNT(*) AS vod_view_cnt,
         CAST(COALESCE(SUM(a.use_tms), 0) AS BIGINT) AS vod_use_tms_sum
  FROM activity a JOIN year_users u ON a.user_id = u.user_id
  WHERE a.strt_dt IS NOT NULL AND {MONTH_SQL} BETWEEN {Y0} AND {Y1}
  GROUP BY a.user_id, {MONTH_SQL}),
pm AS (
  SELECT p.user_id, p.cancel_yn, p.p_mt, p.tv_hours,
         CAST(COALESCE(m.vod_use_tms_sum, 0) AS BIGINT) AS vod_use_tms_sum,
         CAST(COALESCE(m.vod_view_cnt, 0) AS BIGINT) AS vod_view_cnt
  FROM panel p LEFT JOIN monthly_act m ON p.user_id = m.user_id AND p.p_mt = m.p_mt
  WHERE p.p_mt BETWEEN {Y0} AND {Y1} AND p.tv_hours IS NOT NULL)"""


def panel_month_rows(spark, sf_dir):
    """J13 input of the segment analyses: year panel rows with that month's activity."""
    panel, log, _ = _inputs(spark, sf_dir, year=True)
    rows = panel.filter(F.col("p_mt").between(Y0, Y1) & F.col("tv_hours").isNotNull()) \
                .select("user_id", "cancel_yn", "p_mt", "tv_hours")
    monthly = act.monthly_activity(log, Y0, Y1, users=_year_users(panel))
    out = ds.panel_monthly(rows, monthly)
    return out.select("user_id", "cancel_yn", "p_mt", "tv_hours",
                      F.col("vod_use_tms_sum").cast("bigint").alias("vod_use_tms_sum"),
                      F.col("vod_view_cnt").cast("bigint").alias("vod_view_cnt"))


@register("j13_panel_monthly", with_views(SQL_YEAR_USERS + ",\n" + SQL_YEAR_MONTHLY, "SELECT * FROM pm"))
def j13_panel_monthly(spark, sf_dir):
    return panel_month_rows(spark, sf_dir)


_ = (fix,)


# ---------------------------------------------------------------- A4 point-in-time variant
@register("a4_recency_month_end", with_views("""
days AS (SELECT user_id, CAST(STRPTIME(SUBSTR(strt_dt, 1, 8), '%Y%m%d') AS DATE) AS d FROM activity
         WHERE strt_dt IS NOT NULL),
pe AS (SELECT user_id, p_mt, LAST_DAY(MAKE_DATE(CAST(p_mt // 100 AS BIGINT), CAST(p_mt % 100 AS BIGINT), 1)) AS me FROM panel),
j AS (SELECT pe.user_id, pe.p_mt, pe.me, MAX(days.d) AS lastd FROM pe
      LEFT JOIN days ON days.user_id = pe.user_id AND days.d <= pe.me GROUP BY pe.user_id, pe.p_mt, pe.me)""", """
SELECT p.*, CAST(CASE WHEN j.lastd IS NULL THEN 999 ELSE GREATEST(DATEDIFF('day', j.lastd, j.me), 0) END AS INT)
         AS recency_month_end
FROM panel p JOIN j ON p.user_id = j.user_id AND p.p_mt = j.p_mt"""))
def a4_recency_month_end(spark, sf_dir):
    """Recency as of each panel row's month end (no look-ahead), next to the fixed as-of date of A4."""
    panel, log, _ = _inputs(spark, sf_dir)
    return act.recency_month_end(panel, log)
