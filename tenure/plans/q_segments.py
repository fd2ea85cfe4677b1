"""Registered queries: segments, rank buckets, rule scores and report tables.

Covers A10-A14, A18-A22, A25-A27, F6-F15, W1, W2, L1, P6, P10, P15.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.months import month_label
from tenure.functions.numeric import exact_mean, fix, fix_sql, mean
from tenure.operators import activity as act
from tenure.operators import segments as seg
from tenure.operators.joins import attach
from tenure.operators.quantiles import column_quantiles
from tenure.operators.ranking import multi_rank_buckets, share_within
from tenure.plans import datasets as ds
from tenure.plans.fixture import REF_DATE
from tenure.plans.q_activity import (SQL_FR, SQL_V1, SQL_V1AGG, SQL_V2, SQL_YEAR_MONTHLY, SQL_YEAR_USERS,
                                     panel_month_rows)
from tenure.plans.q_sampling import SQL_KPI_PURCHASE, SQL_KPI_V2, kpi_rows
from tenure.plans.registry import register, with_views
from tenure.session import cut_lineage
from tenure.sources import views


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def MEAN_INT(x) -> str:
    return f"CAST(SUM({x}) AS DOUBLE) / CAST(COUNT({x}) AS DOUBLE)"


SQL_PM = SQL_YEAR_USERS + ",\n" + SQL_YEAR_MONTHLY
SQL_UR = f"""ur AS (
  SELECT user_id, arg_min(cancel_yn, p_mt) AS cancel_yn, {fix_sql('AVG(tv_hours)')} AS tv_mean,
         {MEAN_INT('vod_use_tms_sum')} AS vod_mean
  FROM pm GROUP BY user_id)"""
SQL_V2_ALL = (",\n".join([SQL_V1AGG, SQL_V1, SQL_FR, SQL_V2])
              + ",\nv2x AS (SELECT *, CASE WHEN ott_yn THEN 1 ELSE 0 END AS is_ott, "
              "CASE WHEN COALESCE(flag_kids, 0) = 1 AND ott_yn THEN 1 ELSE 0 END AS risk_kids_ott FROM v2)")


def _rollup(spark, sf_dir) -> DataFrame:
    return seg.user_rollup(panel_month_rows(spark, sf_dir))


def _v2(spark, sf_dir) -> DataFrame:
    panel, log = views.panel(spark, sf_dir), views.activity(spark, sf_dir)
    return ds.churn_v1v2(panel, log, REF_DATE)


def _rate(df, *keys):
    return df.groupBy(*keys).agg(exact_mean("cancel_yn").alias("churn_rate"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- A10
@register("a10_label_counts", with_views("", f"""
SELECT cancel_yn, COUNT(*) AS cnt, {fix_sql(D('COUNT(*)') + ' / ' + D('SUM(COUNT(*)) OVER ()') + ' * 100.0', 2)} AS pct
FROM panel GROUP BY cancel_yn"""))
def a10_label_counts(spark, sf_dir):
    counts = views.panel(spark, sf_dir).groupBy("cancel_yn").agg(F.count(F.lit(1)).alias("cnt"))
    return seg.share_of_total(counts, "cnt", ["cancel_yn"], "pct", 2)


# ---------------------------------------------------------------- A11
@register("a11_user_rollup", with_views(SQL_PM + ",\n" + SQL_UR, "SELECT * FROM ur"))
def a11_user_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)


# ---------------------------------------------------------------- F6
@register("f6_binary_segment", with_views(SQL_PM + ",\n" + SQL_UR + """,
q AS (SELECT quantile_cont(tv_mean, 0.25) AS tv_q25, quantile_cont(vod_mean, 0.75) AS vod_q75 FROM ur),
s AS (SELECT ur.*, q.tv_q25, q.vod_q75,
             CASE WHEN tv_mean <= q.tv_q25 AND vod_mean >= q.vod_q75 THEN 'low_tv_high_vod' ELSE 'other' END AS segment
      FROM ur JOIN q ON TRUE)""", f"""
SELECT segment, {MEAN_INT('cancel_yn')} AS churn_rate, COUNT(*) AS n,
       {fix_sql('MIN(tv_q25)')} AS tv_q25, {fix_sql('MIN(vod_q75)')} AS vod_q75
FROM s GROUP BY segment"""))
def f6_binary_segment(spark, sf_dir):
    # the cut points and the rates read the same rows: write them once
    users = cut_lineage(_rollup(spark, sf_dir))
    q = column_quantiles(users, {"tv_mean": [0.25], "vod_mean": [0.75]})
    tv_q25, vod_q75 = q["tv_mean"][0], q["vod_mean"][0]
    flag = seg.binary_segment(F.col("tv_mean"), F.col("vod_mean"), tv_q25, vod_q75)
    out = _rate(users.withColumn("segment", F.when(flag, "low_tv_high_vod").otherwise("other")), "segment")
    return out.withColumn("tv_q25", fix(F.lit(tv_q25))).withColumn("vod_q75", fix(F.lit(vod_q75)))


# ---------------------------------------------------------------- W1 / F7
def _bucket_sql(r, q):
    return f"CAST(CASE WHEN n <= 1 THEN 1 ELSE GREATEST(1, (({r} - 1) * {q} + n - 2) // (n - 1)) END AS INT)"


SQL_RK = """rk AS (
  SELECT user_id, cancel_yn,
         ROW_NUMBER() OVER (ORDER BY tv_mean NULLS FIRST, user_id) AS r_tv,
         ROW_NUMBER() OVER (ORDER BY COALESCE(vod_mean, 0) NULLS FIRST, user_id) AS r_vod,
         COUNT(*) OVER () AS n
  FROM ur)"""
SQL_BUCKETS = SQL_PM + ",\n" + SQL_UR + ",\n" + SQL_RK + f""",
bk AS (SELECT user_id, cancel_yn, {_bucket_sql('r_tv', 4)} AS tv_quartile, {_bucket_sql('r_vod', 4)} AS vod_quartile,
              {_bucket_sql('r_vod', 5)} AS vod_quintile FROM rk)"""


def _buckets(spark, sf_dir):
    """TV quartile, VOD quartile and VOD quintile per user from one ranking pass (VOD ranked once)."""
    users = _rollup(spark, sf_dir)
    vod = F.coalesce(F.col("vod_mean"), F.lit(0.0))
    out = multi_rank_buckets(users, "user_id", {"tv_quartile": (F.col("tv_mean"), 4),
                                                "vod_quartile": (vod, 4), "vod_quintile": (vod, 5)})
    return out.select("user_id", "cancel_yn", "tv_quartile", "vod_quartile", "vod_quintile")


@register("w1_rank_buckets", with_views(SQL_BUCKETS, "SELECT * FROM bk"))
def w1_rank_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir)


@register("f7_quartile_grid", with_views(SQL_BUCKETS, f"""
SELECT tv_quartile, vod_quartile, {MEAN_INT('cancel_yn')} AS churn_rate, COUNT(*) AS n
FROM bk GROUP BY tv_quartile, vod_quartile"""))
def f7_quartile_grid(spark, sf_dir):
    return _rate(_buckets(spark, sf_dir), "tv_quartile", "vod_quartile")


@register("f7_vod_quintile_churn", with_views(SQL_BUCKETS, f"""
SELECT vod_quintile, {MEAN_INT('cancel_yn')} AS churn_rate, COUNT(*) AS n FROM bk GROUP BY vod_quintile"""))
def f7_vod_quintile_churn(spark, sf_dir):
    return _rate(_buckets(spark, sf_dir), "vod_quintile")


# ---------------------------------------------------------------- F8
@register("f8_four_way_segment", with_views(SQL_V1AGG + ",\n" + SQL_V1 + """,
rows AS (SELECT tv_hours, vod_use_tms_sum, cancel_yn FROM v1
         WHERE tv_hours IS NOT NULL AND vod_use_tms_sum IS NOT NULL AND cancel_yn IS NOT NULL),
q AS (SELECT quantile_cont(tv_hours, 0.25) AS tv_q25, quantile_cont(vod_use_tms_sum, 0.75) AS vod_q75 FROM rows),
s AS (SELECT rows.*, CASE WHEN tv_hours <= tv_q25 AND vod_use_tms_sum >= vod_q75 THEN 'low_tv_high_vod'
                          WHEN NOT (tv_hours <= tv_q25) AND vod_use_tms_sum >= vod_q75 THEN 'high_tv_high_vod'
                          WHEN tv_hours <= tv_q25 THEN 'low_tv_low_vod' ELSE 'high_tv_low_vod' END AS segment
      FROM rows JOIN q ON TRUE)""", f"""
SELECT segment, {MEAN_INT('cancel_yn')} AS churn_rate, COUNT(*) AS n FROM s GROUP BY segment"""))
def f8_four_way_segment(spark, sf_dir):
    panel, log = views.panel(spark, sf_dir), views.activity(spark, sf_dir)
    rows = cut_lineage(ds.churn_v1(panel, log).select("tv_hours", "vod_use_tms_sum", "cancel_yn").dropna())
    q = column_quantiles(rows, {"tv_hours": [0.25], "vod_use_tms_sum": [0.75]})
    tv_q25, vod_q75 = q["tv_hours"][0], q["vod_use_tms_sum"][0]
    labelled = rows.withColumn("segment", seg.four_way_segment(F.col("tv_hours"), F.col("vod_use_tms_sum"),
                                                               tv_q25, vod_q75))
    return _rate(labelled, "segment")


# ---------------------------------------------------------------- F9-F13, F15 (batch scoring)
def _churn_sql(batch: bool) -> str:
    if batch:
        grp = "LEAST(GREATEST(COALESCE(CAST(last_view_grp AS DOUBLE), 0.0), 0.0), 5.0)"
        voc = ("COALESCE(CAST(voc_cancel_yn AS INT), 0) * 25 + "
               "CASE WHEN COALESCE(CAST(voc_cancel_yn AS INT), 0) = 0 THEN COALESCE(CAST(voc_yn AS INT), 0) ELSE 0 END * 12")
        ott = "COALESCE(is_ott, 0) * 8"
    else:
        grp = "COALESCE(CAST(last_view_grp AS DOUBLE), 0.0)"
        voc = ("CASE WHEN COALESCE(CAST(voc_cancel_yn AS INT), 0) = 1 THEN 25 "
               "WHEN COALESCE(CAST(voc_yn AS INT), 0) = 1 THEN 12 ELSE 0 END")
        ott = "CASE WHEN COALESCE(is_ott, 0) = 1 OR COALESCE(ott_yn, FALSE) THEN 8 ELSE 0 END"
    agmt = f"(GREATEST({D('7.0')} - COALESCE(CAST(agmt_end_seg AS DOUBLE), {D('7.0')}), 0.0) / {D('6.0')}) * {D('15.0')}"
    rec = ("CASE WHEN COALESCE(CAST(recency AS DOUBLE), 0.0) >= 999 THEN 5 "
           "WHEN COALESCE(CAST(recency AS DOUBLE), 0.0) > 180 THEN 12 "
           "WHEN COALESCE(CAST(recency AS DOUBLE), 0.0) > 90 THEN 6 ELSE 0 END")
    score = f"({grp} / {D('5.0')}) * {D('40.0')} + {voc} + {agmt} + {ott} + {rec}"
    clipped = f"LEAST(GREATEST({score}, {D('5.0')}), {D('95.0')})"
    return fix_sql(clipped, 1) if batch else clipped


SQL_PURCHASE_SCORE = fix_sql(
    f"LEAST(GREATEST(COALESCE({D('k.lagged_rvod_cnt')}, 0.0) * {D('0.75')} + "
    f"(COALESCE({D('vod_view_cnt')}, 0.0) / {D('500.0')}) * {D('0.15')} + "
    f"(COALESCE({D('vod_asset_cnt')}, 0.0) / {D('50.0')}) * {D('0.1')}, 0.0), {D('30.0')})", 2)

SQL_SCORED = SQL_KPI_V2 + ",\n" + SQL_KPI_PURCHASE + f""",
sc0 AS (
  SELECT v.user_id, v.p_mt, v.cancel_yn, v.last_view_grp, v.voc_cancel_yn, v.is_ott, v.tv_hours, v.vod_use_tms_sum,
         {_churn_sql(True)} AS churn_risk, {_churn_sql(False)} AS churn_risk_lookup,
         {SQL_PURCHASE_SCORE} AS vod_purchase
  FROM kv2 v LEFT JOIN kpurchase k ON v.user_id = k.user_id),
sc AS (
  SELECT user_id, p_mt, cancel_yn, churn_risk, churn_risk_lookup, vod_purchase,
         CASE WHEN churn_risk >= 50 AND NOT vod_purchase >= 1 THEN 'Q1_high_risk_low_buy'
              WHEN churn_risk >= 50 AND vod_purchase >= 1 THEN 'Q2_high_risk_high_buy'
              WHEN NOT churn_risk >= 50 AND NOT vod_purchase >= 1 THEN 'Q3_low_risk_low_buy'
              ELSE 'Q4_low_risk_high_buy' END AS quadrant,
         CASE WHEN COALESCE(last_view_grp, 0) >= 4 AND COALESCE(voc_cancel_yn, FALSE) THEN 'high'
              WHEN COALESCE(last_view_grp, 0) >= 3 OR COALESCE(is_ott, 0) = 1 THEN 'mid' ELSE 'low' END AS risk_label,
         CASE WHEN COALESCE({D('tv_hours')}, 4.0) < 3.5 AND COALESCE({D('vod_use_tms_sum')}, 0.0) > 1000.0 THEN 'low_tv_high_vod'
              WHEN NOT COALESCE({D('tv_hours')}, 4.0) < 3.5 AND COALESCE({D('vod_use_tms_sum')}, 0.0) > 1000.0 THEN 'high_tv_high_vod'
              WHEN COALESCE({D('tv_hours')}, 4.0) < 3.5 THEN 'low_tv_low_vod' ELSE 'high_tv_low_vod' END AS tv_vod_segment,
         CASE WHEN COALESCE({D('tv_hours')}, 4.0) < 3.5 AND COALESCE({D('vod_use_tms_sum')}, 0.0) > 1000.0 THEN 'high'
              WHEN NOT COALESCE({D('tv_hours')}, 4.0) < 3.5 AND COALESCE({D('vod_use_tms_sum')}, 0.0) > 1000.0 THEN 'low'
              WHEN COALESCE({D('tv_hours')}, 4.0) < 3.5 THEN 'medium' ELSE 'low' END AS segment_risk
  FROM sc0)"""


def scored(spark, sf_dir) -> DataFrame:
    rows = kpi_rows(spark, sf_dir)
    tv_seg, tv_risk = seg.fixed_segment("tv_hours", "vod_use_tms_sum")
    out = rows.select(
        "user_id", "p_mt", "cancel_yn",
        seg.churn_score(variant="batch").alias("churn_risk"),
        seg.churn_score(variant="lookup").alias("churn_risk_lookup"),
        seg.purchase_score().alias("vod_purchase"),
        seg.risk_label().alias("risk_label"),
        tv_seg.alias("tv_vod_segment"), tv_risk.alias("segment_risk"))
    return out.withColumn("quadrant", seg.quadrant("churn_risk", "vod_purchase"))


@register("f10_f15_scores", with_views(SQL_SCORED, "SELECT * FROM sc"))
def f10_f15_scores(spark, sf_dir):
    return scored(spark, sf_dir)


# ---------------------------------------------------------------- F14
CAMPAIGN_SQL = "camp AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', '{}', '{}')".format(q, t, p, "; ".join(a)) for q, t, p, a in seg.CAMPAIGNS) + \
    ") t(quadrant, title, priority, actions))"


@register("f14_campaigns", with_views(SQL_SCORED + ",\n" + CAMPAIGN_SQL, """
SELECT sc.user_id, sc.quadrant, camp.title, camp.priority, camp.actions
FROM sc LEFT JOIN camp ON sc.quadrant = camp.quadrant"""))
def f14_campaigns(spark, sf_dir):
    out = seg.assign_campaign(scored(spark, sf_dir), spark)
    return out.select("user_id", "quadrant", "title", "priority", F.concat_ws("; ", "actions").alias("actions"))


# ---------------------------------------------------------------- A22
@register("a22_quadrant_counts", with_views(SQL_SCORED, f"""
SELECT quadrant, COUNT(*) AS cnt, {fix_sql(D('COUNT(*)') + ' / ' + D('SUM(COUNT(*)) OVER ()') + ' * 100.0', 2)} AS pct
FROM sc GROUP BY quadrant"""))
def a22_quadrant_counts(spark, sf_dir):
    counts = scored(spark, sf_dir).groupBy("quadrant").agg(F.count(F.lit(1)).alias("cnt"))
    return seg.share_of_total(counts, "cnt", ["quadrant"], "pct", 2)


# ---------------------------------------------------------------- A12 / P10 / P15
SQL_TREND = f"""mt AS (
  SELECT p_mt, {fix_sql('AVG(tv_hours)')} AS tv_avg, {MEAN_INT('vod_use_tms_sum')} AS vod_avg,
         COUNT(DISTINCT user_id) AS view_cnt,
         SUBSTR(CAST(p_mt AS VARCHAR), 1, 4) || '-' || SUBSTR(CAST(p_mt AS VARCHAR), 5, 2) AS p_mt_str
  FROM pm GROUP BY p_mt)"""


def monthly_trend(spark, sf_dir) -> DataFrame:
    rows = panel_month_rows(spark, sf_dir)
    return (rows.groupBy("p_mt")
                .agg(mean("tv_hours").alias("tv_avg"), exact_mean("vod_use_tms_sum").alias("vod_avg"),
                     F.countDistinct("user_id").alias("view_cnt"))
                .withColumn("p_mt_str", month_label("p_mt")))


@register("a12_monthly_trend", with_views(SQL_PM + ",\n" + SQL_TREND, "SELECT * FROM mt WHERE vod_avg > 0"))
def a12_monthly_trend(spark, sf_dir):
    return monthly_trend(spark, sf_dir).filter(F.col("vod_avg") > 0)


# ---------------------------------------------------------------- A21
@register("a21_trend_change", with_views(SQL_PM + ",\n" + SQL_TREND, f"""
SELECT arg_min(p_mt, p_mt) AS first_month, arg_max(p_mt, p_mt) AS last_month,
       {fix_sql('(arg_max(tv_avg, p_mt) - arg_min(tv_avg, p_mt)) / arg_min(tv_avg, p_mt) * 100.0')} AS tv_change_pct,
       {fix_sql('(arg_max(vod_avg, p_mt) - arg_min(vod_avg, p_mt)) / arg_min(vod_avg, p_mt) * 100.0')} AS vod_change_pct
FROM mt"""))
def a21_trend_change(spark, sf_dir):
    mt = monthly_trend(spark, sf_dir)

    def change(c):
        first, last = F.min_by(c, "p_mt"), F.max_by(c, "p_mt")
        return fix((last - first) / first * 100.0)
    return mt.agg(F.min("p_mt").alias("first_month"), F.max("p_mt").alias("last_month"),
                  change("tv_avg").alias("tv_change_pct"), change("vod_avg").alias("vod_change_pct"))


# ---------------------------------------------------------------- A14 / W2 / L1 / P6
def class_mix_shift(log: DataFrame, labelled_users: DataFrame, labels: DataFrame | None = None,
                    top_n: int = 10, user_col: str = "user_id", label_col: str = "cancel_yn",
                    class_col: str = "ct_cl") -> DataFrame:
    """Share of each content class within each label group, for the top classes overall.

    The log is reduced to (user, class) counts before meeting the labels, so a
    heavy user contributes one row per class to the join.
    """
    per_user = log.filter(F.col(class_col).isNotNull()).groupBy(user_col, class_col) \
                  .agg(F.count(F.lit(1)).alias("_n"))
    pairs = labelled_users.select(user_col, label_col).distinct()
    cc = per_user.join(pairs, user_col, "inner").groupBy(label_col, class_col).agg(F.sum("_n").alias("cnt"))
    pct = share_within(cc, "cnt", [label_col], "_share").withColumn("pct", F.col("_share") * 100.0)
    top = (cc.groupBy(class_col).agg(F.sum("cnt").alias("_tot"))
             .orderBy(F.col("_tot").desc(), F.col(class_col)).limit(top_n))
    wide = pct.groupBy(class_col).pivot(label_col, [0, 1]).agg(F.first("pct")).fillna(0.0, subset=["0", "1"])
    out = top.join(wide, class_col, "left").fillna(0.0, subset=["0", "1"])
    label = F.col(class_col).cast("string")
    if labels is not None:  # P6: decode codes, keeping the code text when a code has no label
        out = out.join(F.broadcast(labels.select(F.col("code").alias(class_col), "label")), class_col, "left")
        label = F.coalesce(F.col("label"), label)
    return out.select(class_col, label.alias("label"), fix(F.col("0"), 2).alias("pct_keep"),
                      fix(F.col("1"), 2).alias("pct_churn"), fix(F.col("1") - F.col("0"), 2).alias("diff"))


@register("a14_class_mix_shift", with_views(f"""
pairs AS (SELECT DISTINCT user_id, cancel_yn FROM panel),
cc AS (SELECT p.cancel_yn, a.ct_cl, COUNT(*) AS cnt FROM activity a JOIN pairs p ON a.user_id = p.user_id
       WHERE a.ct_cl IS NOT NULL GROUP BY p.cancel_yn, a.ct_cl),
pc AS (SELECT cancel_yn, ct_cl, {D('cnt')} / {D('SUM(cnt) OVER (PARTITION BY cancel_yn)')} * 100.0 AS pct FROM cc),
top AS (SELECT ct_cl, SUM(cnt) AS tot FROM cc GROUP BY ct_cl ORDER BY tot DESC, ct_cl LIMIT 10)""", f"""
SELECT t.ct_cl, CAST(t.ct_cl AS VARCHAR) AS label, {fix_sql('COALESCE(p0.pct, 0.0)', 2)} AS pct_keep,
       {fix_sql('COALESCE(p1.pct, 0.0)', 2)} AS pct_churn,
       {fix_sql('COALESCE(p1.pct, 0.0) - COALESCE(p0.pct, 0.0)', 2)} AS diff
FROM top t LEFT JOIN pc p0 ON p0.ct_cl = t.ct_cl AND p0.cancel_yn = 0
LEFT JOIN pc p1 ON p1.ct_cl = t.ct_cl AND p1.cancel_yn = 1"""))
def a14_class_mix_shift(spark, sf_dir):
    return class_mix_shift(views.activity(spark, sf_dir), views.panel(spark, sf_dir))


# ---------------------------------------------------------------- A18
@register("a18_kpi_snapshot", with_views(SQL_KPI_V2, f"""
SELECT COUNT(*) AS total_customers,
       {fix_sql(MEAN_INT('cancel_yn') + ' * 100.0', 2)} AS churn_rate,
       {fix_sql(MEAN_INT('CASE WHEN vod_view_cnt > 0 THEN 1 ELSE 0 END') + ' * 100.0', 2)} AS vod_active_rate,
       {fix_sql(MEAN_INT('is_ott') + ' * 100.0', 2)} AS ott_rate
FROM kv2"""))
def a18_kpi_snapshot(spark, sf_dir):
    from tenure.plans.fixture import KPI_MONTH
    rows = _v2(spark, sf_dir).filter(F.col("p_mt") == KPI_MONTH)
    return rows.agg(F.count(F.lit(1)).alias("total_customers"),
                    fix(exact_mean("cancel_yn") * 100.0, 2).alias("churn_rate"),
                    fix(exact_mean(F.when(F.col("vod_view_cnt") > 0, 1).otherwise(0)) * 100.0, 2).alias("vod_active_rate"),
                    fix(exact_mean("is_ott") * 100.0, 2).alias("ott_rate"))


# ---------------------------------------------------------------- A19
USAGE_FLAGS = {"flag_kids": "flag_kids", "flag_movie": "flag_movie", "is_ott": "is_ott",
               "app": f"CASE WHEN {views.APP_USER} THEN 1 ELSE 0 END",
               "vod_active": "CASE WHEN vod_view_cnt > 0 THEN 1 ELSE 0 END",
               "kids_vod": "CASE WHEN kids_views > 0 THEN 1 ELSE 0 END"}


@register("a19_usage_rates", with_views(SQL_V2_ALL + ",\n" + act.SQL_KIDS, "SELECT cancel_yn, " + ", ".join(
    f"{fix_sql(MEAN_INT(e) + ' * 100.0')} AS {k}_pct" for k, e in USAGE_FLAGS.items()) + " FROM v2x LEFT JOIN kids USING (user_id, p_mt) GROUP BY cancel_yn"))
def a19_usage_rates(spark, sf_dir):
    one = lambda cond: F.when(cond, 1).otherwise(0)
    kids = act.kids_views(views.activity(spark, sf_dir, with_month=True))
    v2 = attach(_v2(spark, sf_dir), kids, ["user_id", "p_mt"], {"kids_views": 0}).withColumns({"vod_active": one(F.col("vod_view_cnt") > 0), "app": one(F.expr(views.APP_USER)),
                                         "kids_vod": one(F.col("kids_views") > 0)})
    return v2.groupBy("cancel_yn").agg(*[fix(exact_mean(k) * 100.0).alias(f"{k}_pct") for k in USAGE_FLAGS])


# ---------------------------------------------------------------- A20
OVERLAP = {"kids": "flag_kids = 1", "movie": "flag_movie = 1", "ott": "is_ott = 1", "app": views.APP_USER,
           "none": f"flag_kids = 0 AND flag_movie = 0 AND is_ott = 0 AND NOT {views.APP_USER}"}


@register("a20_overlapping_segments", with_views(SQL_V2_ALL, " UNION ALL ".join(
    f"SELECT '{k}' AS segment, COUNT(*) AS n, {fix_sql(MEAN_INT('cancel_yn') + ' * 100.0')} AS churn_pct, "
    f"{MEAN_INT('vod_view_cnt')} AS measure_avg FROM v2x WHERE {cond}" for k, cond in OVERLAP.items())))
def a20_overlapping_segments(spark, sf_dir):
    v2 = _v2(spark, sf_dir)
    c = F.col
    app = F.expr(views.APP_USER)
    segs = {"kids": c("flag_kids") == 1, "movie": c("flag_movie") == 1, "ott": c("is_ott") == 1, "app": app,
            "none": (c("flag_kids") == 0) & (c("flag_movie") == 0) & (c("is_ott") == 0) & ~app}
    return seg.overlapping_segments(v2, segs)


# ---------------------------------------------------------------- A25
def grouped_histogram(df: DataFrame, value_col: str, group_col: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram per group over the group's own [min, max], with density.

    One small aggregate gives each group's range (one row per group, for a
    label with few values, so it is broadcast); bins are then counted in one grouped aggregate. Empty bins
    are not emitted.
    """
    x = df.select(F.col(group_col), F.col(value_col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    rng = x.groupBy(group_col).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), F.count(F.lit(1)).alias("_n"))
    rng = rng.select(group_col, "_n",
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    rng = rng.withColumn("_w", (F.col("_hi") - F.col("_lo")) / float(bins))
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))),
                F.lit(bins - 1)).cast("int")
    counted = x.join(F.broadcast(rng), group_col, "inner").groupBy(group_col, b.alias("bin"), "_lo", "_w", "_n") \
               .agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(group_col, "bin", fix(F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo"), "cnt",
                          fix(F.col("cnt") / (F.col("_n") * F.col("_w"))).alias("density"))


@register("a25_histogram", with_views(SQL_V2_ALL + f""",
lx AS (SELECT cancel_yn, {fix_sql('LN(1 + total_watch_time)')} AS x FROM v2x),
rng AS (SELECT cancel_yn, COUNT(*) AS n,
               CASE WHEN MIN(x) = MAX(x) THEN MIN(x) - 0.5 ELSE MIN(x) END AS lo,
               CASE WHEN MIN(x) = MAX(x) THEN MAX(x) + 0.5 ELSE MAX(x) END AS hi
        FROM lx WHERE x IS NOT NULL GROUP BY cancel_yn),
b AS (SELECT lx.cancel_yn, CAST(LEAST(FLOOR((x - lo) * ({D('40.0')} / (hi - lo))), 39) AS INT) AS bin,
             lo, (hi - lo) / {D('40.0')} AS w, n
      FROM lx JOIN rng ON lx.cancel_yn = rng.cancel_yn WHERE x IS NOT NULL)""", f"""
SELECT cancel_yn, bin, {fix_sql('lo + bin * w')} AS bin_lo, COUNT(*) AS cnt, {fix_sql('COUNT(*) / (n * w)')} AS density
FROM b GROUP BY cancel_yn, bin, lo, w, n"""))
def a25_histogram(spark, sf_dir):
    return grouped_histogram(_v2(spark, sf_dir), "log_watch_time", "cancel_yn", 40)


# ---------------------------------------------------------------- A26
@register("a26_category_counts", with_views(SQL_V2_ALL, """
SELECT last_view_grp, CAST(last_view_grp AS VARCHAR) AS label,
       COUNT(*) FILTER (WHERE cancel_yn = 0) AS cnt_keep, COUNT(*) FILTER (WHERE cancel_yn = 1) AS cnt_churn
FROM v2x GROUP BY last_view_grp"""))
def a26_category_counts(spark, sf_dir):
    v2 = _v2(spark, sf_dir)
    wide = v2.groupBy("last_view_grp").pivot("cancel_yn", [0, 1]).agg(F.count(F.lit(1))).fillna(0, subset=["0", "1"])
    return wide.select("last_view_grp", F.col("last_view_grp").cast("string").alias("label"),
                       F.col("0").cast("bigint").alias("cnt_keep"), F.col("1").cast("bigint").alias("cnt_churn"))


# ---------------------------------------------------------------- A27
@register("a27_target_rate", with_views(SQL_V2_ALL, f"""
SELECT risk_kids_ott, {MEAN_INT('cancel_yn')} AS churn_rate, COUNT(*) AS n FROM v2x GROUP BY risk_kids_ott"""))
def a27_target_rate(spark, sf_dir):
    return _rate(_v2(spark, sf_dir), "risk_kids_ott")


# ---------------------------------------------------------------- P13
@register("p13_key_lookup", with_views(SQL_SCORED + """,
pick AS (SELECT user_id FROM sc ORDER BY churn_risk DESC, user_id LIMIT 1)""", """
SELECT sc.* FROM sc JOIN pick ON sc.user_id = pick.user_id"""))
def p13_key_lookup(spark, sf_dir):
    """Look up one customer's scored row by key: the highest-risk customer of the snapshot month."""
    # a snapshot has one row per customer, so the top row is the customer's row: one top-1 in the same plan
    return scored(spark, sf_dir).orderBy(F.col("churn_risk").desc(), F.col("user_id")).limit(1)
