"""Registered queries: seeded samples, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.operators.joins import attach
from tenure.operators.sampling import (class_ratio_sample, hash32_sql, rule_samples, seeded_sample, stratified_folds,
                                       stratified_split)
from tenure.plans import datasets as ds
from tenure.plans.fixture import KPI_MONTH, REF_DATE, SEED, YEAR_END, YEAR_START
from tenure.plans.q_activity import MONTH_SQL, SQL_FR, SQL_V1, SQL_V1AGG, SQL_V2
from tenure.plans.registry import register, with_views
from tenure.sources import views

USER_HASH = hash32_sql("CAST(user_id AS VARCHAR)", SEED)
ROW_KEY = "CAST(user_id AS VARCHAR) || '|' || CAST(p_mt AS VARCHAR)"
ROW_HASH = hash32_sql(ROW_KEY, SEED)


# ---------------------------------------------------------------- L2
@register("l2_class_ratio_sample", with_views("""
cnt AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE cancel_yn = 0) AS n0,
               COUNT(*) FILTER (WHERE cancel_yn = 1) AS n1 FROM panel),
tgt AS (SELECT n0, n1, CAST(TRUNC(CAST(total AS DOUBLE) * CAST(0.05 AS DOUBLE)) AS BIGINT) AS tt FROM cnt),
th AS (SELECT
  CAST(TRUNC(CAST(CAST(TRUNC(CAST(tt AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS DOUBLE)
             / CAST(n0 AS DOUBLE) * CAST(10000 AS DOUBLE)) AS BIGINT) AS t0,
  CAST(TRUNC(CAST(CAST(TRUNC(CAST(tt AS DOUBLE) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS DOUBLE)
             / CAST(n1 AS DOUBLE) * CAST(10000 AS DOUBLE)) AS BIGINT) AS t1 FROM tgt)""", f"""
SELECT p.* FROM panel p JOIN th ON TRUE
WHERE (p.cancel_yn = 0 AND {USER_HASH.replace('user_id', 'p.user_id')} % 10000 < th.t0)
   OR (p.cancel_yn = 1 AND {USER_HASH.replace('user_id', 'p.user_id')} % 10000 < th.t1)"""))
def l2_class_ratio_sample(spark, sf_dir):
    return class_ratio_sample(views.panel(spark, sf_dir), "cancel_yn", "user_id", 0.05, {0: 0.8, 1: 0.2}, SEED)


# ---------------------------------------------------------------- L3 / L4
SQL_YEAR_ROWS = f"yrows AS (SELECT * FROM panel WHERE p_mt BETWEEN {YEAR_START} AND {YEAR_END})"


@register("l3_seeded_sample", with_views(SQL_YEAR_ROWS, f"""
SELECT * FROM yrows ORDER BY {ROW_HASH}, user_id, p_mt LIMIT 500"""))
def l3_seeded_sample(spark, sf_dir):
    rows = views.panel(spark, sf_dir, months=(YEAR_START, YEAR_END))
    return seeded_sample(rows, 500, ["user_id", "p_mt"], SEED)


# Size of the L4 sample; below every panel it is registered on, so that it always samples.
SIMPLE_SAMPLE_ROWS = 1_000


@register("l4_simple_sample", with_views("", f"""
SELECT * FROM panel ORDER BY {ROW_HASH}, user_id, p_mt LIMIT {SIMPLE_SAMPLE_ROWS}"""))
def l4_simple_sample(spark, sf_dir, n=SIMPLE_SAMPLE_ROWS):
    """L4: a seeded sample of min(n, rows) panel rows (the modeling sample)."""
    return seeded_sample(views.panel(spark, sf_dir), n, ["user_id", "p_mt"], SEED)


# ---------------------------------------------------------------- L5
@register("l5_train_val_split", with_views("", f"""
SELECT user_id, p_mt, cancel_yn,
       ROW_NUMBER() OVER (PARTITION BY cancel_yn ORDER BY {ROW_HASH}, user_id, p_mt)
         <= CEIL(COUNT(*) OVER (PARTITION BY cancel_yn) * CAST(0.2 AS DOUBLE)) AS is_val
FROM panel"""))
def l5_train_val_split(spark, sf_dir):
    rows = views.panel(spark, sf_dir).select("user_id", "p_mt", "cancel_yn")
    return stratified_split(rows, "cancel_yn", ["user_id", "p_mt"], 0.2, SEED)


# ---------------------------------------------------------------- L6
@register("l6_stratified_folds", with_views("", f"""
SELECT user_id, p_mt, cancel_yn,
       CAST((ROW_NUMBER() OVER (PARTITION BY cancel_yn ORDER BY {ROW_HASH}, user_id, p_mt) - 1) % 5 + 1 AS INT) AS fold
FROM panel"""))
def l6_stratified_folds(spark, sf_dir):
    rows = views.panel(spark, sf_dir).select("user_id", "p_mt", "cancel_yn")
    return stratified_folds(rows, "cancel_yn", ["user_id", "p_mt"], 5, SEED)


# ---------------------------------------------------------------- L7 / J11 / P14
SQL_KPI_PURCHASE = f"""kbase AS (SELECT * FROM panel WHERE p_mt = {KPI_MONTH}),
kmonthly AS (
  SELECT a.user_id, {MONTH_SQL} AS p_mt, COUNT(*) FILTER (WHERE c.asset_prod = 1) AS rvod_cnt
  FROM activity a JOIN (SELECT DISTINCT user_id FROM kbase) u ON a.user_id = u.user_id
  LEFT JOIN content c ON a.asset = c.asset_id
  WHERE a.strt_dt IS NOT NULL AND {MONTH_SQL} BETWEEN {YEAR_START} AND {YEAR_END}
  GROUP BY a.user_id, {MONTH_SQL}),
kpurchase AS (
  SELECT b.user_id, MAX(CAST(COALESCE(m.rvod_cnt, 0) AS BIGINT)) AS vod_purchase_cnt,
         MAX(CAST(COALESCE(l.rvod_cnt, 0) AS BIGINT)) AS lagged_rvod_cnt
  FROM kbase b LEFT JOIN kmonthly m ON b.user_id = m.user_id AND b.p_mt = m.p_mt
  LEFT JOIN kmonthly l ON b.user_id = l.user_id
       AND l.p_mt = CASE WHEN b.p_mt % 100 = 1 THEN b.p_mt - 89 ELSE b.p_mt - 1 END
  GROUP BY b.user_id)"""
SQL_KPI_V2 = ",\n".join([SQL_V1AGG, SQL_V1, SQL_FR, SQL_V2]) + f""",
kv2 AS (SELECT *, CASE WHEN ott_yn THEN 1 ELSE 0 END AS is_ott FROM v2 WHERE p_mt = {KPI_MONTH})"""


def kpi_rows(spark, sf_dir):
    """Churn v2 rows of the snapshot month with that month's purchase target and lag.

    The purchase side is reduced to one row per user before the user-only
    merge, so duplicate (user, month) keys cannot multiply rows (trap 13).
    """
    panel, log, content = views.panel(spark, sf_dir), views.activity(spark, sf_dir), views.content(spark, sf_dir)
    v2 = ds.churn_v1v2(panel, log, REF_DATE).filter(F.col("p_mt") == KPI_MONTH)
    kbase = panel.filter(F.col("p_mt") == KPI_MONTH)
    year_log = views.activity(spark, sf_dir, months=(YEAR_START, YEAR_END))
    purchase = ds.purchase(kbase, year_log, content, YEAR_START, YEAR_END) \
        .groupBy("user_id").agg(F.max("vod_purchase_cnt").alias("vod_purchase_cnt"),
                                F.max("lagged_rvod_cnt").alias("lagged_rvod_cnt"))
    return attach(v2, purchase, "user_id", {"vod_purchase_cnt": 0, "lagged_rvod_cnt": 0})


L7_COLS = ("user_id, p_mt, cancel_yn, last_view_grp, CAST(voc_yn AS INT) AS voc_yn, "
           "CAST(voc_cancel_yn AS INT) AS voc_cancel_yn, CAST(ott_yn AS INT) AS ott_yn, is_ott, recency, "
           "vod_view_cnt, vod_asset_cnt")


def _grp_sql(name, cond, n, seed):
    h = hash32_sql("CAST(user_id AS VARCHAR)", seed)
    return f"(SELECT '{name}' AS grp, * FROM kv2 WHERE {cond} ORDER BY {h}, user_id LIMIT {n})"


@register("l7_rule_sample", with_views(SQL_KPI_V2 + ",\n" + SQL_KPI_PURCHASE + ",\npicked AS (" + " UNION ALL ".join([
    _grp_sql("high", "last_view_grp >= 4 AND voc_cancel_yn", 2, 42),
    _grp_sql("mid", "last_view_grp BETWEEN 2 AND 3 AND is_ott = 1", 1, 1),
    _grp_sql("low", "last_view_grp <= 1 AND NOT COALESCE(voc_yn, FALSE) AND vod_view_cnt > 0", 2, 7)]) + ")", f"""
SELECT grp, {L7_COLS.replace('user_id,', 'p.user_id AS user_id,', 1)},
       COALESCE(k.lagged_rvod_cnt, 0) AS lagged_rvod_cnt, COALESCE(k.vod_purchase_cnt, 0) AS vod_purchase_cnt
FROM picked p LEFT JOIN kpurchase k ON p.user_id = k.user_id"""))
def l7_rule_sample(spark, sf_dir):
    c = F.col
    groups = [
        ("high", (c("last_view_grp") >= 4) & c("voc_cancel_yn"), 2, 42),
        ("mid", c("last_view_grp").between(2, 3) & (c("is_ott") == 1), 1, 1),
        ("low", (c("last_view_grp") <= 1) & ~F.coalesce(c("voc_yn"), F.lit(False)) & (c("vod_view_cnt") > 0), 2, 7),
    ]
    picked = rule_samples(kpi_rows(spark, sf_dir), groups, ["user_id"])
    # Booleans to ints for export
    return picked.select("grp", "user_id", "p_mt", "cancel_yn", "last_view_grp",
                         *[c(b).cast("int").alias(b) for b in ("voc_yn", "voc_cancel_yn", "ott_yn")],
                         "is_ott", "recency", "vod_view_cnt", "vod_asset_cnt", "lagged_rvod_cnt", "vod_purchase_cnt")


# ---------------------------------------------------------------- L8
@register("l8_title_peek", with_views("", f"""
SELECT asset_nm FROM (SELECT DISTINCT asset_nm FROM content WHERE asset_nm IS NOT NULL)
ORDER BY {hash32_sql('asset_nm', SEED)}, asset_nm LIMIT 20"""))
def l8_title_peek(spark, sf_dir):
    titles = views.content(spark, sf_dir).filter(F.col("asset_nm").isNotNull()).select("asset_nm").distinct()
    return seeded_sample(titles, 20, ["asset_nm"], SEED)
