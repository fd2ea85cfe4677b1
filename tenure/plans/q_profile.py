"""Registered queries: profiling, type inference, cleaning and build summaries.

Covers A1, A15-A17, A23, A24, P1-P6, Q8.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.functions.numeric import exact_mean, fix, fix_sql, mean
from tenure.operators import profile as prof
from tenure.operators.sampling import hash32_sql, seeded_sample
from tenure.plans import datasets as ds
from tenure.plans.fixture import REF_DATE
from tenure.plans.registry import ORACLES, QUERIES, register, with_views
from tenure.sources import views
from tenure.sources.views import ORACLE_RAW_PANEL, RAW_PANEL_COLUMNS

from tenure.plans import q_activity  # noqa: F401  (registers the datasets reused below)


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _render_sql(name, typ):
    return f"printf('%.6f', {name})" if typ == "DOUBLE" else f"CAST({name} AS VARCHAR)"


def _profile_sql(table, cols):
    parts = []
    for name, typ in cols:
        parts.append(f"""
SELECT '{table}' AS table_name, '{name}' AS column_name, '{typ}' AS data_type,
       COUNT(*) - COUNT({name}) AS null_cnt, COUNT(DISTINCT {name}) AS unique_cnt,
       {fix_sql(f"CAST(COUNT(*) - COUNT({name}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0", 2)} AS missing_rate_pct,
       (SELECT COALESCE(string_agg(s, ', ' ORDER BY k), '') FROM (
          SELECT DISTINCT {name} AS k, {_render_sql(name, typ)} AS s FROM {table} WHERE {name} IS NOT NULL
          ORDER BY k LIMIT 20))
       || CASE WHEN COUNT(DISTINCT {name}) > 20
               THEN ', ... (' || CAST(COUNT(DISTINCT {name}) AS VARCHAR) || ' total, 20 shown)' ELSE '' END
         AS first_values
FROM {table}""")
    return "prof AS (" + " UNION ALL ".join(parts) + ")"


SQL_PROFILE = ORACLE_RAW_PANEL + ",\n" + _profile_sql("raw_panel", RAW_PANEL_COLUMNS)


def _raw_profile(spark, sf_dir):
    return prof.schema_profile(views.raw_panel(spark, sf_dir), "raw_panel")


# ---------------------------------------------------------------- A1
@register("a1_schema_profile", with_views(SQL_PROFILE, "SELECT * FROM prof"))
def a1_schema_profile(spark, sf_dir):
    return prof.profile_text(_raw_profile(spark, sf_dir))


# ---------------------------------------------------------------- P1
@register("p1_column_drop", with_views(SQL_PROFILE, """
SELECT table_name, column_name, NOT (missing_rate_pct >= 70) AND NOT (unique_cnt <= 1) AS keep,
       CASE WHEN missing_rate_pct >= 70 THEN 'missing' WHEN unique_cnt <= 1 THEN 'single_value' ELSE '' END AS reason
FROM prof"""))
def p1_column_drop(spark, sf_dir):
    return prof.column_drops(_raw_profile(spark, sf_dir))


# ---------------------------------------------------------------- P2
def _infer_sql(name, typ):
    return f"""
SELECT '{name}' AS column_name, '{typ}' AS source_type,
  CASE WHEN '{typ}' IN ('BIGINT', 'INTEGER', 'DOUBLE', 'BOOLEAN') THEN '{typ}'
       WHEN '{typ}' <> 'VARCHAR' OR COUNT(v) = 0 THEN 'VARCHAR'
       WHEN bool_and(upper(trim(v)) IN ('Y', 'N', 'YES', 'NO', 'T', 'F', '1', '0', '')) THEN 'BOOLEAN'
       WHEN bool_or(trim(v) <> '') AND NOT bool_or(trim(v) <> '' AND contains(v, '.'))
            AND bool_and(trim(v) IN ('', '.', '-') OR TRY_CAST(trim(v) AS BIGINT) IS NOT NULL) THEN 'BIGINT'
       WHEN bool_or(trim(v) <> '') AND bool_and(trim(v) = '' OR TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL) THEN 'DOUBLE'
       WHEN MAX(u) > 1 AND MAX(u) <= 500 THEN 'CATEGORY' ELSE 'VARCHAR' END AS target_type
FROM (SELECT CAST(v AS VARCHAR) AS v, u FROM
        (SELECT DISTINCT {name} AS v FROM raw_panel WHERE {name} IS NOT NULL ORDER BY v LIMIT 20)
        JOIN (SELECT COUNT(DISTINCT {name}) AS u FROM raw_panel) ON TRUE)"""


SQL_TYPES = ORACLE_RAW_PANEL + ",\ntypes AS (" + " UNION ALL ".join(_infer_sql(n, t) for n, t in RAW_PANEL_COLUMNS) + ")"


@register("p2_type_inference", with_views(SQL_TYPES, "SELECT * FROM types"))
def p2_type_inference(spark, sf_dir):
    types = prof.infer_types(views.raw_panel(spark, sf_dir), _raw_profile(spark, sf_dir))
    return spark.createDataFrame([(c, s, t) for c, (s, t) in types.items()],
                                 "column_name string, source_type string, target_type string")


# ---------------------------------------------------------------- P3 / P4 / P5
def cleaned_panel(spark, sf_dir):
    raw = views.raw_panel(spark, sf_dir)
    profile = prof.schema_profile(raw, "raw_panel")
    keep = [r["column_name"] for r in prof.column_drops(profile).filter("keep").select("column_name").collect()]
    order = [c for c in raw.columns if c in keep]
    types = prof.infer_types(raw, profile.filter(F.col("column_name").isin(order)))
    cats = [c for c, (_, t) in types.items() if t == "CATEGORY"]
    dictionary = prof.category_dictionary(raw, cats)
    return prof.clean(raw, types, dictionary, keep=order), dictionary


def _bool_sql(c):
    return (f"CASE WHEN UPPER(TRIM({c})) IN ('Y', 'YES', 'T', '1') THEN TRUE "
            f"WHEN UPPER(TRIM({c})) IN ('N', 'NO', 'F', '0') THEN FALSE ELSE NULL END")


SQL_DICT = """dict AS (SELECT 'view_grp' AS "column", v AS value, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INT) AS code
                FROM (SELECT DISTINCT view_grp AS v FROM raw_panel WHERE view_grp IS NOT NULL))"""
SQL_CLEAN = ORACLE_RAW_PANEL + ",\n" + SQL_DICT + f""",
clean AS (
  SELECT TRY_CAST(TRIM(r.user_id) AS BIGINT) AS user_id, TRY_CAST(TRIM(r.p_mt) AS BIGINT) AS p_mt,
         {_bool_sql('r.cancel_yn')} AS cancel_yn, r.tv_hours, {_bool_sql('r.ott_yn')} AS ott_yn,
         {_bool_sql('r.voc_yn')} AS voc_yn, {_bool_sql('r.voc_cancel_yn')} AS voc_cancel_yn,
         d.code AS view_grp, TRY_CAST(TRIM(r.agmt_seg) AS BIGINT) AS agmt_seg
  FROM raw_panel r LEFT JOIN dict d ON TRIM(r.view_grp) = d.value)"""


@register("p3_p5_clean_panel", with_views(SQL_CLEAN, "SELECT * FROM clean"))
def p3_p5_clean_panel(spark, sf_dir):
    return cleaned_panel(spark, sf_dir)[0]


@register("p5_category_map", with_views(ORACLE_RAW_PANEL + ",\n" + SQL_DICT, "SELECT * FROM dict"))
def p5_category_map(spark, sf_dir):
    return cleaned_panel(spark, sf_dir)[1]


# ---------------------------------------------------------------- P6
@register("p6_decoded_counts", with_views(SQL_CLEAN, """
SELECT COALESCE(d.value, CAST(c.view_grp AS VARCHAR)) AS view_grp_label, COUNT(*) AS cnt
FROM clean c LEFT JOIN dict d ON c.view_grp = d.code GROUP BY 1"""))
def p6_decoded_counts(spark, sf_dir):
    cleaned, dictionary = cleaned_panel(spark, sf_dir)
    decoded = prof.decode(cleaned, "view_grp", dictionary, "view_grp_label")
    return decoded.groupBy("view_grp_label").agg(F.count(F.lit(1)).alias("cnt"))


# ---------------------------------------------------------------- A15 / L1
@register("a15_top_assets", with_views("", """
SELECT asset, COUNT(*) AS cnt FROM activity GROUP BY asset ORDER BY cnt DESC, asset NULLS FIRST LIMIT 20"""))
def a15_top_assets(spark, sf_dir):
    return prof.top_values(views.activity(spark, sf_dir), "asset", 20)


# ---------------------------------------------------------------- A16
V1_NUMERIC = ["tv_hours", "vod_view_cnt", "vod_use_tms_sum", "vod_asset_cnt"]


def _v1(spark, sf_dir):
    return ds.churn_v1(views.panel(spark, sf_dir), views.activity(spark, sf_dir))


def _v1_sql():
    return with_views(q_activity.SQL_V1AGG + ",\n" + q_activity.SQL_V1, "SELECT * FROM v1")


def _iqr_sql(c):
    return f"""
SELECT '{c}' AS "column", {fix_sql('q1')} AS q1, {fix_sql('q3')} AS q3, {fix_sql('q3 - q1')} AS iqr,
       {fix_sql('q1 - 1.5 * (q3 - q1)')} AS lower, {fix_sql('q3 + 1.5 * (q3 - q1)')} AS upper,
       COUNT(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers,
       {fix_sql(f"CAST(COUNT(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0")} AS pct
FROM v1 JOIN (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM v1) ON TRUE
WHERE {c} IS NOT NULL GROUP BY q1, q3"""


@register("a16_iqr_outliers", with_views(q_activity.SQL_V1AGG + ",\n" + q_activity.SQL_V1,
                                         " UNION ALL ".join(_iqr_sql(c) for c in V1_NUMERIC)))
def a16_iqr_outliers(spark, sf_dir):
    return prof.iqr_outliers(_v1(spark, sf_dir), V1_NUMERIC)


# ---------------------------------------------------------------- A17
def _num_sql(c):
    return f"""
SELECT '{c}' AS "column", {fix_sql(f'1.0 - CAST(COUNT({c}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)')} AS missing,
       COUNT(DISTINCT {c}) AS n_unique, {fix_sql(f'AVG({D(c)})')} AS mean, {fix_sql(f'STDDEV_SAMP({D(c)})')} AS std,
       {D(f'MIN({c})')} AS min, {D(f'MAX({c})')} AS max,
       {fix_sql(f'quantile_cont({D(c)}, 0.25)')} AS p25, {fix_sql(f'quantile_cont({D(c)}, 0.5)')} AS p50,
       {fix_sql(f'quantile_cont({D(c)}, 0.75)')} AS p75
FROM v1"""


@register("a17_numeric_profile", with_views(q_activity.SQL_V1AGG + ",\n" + q_activity.SQL_V1,
                                            " UNION ALL ".join(_num_sql(c) for c in V1_NUMERIC)))
def a17_numeric_profile(spark, sf_dir):
    return prof.numeric_profile(_v1(spark, sf_dir), V1_NUMERIC)


V1_TEXT = ["ott_yn", "voc_yn", "voc_cancel_yn"]


@register("a17_top_values", with_views(q_activity.SQL_V1AGG + ",\n" + q_activity.SQL_V1 + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM v1 WHERE {c} IS NOT NULL" for c in V1_TEXT) + """),
cnt AS (SELECT "column", value, COUNT(*) AS cnt FROM long GROUP BY "column", value)""", """
SELECT * FROM (SELECT "column", value, cnt, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rank
               FROM cnt) WHERE rank <= 5"""))
def a17_top_values(spark, sf_dir):
    return prof.top_k_text(_v1(spark, sf_dir), V1_TEXT, 5)


# ---------------------------------------------------------------- Q8
@register("q8_profile_warnings", with_views(SQL_PROFILE, """
SELECT column_name, issue, CASE WHEN issue = 'missing_over_30' THEN 'warn' ELSE 'drop' END AS action FROM (
  SELECT column_name, CASE WHEN missing_rate_pct > 70 THEN 'missing_over_70' ELSE 'missing_over_30' END AS issue
  FROM prof WHERE missing_rate_pct > 30
  UNION ALL SELECT column_name, 'single_value' FROM prof WHERE unique_cnt <= 1)
UNION ALL
SELECT 'cancel_yn', 'target_ratio_off', 'check_sampling' FROM panel
HAVING ABS(CAST(SUM(cancel_yn) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) - 0.2) > 0.05"""))
def q8_profile_warnings(spark, sf_dir):
    panel = views.panel(spark, sf_dir)
    ratio = panel.agg(exact_mean("cancel_yn")).first()[0]
    return prof.profile_warnings(_raw_profile(spark, sf_dir), target_pos_ratio=ratio)


# ---------------------------------------------------------------- A23
CHANNEL_FEATURES = ["log_vod_time", "adult", "fod", "trend"]


@register("a23_fill_summary", with_views("", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {fix_sql(f'AVG({c})')} AS mean, "
    f"CAST(COUNT(*) FILTER (WHERE {c} > 0) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS nonzero_share "
    f"FROM ({ORACLES['a9_channel_dataset']})" for c in CHANNEL_FEATURES)))
def a23_fill_summary(spark, sf_dir):
    ch = QUERIES["a9_channel_dataset"](spark, sf_dir)
    from tenure.operators.quantiles import melt
    long = melt(ch, CHANNEL_FEATURES, "feature", "value")
    return long.groupBy("feature").agg(
        mean("value").alias("mean"),
        (F.count_if(F.col("value") > 0).cast("double") / F.count(F.lit(1)).cast("double")).alias("nonzero_share"))


# ---------------------------------------------------------------- A24
@register("a24_purchase_summary", with_views("", f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE vod_purchase_cnt > 0) AS purchasers,
       CAST(SUM(vod_purchase_cnt) AS DOUBLE) / CAST(COUNT(vod_purchase_cnt) AS DOUBLE) AS avg_purchase,
       MAX(vod_purchase_cnt) AS max_purchase
FROM ({ORACLES['j6_purchase_dataset']})"""))
def a24_purchase_summary(spark, sf_dir):
    pdf = QUERIES["j6_purchase_dataset"](spark, sf_dir)
    return pdf.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("vod_purchase_cnt") > 0).alias("purchasers"),
                   exact_mean("vod_purchase_cnt").alias("avg_purchase"), F.max("vod_purchase_cnt").alias("max_purchase"))


@register("a24_flag_summary", with_views("", "SELECT COUNT(*) AS n, " + ", ".join(
    f"COUNT(*) FILTER (WHERE {c} = 1) AS {c}_cnt, "
    f"{fix_sql(f'CAST(COUNT(*) FILTER (WHERE {c} = 1) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0')} AS {c}_pct"
    for c in ("flag_kids", "flag_movie", "risk_kids_ott")) + f" FROM ({ORACLES['a3_a4_churn_v2']})"))
def a24_flag_summary(spark, sf_dir):
    v2 = QUERIES["a3_a4_churn_v2"](spark, sf_dir)
    cols = [F.count(F.lit(1)).alias("n")]
    for c in ("flag_kids", "flag_movie", "risk_kids_ott"):
        cols += [F.count_if(F.col(c) == 1).alias(f"{c}_cnt"),
                 fix(F.count_if(F.col(c) == 1).cast("double") / F.count(F.lit(1)).cast("double") * 100.0).alias(f"{c}_pct")]
    return v2.agg(*cols)


@register("a24_trend_summary", with_views("", f"""
SELECT CAST(SUM(trend_watch_cnt) AS DOUBLE) / CAST(COUNT(trend_watch_cnt) AS DOUBLE) AS avg_trend_cnt,
       {fix_sql('AVG(trend_watch_ratio)')} AS avg_trend_ratio,
       CAST(SUM(trend_flag) AS DOUBLE) / CAST(COUNT(trend_flag) AS DOUBLE) AS trend_flag_rate,
       COUNT(*) FILTER (WHERE trend_watch_cnt > 0) AS users_with_trend
FROM ({ORACLES['a8_churn_v3']})"""))
def a24_trend_summary(spark, sf_dir):
    v3 = QUERIES["a8_churn_v3"](spark, sf_dir)
    return v3.agg(exact_mean("trend_watch_cnt").alias("avg_trend_cnt"), mean("trend_watch_ratio").alias("avg_trend_ratio"),
                  exact_mean("trend_flag").alias("trend_flag_rate"),
                  F.count_if(F.col("trend_watch_cnt") > 0).alias("users_with_trend"))


_ = (REF_DATE, _v1_sql)


# ---------------------------------------------------------------- A1 sample rows
RAW_KEY_SQL = "user_id || '|' || p_mt"


@register("a1_sample_rows", with_views(ORACLE_RAW_PANEL, f"""
SELECT * FROM raw_panel ORDER BY {hash32_sql(RAW_KEY_SQL, 42)}, user_id, p_mt LIMIT 20"""))
def a1_sample_rows(spark, sf_dir):
    """A1's 20 sample rows, drawn by seeded hash order (the reference took whatever rows came first)."""
    return seeded_sample(views.raw_panel(spark, sf_dir), 20, ["user_id", "p_mt"], 42)


# ---------------------------------------------------------------- A17 target distribution
@register("a17_target_distribution", with_views("", """
SELECT CAST(cancel_yn AS VARCHAR) AS value, CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share
FROM panel GROUP BY cancel_yn"""))
def a17_target_distribution(spark, sf_dir):
    """Share of each target value (the label has at most 10 values; a numeric target would get describe())."""
    counts = views.panel(spark, sf_dir).groupBy("cancel_yn").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.select(F.col("cancel_yn").cast("string").alias("value"),
                         (F.col("n").cast("double") / F.lit(float(total))).alias("share"))
