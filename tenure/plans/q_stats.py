"""Registered queries: hypothesis tests, correlation, VIF and leakage checks."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions import tails
from tenure.functions.numeric import fix, fix_sig, fix_sig_sql, fix_sql
from tenure.operators import activity as act
from tenure.operators import leakage as lk
from tenure.operators import stats as st
from tenure.operators.joins import attach
from tenure.operators.encode import apply_codes, code_dictionary, median_fill
from tenure.operators.quantiles import exact_quantiles
from tenure.plans import datasets as ds
from tenure.plans.fixture import REF_DATE, SEED, YEAR_END, YEAR_START
from tenure.plans.q_activity import SQL_BASE, SQL_COUNTS, SQL_FR, SQL_V1, SQL_V1AGG, SQL_V2
from tenure.plans.registry import ORACLES, register, with_views
from tenure.session import cut_lineage
from tenure.sources import views


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


NUMERIC = ["tv_hours", "vod_view_cnt", "vod_use_tms_sum", "vod_asset_cnt", "recency", "total_watch_time",
           "log_watch_time"]
CATEGORICAL = ["last_view_grp", "agmt_end_seg", "ott_yn", "voc_yn", "voc_cancel_yn", "flag_kids", "flag_movie"]
SQL_V2X = ",\n".join([SQL_V1AGG, SQL_V1, SQL_FR, SQL_V2]) + f""",
v2x AS (SELECT *, {fix_sql('LN(1 + total_watch_time)')} AS log_watch_time FROM v2)"""


def _v2(spark, sf_dir) -> DataFrame:
    panel, log = views.panel(spark, sf_dir), views.activity(spark, sf_dir)
    return ds.churn_v1v2(panel, log, REF_DATE)


# ---------------------------------------------------------------- T1 / T2 / T8
def _moments_sql(c):
    m0, m1 = f"AVG(CASE WHEN cancel_yn = 0 THEN {D(c)} END)", f"AVG(CASE WHEN cancel_yn = 1 THEN {D(c)} END)"
    v0, v1 = f"VAR_SAMP(CASE WHEN cancel_yn = 0 THEN {D(c)} END)", f"VAR_SAMP(CASE WHEN cancel_yn = 1 THEN {D(c)} END)"
    n0, n1 = f"COUNT(CASE WHEN cancel_yn = 0 THEN {c} END)", f"COUNT(CASE WHEN cancel_yn = 1 THEN {c} END)"
    sp2 = f"(({n0} - 1) * {v0} + ({n1} - 1) * {v1}) / ({n0} + {n1} - 2)"
    return f"""
SELECT '{c}' AS "column", {n0} AS n0, {n1} AS n1, {fix_sig_sql(m0)} AS mean0, {fix_sig_sql(m1)} AS mean1,
       {fix_sig_sql(v0)} AS var0, {fix_sig_sql(v1)} AS var1,
       {fix_sig_sql(f'({m0} - {m1}) / SQRT({v0} / {n0} + {v1} / {n1})', 9)} AS welch_t,
       {fix_sig_sql(f'({m0} - {m1}) / SQRT({sp2} * (1.0 / {n0} + 1.0 / {n1}))', 9)} AS pooled_t,
       {fix_sig_sql(f'CASE WHEN {sp2} > 0 THEN ({m1} - {m0}) / SQRT({sp2}) ELSE 0.0 END', 9)} AS cohens_d,
       ({m0} - {m1}) / SQRT({v0} / {n0} + {v1} / {n1}) AS wt, ({m0} - {m1}) / SQRT({sp2} * (1.0 / {n0} + 1.0 / {n1})) AS pt, {n0} + {n1} - 2 AS pdof,
       POW({v0} / {n0} + {v1} / {n1}, 2) / (POW({v0} / {n0}, 2) / ({n0} - 1) + POW({v1} / {n1}, 2) / ({n1} - 1)) AS wdof
FROM v2x"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


SQL_MOMENTS = "mo AS (" + " UNION ALL ".join(_moments_sql(c) for c in NUMERIC) + "),\n" + ",\n".join(
    [tails.t_two_sided_sql("wp", "mo", ['"column"'], "wt", "wdof"), tails.t_two_sided_sql("pp", "mo", ['"column"'], "pt", "pdof")])


@register("t1_t2_t8_moments", recursive(with_views(SQL_V2X + ",\n" + SQL_MOMENTS, f"""
SELECT mo.* EXCLUDE (wt, pt, wdof, pdof), {fix_sig_sql('wp.p', 7)} AS welch_p, {fix_sig_sql('pp.p', 7)} AS pooled_p
FROM mo JOIN wp ON mo."column" = wp."column" JOIN pp ON mo."column" = pp."column\"""")))
def t1_t2_t8_moments(spark, sf_dir):
    t = st.moments_table(_v2(spark, sf_dir), NUMERIC, "cancel_yn")
    # differences of close means amplify last-bit noise: effect statistics keep 9 significant digits, tails 7
    return t.select("column", "n0", "n1", *[fix_sig(c).alias(c) for c in ("mean0", "mean1", "var0", "var1")],
                    *[fix_sig(c, 9).alias(c) for c in ("welch_t", "pooled_t", "cohens_d")], *[fix_sig(c, 7).alias(c) for c in ("welch_p", "pooled_p")])


# ---------------------------------------------------------------- T3
SQL_K2 = "x3 AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", cancel_yn AS grp, {D(c)} AS x FROM v2x WHERE {c} IS NOT NULL AND cancel_yn IS NOT NULL"
    for c in NUMERIC) + """),
mu AS (SELECT "column", grp, COUNT(*) AS n, AVG(x) AS m FROM x3 GROUP BY ALL),
cm AS (SELECT "column", grp, n, AVG(POW(x - m, 2)) AS m2, AVG(POW(x - m, 3)) AS m3, AVG(POW(x - m, 4)) AS m4
       FROM x3 JOIN mu USING ("column", grp) GROUP BY ALL),
sk AS (SELECT "column", grp, n, CAST(n AS DOUBLE) AS f, CASE WHEN m2 > 0 THEN m3 / POW(m2, 1.5) END AS skew,
         CASE WHEN m2 > 0 THEN m4 / (m2 * m2) END AS kurt FROM cm),
k0 AS (SELECT *, skew / SQRT(6 * (f - 2) / ((f + 1) * (f + 3))) AS y,
         SQRT(2 * (3 * (f * f + 27 * f - 70) * (f + 1) * (f + 3) / ((f - 2) * (f + 5) * (f + 7) * (f + 9))) - 2) - 1 AS w2,
         (kurt - 3 * (f - 1) / (f + 1)) / SQRT(24 * f * (f - 2) * (f - 3) / (POW(f + 1, 2) * (f + 3) * (f + 5))) AS x,
         6 * (f * f - 5 * f + 2) / ((f + 7) * (f + 9)) * SQRT(6 * (f + 3) * (f + 5) / (f * (f - 2) * (f - 3))) AS sb FROM sk),
k1 AS (SELECT *, y / SQRT(2 / (w2 - 1)) AS ya, 6 + 8 / sb * (2 / sb + SQRT(1 + 4 / POW(sb, 2))) AS a FROM k0),
k2 AS (SELECT *, LN(ya + SQRT(ya * ya + 1)) / SQRT(0.5 * LN(w2)) AS zs,
         (1 - 2 / (9 * a) - SIGN(1 + x * SQRT(2 / (a - 4))) * POW((1 - 2 / a) / ABS(1 + x * SQRT(2 / (a - 4))), 1.0 / 3)) / SQRT(2 / (9 * a)) AS zk
       FROM k1)"""


@register("t3_normality", with_views(SQL_V2X + ",\n" + SQL_K2, f"""
SELECT "column", CAST(grp AS INT) AS "group", n, {fix_sql('skew', 9)} AS skew, {fix_sql('kurt', 9)} AS kurt,
       {fix_sig_sql('zs * zs + zk * zk', 8)} AS k2, {fix_sql('EXP(-(zs * zs + zk * zk) / 2)', 9)} AS p_value,
       COALESCE(EXP(-(zs * zs + zk * zk) / 2) > {st.ALPHA}, FALSE) AS normal
FROM k2"""))
def t3_normality(spark, sf_dir):
    t = st.normality_columns(st.group_moments(_v2(spark, sf_dir), NUMERIC, "cancel_yn"))
    return t.select("column", F.col("group").cast("int").alias("group"), "n", fix("skew", 9).alias("skew"), fix("kurt", 9).alias("kurt"),
                    fix_sig("k2", 8).alias("k2"), fix("p_value", 9).alias("p_value"),
                    F.coalesce(F.col("p_value") > st.ALPHA, F.lit(False)).alias("normal"))


# ---------------------------------------------------------------- T4 / T5 / W3 and T10
# Directed hypotheses on the purchase panel (id, split, expected sign).
HYPOTHESES = [("H1", "lagged_rvod_cnt > 0", "+"), ("H2", "svod_cnt > 0", "+"),
              ("H3", "ott_yn", "-"), ("H4", "kids_views > 0", "+"), ("H5", "cancel_yn = 1", "-")]


def _purchase(spark, sf_dir):
    months = (YEAR_START, YEAR_END)
    base = views.panel(spark, sf_dir, months=months)
    return ds.purchase(base, views.activity(spark, sf_dir, months=months), views.content(spark, sf_dir),
                       YEAR_START, YEAR_END)


def _hyp_long(spark, sf_dir):
    kids = act.kids_views(views.activity(spark, sf_dir, months=(YEAR_START, YEAR_END), with_month=True))
    pdf = cut_lineage(attach(_purchase(spark, sf_dir), kids, ["user_id", "p_mt"], {"kids_views": 0}))  # read for the cap, then for the tests
    p99 = exact_quantiles(pdf, "vod_purchase_cnt", [0.99])[0]
    y = F.least(F.col("vod_purchase_cnt").cast("double"), F.lit(float(p99)))
    items = F.array(*[F.struct(F.lit(h).alias("hypothesis"), F.coalesce(F.expr(cond), F.lit(False)).alias("is_pos")) for h, cond, _ in HYPOTHESES])
    return pdf.select(y.alias("value"), F.explode(items).alias("_h")).select("_h.hypothesis", "_h.is_pos", "value")


def _hyp_table(long):
    rs = st.rank_sums(long, group_cols=["hypothesis"])
    means = long.filter(F.col("is_pos").isNotNull()).groupBy("hypothesis").agg(
        F.avg(F.when(F.col("is_pos"), F.col("value"))).alias("mean_pos"),
        F.avg(F.when(~F.col("is_pos"), F.col("value"))).alias("mean_neg"))
    return st.mann_whitney_columns(rs).join(means, "hypothesis", "inner").select(
        "hypothesis", "n_pos", "n_neg", fix("mean_pos").alias("mean_pos"), fix("mean_neg").alias("mean_neg"),
        fix("u_pos").alias("u_pos"), fix("z").alias("z"), fix("rank_biserial").alias("rank_biserial"), fix_sig("p_value", 7).alias("p_value"))


def _hyp_sql():
    parts = []
    for h, cond, _ in HYPOTHESES:
        parts.append(f"SELECT '{h}' AS hypothesis, COALESCE({cond}, FALSE) AS is_pos, LEAST({D('vod_purchase_cnt')}, p99) AS value "
                     f"FROM pur JOIN q ON TRUE LEFT JOIN kids ON kids.user_id = pur.user_id AND kids.p_mt = pur.p_mt")
    return "long AS (" + " UNION ALL ".join(parts) + ")"


SQL_HYP = ",\n".join([SQL_BASE, SQL_COUNTS]) + """,
pur AS (
  SELECT t.*, CAST(COALESCE(l.rvod_cnt, 0) AS BIGINT) AS lagged_rvod_cnt FROM (
    SELECT b.*, CAST(COALESCE(m.rvod_cnt, 0) AS BIGINT) AS vod_purchase_cnt, CAST(COALESCE(m.svod_cnt, 0) AS BIGINT) AS svod_cnt
    FROM base b LEFT JOIN monthly m ON b.user_id = m.user_id AND b.p_mt = m.p_mt) t
  LEFT JOIN monthly l ON t.user_id = l.user_id
       AND l.p_mt = CASE WHEN t.p_mt % 100 = 1 THEN t.p_mt - 89 ELSE t.p_mt - 1 END),
""" + act.SQL_KIDS + """,
q AS (SELECT quantile_cont(CAST(vod_purchase_cnt AS DOUBLE), 0.99) AS p99 FROM pur),
""" + _hyp_sql() + """,
vc AS (SELECT hypothesis, value, COUNT(*) FILTER (WHERE is_pos) AS c1, COUNT(*) FILTER (WHERE NOT is_pos) AS c0
       FROM long WHERE value IS NOT NULL AND is_pos IS NOT NULL GROUP BY hypothesis, value),
cum AS (SELECT *, c1 + c0 AS t, SUM(c1 + c0) OVER (PARTITION BY hypothesis ORDER BY value ROWS UNBOUNDED PRECEDING) AS ct
        FROM vc),
rs AS (SELECT hypothesis, CAST(SUM(c1) AS DOUBLE) AS n1, CAST(SUM(c0) AS DOUBLE) AS n0,
              SUM(CAST(c1 AS DOUBLE) * (CAST(ct - t AS DOUBLE) + CAST(t + 1 AS DOUBLE) / 2.0)) AS r1,
              SUM(POW(CAST(t AS DOUBLE), 3) - CAST(t AS DOUBLE)) AS tie FROM cum GROUP BY hypothesis),
mm AS (SELECT hypothesis, AVG(CASE WHEN is_pos THEN value END) AS mean_pos, AVG(CASE WHEN NOT is_pos THEN value END) AS mean_neg
       FROM long WHERE is_pos IS NOT NULL GROUP BY hypothesis)"""

U1 = "(r1 - n1 * (n1 + 1) / 2.0)"


@register("t4_t5_mann_whitney", with_views(SQL_HYP, f"""
SELECT rs.hypothesis, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg,
       {fix_sql('mean_pos')} AS mean_pos, {fix_sql('mean_neg')} AS mean_neg, {fix_sql(U1)} AS u_pos,
       {fix_sql(f'(GREATEST({U1}, n1 * n0 - {U1}) - n1 * n0 / 2.0 - 0.5) / SQRT(n1 * n0 / 12.0 * ((n1 + n0 + 1) - tie / ((n1 + n0) * (n1 + n0 - 1))))')} AS z,
       {fix_sql(f'(2.0 * {U1}) / (n1 * n0) - 1.0')} AS rank_biserial
FROM rs JOIN mm ON rs.hypothesis = mm.hypothesis"""))
def t4_t5_mann_whitney(spark, sf_dir):
    return _hyp_table(_hyp_long(spark, sf_dir)).drop("p_value")


#: |z| beyond which the two-sided p falls below each level.
Z_CUTS = {mark: NormalDist().inv_cdf(1 - p / 2) for mark, p in (("***", 0.001), ("**", 0.01), ("*", 0.05))}
SQL_RESULT = f"(SELECT hypothesis, expected, mean_pos, mean_neg, 2.0 * {U1} / (n1 * n0) - 1.0 AS rb, n1, n0, " \
    f"(ABS({U1} - n1 * n0 / 2.0) - 0.5) / SQRT(n1 * n0 / 12.0 * (n1 + n0 + 1 - tie / ((n1 + n0) * (n1 + n0 - 1)))) AS z " \
    "FROM rs JOIN mm USING (hypothesis) JOIN (VALUES " + ", ".join(f"('{h}', '{e}')" for h, _, e in HYPOTHESES) + ") v(hypothesis, expected) USING (hypothesis))"
SQL_MARK = "CASE " + " ".join(f"WHEN z > {z!r} THEN '{mark}'" for mark, z in Z_CUTS.items()) + " ELSE 'ns' END"


@register("t10_decisions", with_views(SQL_HYP, f"""
SELECT hypothesis, expected, (mean_pos > mean_neg) = (expected = '+') AS direction_ok, {SQL_MARK} AS significance,
       {fix_sql('rb')} AS rank_biserial, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg,
       CASE WHEN (mean_pos > mean_neg) = (expected = '+') AND {SQL_MARK} <> 'ns' THEN 'accept' ELSE 'reject' END AS result
FROM {SQL_RESULT}"""))
def t10_decisions(spark, sf_dir):
    """T10 without p-values: direction, significance from the cut-offs of z, effect and result of each hypothesis."""
    t = _hyp_table(_hyp_long(spark, sf_dir))
    expected, mark = F.lit(None).cast("string"), F.lit("ns")
    for h, _, sign in HYPOTHESES:
        expected = F.when(F.col("hypothesis") == h, F.lit(sign)).otherwise(expected)
    for stars, z in reversed(Z_CUTS.items()):
        mark = F.when(F.col("z") > z, F.lit(stars)).otherwise(mark)
    t = t.withColumns({"expected": expected, "significance": mark})
    t = t.withColumn("direction_ok", (F.col("mean_pos") > F.col("mean_neg")) == (F.col("expected") == "+"))
    result = F.when(F.col("direction_ok") & (F.col("significance") != "ns"), "accept").otherwise("reject")
    return t.select("hypothesis", "expected", "direction_ok", "significance", "rank_biserial", "n_pos", "n_neg", result.alias("result"))


STARS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
SQL_STARS = "CASE " + " ".join(f"WHEN p_value < {p} THEN '{mark}'" for p, mark in STARS) + " ELSE 'ns' END"
SQL_HYP_P = SQL_HYP + f",\nhr AS {SQL_RESULT},\n" + tails.gamma_q_sql("hp", "hr", ["hypothesis"], "0.5", "(z * z / 2)") + f""",
hq AS (SELECT hr.*, {fix_sig_sql('CASE WHEN z <= 0 THEN 1 ELSE q END', 7)} AS p_value, (mean_pos > mean_neg) = (expected = '+') AS direction_ok
       FROM hr JOIN hp ON hr.hypothesis = hp.hypothesis)"""


@register("t10_directed_hypotheses", recursive(with_views(SQL_HYP_P, f"""
SELECT hypothesis, p_value, {SQL_STARS} AS significance, {fix_sql('rb')} AS rank_biserial, expected, direction_ok,
       CASE WHEN direction_ok AND p_value < 0.05 THEN 'accept' ELSE 'reject' END AS result, CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg
FROM hq WHERE n1 > 0 AND n0 > 0""")))
def t10_directed_hypotheses(spark, sf_dir):
    """P-value, significance, effect, direction and result of each hypothesis whose sides both have rows."""
    expected, mark = F.lit(None).cast("string"), F.lit("ns")
    for h, _, sign in HYPOTHESES:
        expected = F.when(F.col("hypothesis") == h, F.lit(sign)).otherwise(expected)
    for p, stars in reversed(STARS):
        mark = F.when(F.col("p_value") < p, F.lit(stars)).otherwise(mark)
    t = _hyp_table(_hyp_long(spark, sf_dir)).where("n_pos > 0 AND n_neg > 0").withColumns({"expected": expected, "significance": mark})
    t = t.withColumn("direction_ok", (F.col("mean_pos") > F.col("mean_neg")) == (F.col("expected") == "+"))
    return t.select("hypothesis", "p_value", "significance", "rank_biserial", "expected", "direction_ok",
                    F.when(F.col("direction_ok") & (F.col("significance") != "ns"), "accept").otherwise("reject").alias("result"), "n_pos", "n_neg")


# ---------------------------------------------------------------- T6 / T7
def _chi_sql():
    cts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, cancel_yn AS grp, COUNT(*) AS o FROM v2x "
        f"WHERE {c} IS NOT NULL AND cancel_yn IS NOT NULL GROUP BY 1, 2, 3" for c in CATEGORICAL)
    return f"""ct AS ({cts}),
vals AS (SELECT DISTINCT "column", value FROM ct), grps AS (SELECT DISTINCT "column", grp FROM ct),
grid AS (SELECT v."column", v.value, g.grp, COALESCE(ct.o, 0) AS o FROM vals v JOIN grps g ON v."column" = g."column"
         LEFT JOIN ct ON ct."column" = v."column" AND ct.value = v.value AND ct.grp = g.grp),
tot AS (SELECT "column", SUM(o) AS n, COUNT(DISTINCT value) AS r, COUNT(DISTINCT grp) AS k FROM grid GROUP BY "column"),
rt AS (SELECT "column", value, SUM(o) AS rs FROM grid GROUP BY 1, 2),
cs AS (SELECT "column", grp, SUM(o) AS cs FROM grid GROUP BY 1, 2),
ex AS (SELECT grid."column", CAST(o AS DOUBLE) AS o, CAST(rt.rs AS DOUBLE) * CAST(cs.cs AS DOUBLE) / CAST(tot.n AS DOUBLE) AS e,
              (tot.r - 1) * (tot.k - 1) AS dof
       FROM grid JOIN rt ON grid."column" = rt."column" AND grid.value = rt.value
       JOIN cs ON grid."column" = cs."column" AND grid.grp = cs.grp JOIN tot ON grid."column" = tot."column"
       WHERE tot.r >= 2 AND tot.k >= 2),
adj AS (SELECT "column", dof, e, CASE WHEN dof = 1 THEN o + LEAST(0.5, ABS(e - o)) * SIGN(e - o) ELSE o END AS oa FROM ex),
chi AS (SELECT "column", MIN(dof) AS dof, SUM((oa - e) * (oa - e) / e) AS chi2 FROM adj GROUP BY "column")"""


SQL_CHI_P = _chi_sql() + ",\n" + tails.gamma_q_sql("cp", "chi", ['"column"'], "dof / 2.0", "chi2 / 2.0")


@register("t6_t7_chi_square", recursive(with_views(SQL_V2X + ",\n" + SQL_CHI_P, f"""
SELECT chi."column", {fix_sql('chi2')} AS chi2, CAST(dof AS BIGINT) AS dof, CAST(tot.n AS BIGINT) AS n,
       {fix_sql('SQRT((chi2 / tot.n) / LEAST(tot.r - 1, tot.k - 1))')} AS cramers_v, {fix_sig_sql('q', 7)} AS p_value
FROM chi JOIN tot ON chi."column" = tot."column" JOIN cp ON chi."column" = cp."column\"""")))
def t6_t7_chi_square(spark, sf_dir):
    chi = st.chi_square_columns(st.contingency(_v2(spark, sf_dir), CATEGORICAL, "cancel_yn"))
    return chi.select("column", fix("chi2").alias("chi2"), "dof", "n", fix("cramers_v").alias("cramers_v"), fix_sig("p_value", 7).alias("p_value"))


# ---------------------------------------------------------------- T9
TESTS = len(NUMERIC) + len(CATEGORICAL)
SQL_SWEEP = ",\n".join([SQL_V2X, SQL_K2, SQL_MOMENTS, SQL_CHI_P]) + """,
nm AS (SELECT "column", BOOL_AND(COALESCE(EXP(-(zs * zs + zk * zk) / 2) > 0.05, FALSE)) AS normal FROM k2 WHERE grp IN (0, 1) GROUP BY 1),
rv AS (SELECT "column", x, COUNT(*) FILTER (WHERE grp = 0) AS c1, COUNT(*) AS t FROM x3 GROUP BY 1, 2),
rc AS (SELECT *, SUM(t) OVER (PARTITION BY "column" ORDER BY x ROWS UNBOUNDED PRECEDING) AS ct FROM rv),
ru AS (SELECT "column", CAST(SUM(c1) AS DOUBLE) AS n1, CAST(SUM(t) - SUM(c1) AS DOUBLE) AS n0, SUM(CAST(c1 AS DOUBLE) * (CAST(ct - t AS DOUBLE) + CAST(t + 1 AS DOUBLE) / 2.0)) AS r1,
       SUM(POW(CAST(t AS DOUBLE), 3) - CAST(t AS DOUBLE)) AS tie FROM rc GROUP BY 1),
rz AS (SELECT "column", r1 - n1 * (n1 + 1) / 2.0 AS u, (ABS(r1 - n1 * (n1 + 1) / 2.0 - n1 * n0 / 2.0) - 0.5)
         / SQRT(n1 * n0 / 12.0 * (n1 + n0 + 1 - tie / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM ru),
""" + tails.gamma_q_sql("rp", "rz", ['"column"'], "0.5", "(z * z / 2)") + """,
sw AS (SELECT mo."column", CASE WHEN normal THEN 't-test' ELSE 'Mann-Whitney U' END AS test, CASE WHEN normal THEN wt ELSE u END AS statistic,
         CASE WHEN normal THEN wp.p WHEN z <= 0 THEN 1 ELSE rp.q END AS p_value, cohens_d AS effect, mean0, mean1
       FROM mo JOIN nm ON mo."column" = nm."column" JOIN rz ON mo."column" = rz."column" JOIN rp ON mo."column" = rp."column" JOIN wp ON mo."column" = wp."column"
       WHERE n0 >= 5 AND n1 >= 5
       UNION ALL SELECT chi."column", 'chi2', chi2, cp.q, SQRT((chi2 / tot.n) / LEAST(tot.r - 1, tot.k - 1)), NULL, NULL
       FROM chi JOIN tot ON chi."column" = tot."column" JOIN cp ON chi."column" = cp."column")"""


@register("t9_eda_sweep", recursive(with_views(SQL_SWEEP, f"""
SELECT "column", test, {fix_sig_sql('statistic', 8)} AS statistic, {fix_sig_sql('p_value', 7)} AS p_value, {fix_sig_sql('effect', 8)} AS effect, mean0, mean1,
       COALESCE(p_value < {st.ALPHA / TESTS if TESTS >= 10 else st.ALPHA}, FALSE) AS significant FROM sw""")))
def t9_eda_sweep(spark, sf_dir):
    t = st.eda_sweep(cut_lineage(_v2(spark, sf_dir)), "cancel_yn", NUMERIC, CATEGORICAL)
    return t.select("column", "test", fix_sig("statistic", 8).alias("statistic"), fix_sig("p_value", 7).alias("p_value"), fix_sig("effect", 8).alias("effect"),
                    fix_sig("mean0").alias("mean0"), fix_sig("mean1").alias("mean1"), "significant")


# ---------------------------------------------------------------- T11 / T12 / Q1
V2_FEATURES = ["tv_hours", "ott_yn", "last_view_grp", "agmt_end_seg", "voc_yn", "voc_cancel_yn", "vod_view_cnt",
               "vod_use_tms_sum", "vod_asset_cnt", "flag_kids", "flag_movie", "recency", "total_watch_time",
               "log_watch_time", "is_ott", "risk_kids_ott"]
CORR_COLS = V2_FEATURES
BOOLEANS = ["ott_yn", "voc_yn", "voc_cancel_yn"]


def encoded_v2(spark, sf_dir, v2: DataFrame | None = None):
    """Feature table for correlation, VIF and leakage: codes for categorical, medians for gaps (M2).

    The dictionary, the medians and the consumer all read the features, so they
    are written once (``v2`` may be passed already written).
    """
    v2 = v2 if v2 is not None else cut_lineage(_v2(spark, sf_dir))
    dictionary = code_dictionary(v2, BOOLEANS)
    enc = apply_codes(v2, BOOLEANS, dictionary)
    return median_fill(enc, CORR_COLS)


SQL_ENC = SQL_V2X + ",\nenc AS (SELECT *, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN -1 WHEN {c} THEN 1 ELSE 0 END AS {c}_code" for c in BOOLEANS) + """,
  CASE WHEN ott_yn THEN 1 ELSE 0 END AS is_ott, CASE WHEN flag_kids = 1 AND ott_yn THEN 1 ELSE 0 END AS risk_kids_ott FROM v2x)"""


def _enc_col(c):
    return f"{c}_code" if c in BOOLEANS else c


def _corr_sql(a, b):
    return f"CASE WHEN MIN({a}) <> MAX({a}) AND MIN({b}) <> MAX({b}) THEN CORR({D(a)}, {D(b)}) END"


@register("t11_correlation", with_views(SQL_ENC, " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {fix_sql(_corr_sql(_enc_col(a), _enc_col(b)))} AS r FROM enc"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:])))
def t11_correlation(spark, sf_dir):
    c = st.correlation_matrix(encoded_v2(spark, sf_dir), CORR_COLS)
    return c.select("col_a", "col_b", fix("r").alias("r"))


_K = len(CORR_COLS)
SQL_VIF = SQL_ENC + ",\ncr AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, {_corr_sql(_enc_col(a), _enc_col(b))} AS r FROM enc"
    for i, a in enumerate(CORR_COLS, 1) for j, b in enumerate(CORR_COLS, 1) if i < j) + f"""),
nm AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(CORR_COLS, 1))}) v(own, feature)),
ce AS (SELECT i, j, r FROM cr UNION ALL SELECT j, i, r FROM cr UNION ALL SELECT own, own, 1 FROM nm),
mr AS (SELECT i, LIST(COALESCE(CAST(r AS DOUBLE), 0.0) ORDER BY j) AS line FROM ce GROUP BY i),
el AS (SELECT own, feature, 0 AS k, m FROM nm, (SELECT LIST(line ORDER BY i) AS m FROM mr) x
  UNION ALL
  SELECT own, feature, k + 1, CASE WHEN best > {st.NO_PIVOT} THEN
    list_transform(m, lambda line: list_transform(range(1, {_K + 1}), lambda j: line[j] - line[p] * (m[p][j] / best))) ELSE m END
  FROM (SELECT *, list_position(dg, list_max(dg)) AS p, list_max(dg) AS best FROM (
    SELECT *, list_transform(range(1, {_K + 1}), lambda i: CASE WHEN i = own THEN -1.0 ELSE m[i][i] END) AS dg FROM el WHERE k < {_K - 1}) d) e)"""


@register("t12_vif", recursive(with_views(SQL_VIF, f"""
SELECT feature, CASE WHEN m[own][own] <= {1 - st.INFINITE_R2!r} THEN CAST('inf' AS DOUBLE) ELSE {fix_sig_sql('1 / m[own][own]', 6)} END AS vif FROM el WHERE k = {_K - 1}""")))
def t12_vif(spark, sf_dir):
    t = st.vif_columns(st.correlation_matrix(encoded_v2(spark, sf_dir), CORR_COLS), CORR_COLS)
    return t.select("feature", F.when(F.col("vif") == float("inf"), F.col("vif")).otherwise(fix_sig("vif", 6)).alias("vif"))


@register("q1_target_corr", with_views(SQL_ENC, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {fix_sql(_corr_sql(_enc_col(c), 'cancel_yn'))} AS corr_with_target, "
    f"COALESCE(ABS({_corr_sql(_enc_col(c), 'cancel_yn')}) >= 0.95, FALSE) AS critical FROM enc" for c in CORR_COLS)))
def q1_target_corr(spark, sf_dir):
    return lk.target_correlation(encoded_v2(spark, sf_dir), CORR_COLS, "cancel_yn")


# ---------------------------------------------------------------- Q3 / Q5
ID_COLS = ["user_id"]


def _feature_names(spark, sf_dir):
    v2 = _v2(spark, sf_dir)
    return [c for c in v2.columns if c not in ("user_id", "p_mt", "cancel_yn")], v2


# ---------------------------------------------------------------- Q4
@register("q4_duplicate_keys", with_views("", """
SELECT user_id, strt_dt, COUNT(*) AS cnt FROM activity WHERE strt_dt IS NOT NULL
GROUP BY user_id, strt_dt HAVING COUNT(*) > 1"""))
def q4_duplicate_keys(spark, sf_dir):
    log = views.activity(spark, sf_dir).filter(F.col("strt_dt").isNotNull())
    return lk.duplicate_keys(log, ["user_id", "strt_dt"])


@register("q7_duplicate_samples", with_views("", """
SELECT user_id, strt_dt, COUNT(*) AS cnt FROM activity WHERE strt_dt IS NOT NULL
GROUP BY user_id, strt_dt HAVING COUNT(*) > 1 ORDER BY user_id, strt_dt LIMIT 20"""))
def q7_duplicate_samples(spark, sf_dir):
    """The first 20 duplicate keys, as the leakage report shows them beside their number."""
    return q4_duplicate_keys(spark, sf_dir).orderBy("user_id", "strt_dt").limit(20)


# ---------------------------------------------------------------- Q6
@register("q6_month_format", with_views("", """
SELECT 'panel.p_mt' AS "column", COUNT(*) FILTER (WHERE NOT (CAST(RIGHT(CAST(p_mt AS VARCHAR), 2) AS INT) BETWEEN 1 AND 12)) AS invalid,
       COUNT(*) AS n FROM panel
UNION ALL
SELECT 'activity.p_mt', COUNT(*) FILTER (WHERE NOT (CAST(RIGHT(SUBSTR(strt_dt, 1, 6), 2) AS INT) BETWEEN 1 AND 12)), COUNT(*)
FROM activity WHERE strt_dt IS NOT NULL"""))
def q6_month_format(spark, sf_dir):
    panel = views.panel(spark, sf_dir)
    log = views.activity(spark, sf_dir, with_month=True).filter(F.col("strt_dt").isNotNull())
    return lk.month_format_issues(panel, "p_mt", "panel.p_mt").unionByName(
        lk.month_format_issues(log, "p_mt", "activity.p_mt"))


# ---------------------------------------------------------------- Q7
@register("q7_leakage_report")
def q7_leakage_report(spark, sf_dir):
    from tenure.plans.q_models import importance_shares
    names, v2 = _feature_names(spark, sf_dir)
    v2 = cut_lineage(v2)  # read by the correlation, duplicate-key and month checks
    corr = lk.target_correlation(encoded_v2(spark, sf_dir, v2), CORR_COLS, "cancel_yn")
    return lk.severity(lk.findings(v2, names, ID_COLS, corr, ["user_id", "p_mt"], "p_mt", importance_shares(spark, sf_dir)))


_ = ORACLES


# ---------------------------------------------------------------- M1 / M2 / M3
M1_COLS = ["tv_hours", "last_view_grp", "agmt_end_seg", "ott_yn", "voc_yn", "vod_view_cnt", "vod_use_tms_sum",
           "vod_asset_cnt", "recency", "flag_kids"]
M1_TYPES = {"tv_hours": "DOUBLE", "last_view_grp": "INTEGER", "agmt_end_seg": "INTEGER", "ott_yn": "BOOLEAN",
            "voc_yn": "BOOLEAN", "vod_view_cnt": "BIGINT", "vod_use_tms_sum": "BIGINT", "vod_asset_cnt": "BIGINT",
            "recency": "INTEGER", "flag_kids": "INTEGER"}


@register("m1_column_kinds", with_views(SQL_V2X, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN '{M1_TYPES[c]}' <> 'BOOLEAN' AND COUNT(DISTINCT {c}) > 20 "
    f"THEN 'numeric' ELSE 'categorical' END AS kind FROM v2x" for c in M1_COLS)))
def m1_column_kinds(spark, sf_dir):
    from tenure.operators.encode import column_kinds
    kinds = column_kinds(_v2(spark, sf_dir), M1_COLS)
    return spark.createDataFrame(list(kinds.items()), "feature string, kind string")


@register("m2_encoded_features", with_views(SQL_ENC, "SELECT user_id, p_mt, " + ", ".join(
    f"{D(_enc_col(c))} AS {c}" for c in CORR_COLS)
    + " FROM enc"))
def m2_encoded_features(spark, sf_dir):
    enc = encoded_v2(spark, sf_dir)
    return enc.select("user_id", "p_mt", *[F.col(c).cast("double").alias(c) for c in CORR_COLS])


STD_COLS = ["tv_hours", "vod_view_cnt", "recency"]


@register("m3_standardized", with_views(SQL_V2X, "SELECT user_id, p_mt, " + ", ".join(
    fix_sql(f"({D(c)} - AVG({D(c)}) OVER ()) / STDDEV_POP({D(c)}) OVER ()", 9) + f" AS {c}" for c in STD_COLS)
    + " FROM v2x"))
def m3_standardized(spark, sf_dir):
    from tenure.operators.encode import standardize
    v2 = cut_lineage(_v2(spark, sf_dir))  # read for the fit, then scaled
    out = standardize(v2, STD_COLS)
    # standardized values carry the rounding noise of a mean and a deviation: report 9 decimals
    return out.select("user_id", "p_mt", *[fix(c, 9).alias(c) for c in STD_COLS])


# ---------------------------------------------------------------- F16
# The feature dictionary (name, formula, sources).
FEATURE_SPEC = [
    ("flag_kids", "max(ct_cl = 14) over the user's dated events", "activity.ct_cl"),
    ("flag_movie", "max(ct_cl = 12) over the user's dated events", "activity.ct_cl"),
    ("recency", "days from the last event to the as-of date, floor 0, 999 without events", "activity.strt_dt"),
    ("total_watch_time", "sum(use_tms) of dated events, else the v1 total", "activity.use_tms"),
    ("log_watch_time", "ln(1 + total_watch_time)", "total_watch_time"),
    ("is_ott", "ott_yn as 0/1 (null -> 0)", "panel.ott_yn"),
    ("risk_kids_ott", "flag_kids = 1 and ott_yn", "flag_kids, panel.ott_yn"),
    ("lagged_rvod_cnt", "paid views in the previous calendar month", "activity, content.asset_prod"),
]
