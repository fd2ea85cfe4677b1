"""Registered queries: ranking / threshold / regression metrics, folds, leaderboard, gate, feature impact.

Covers M8-M12, M15-M17, J10, J12, U1, U3, W4, W5. Predictions come from the
rule scores (F10/F11) over the churn v2 panel, split by the seeded
stratified split (L5) and folds (L6), so every number here is derived from
the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.numeric import fix_sql
from tenure.operators import metrics as mt
from tenure.operators import segments as seg
from tenure.operators.sampling import hash32_sql, stratified_folds, stratified_split
from tenure.plans import datasets as ds
from tenure.plans.fixture import REF_DATE, SEED
from tenure.plans.q_activity import SQL_FR, SQL_V1, SQL_V1AGG, SQL_V2
from tenure.plans.q_segments import _churn_sql
from tenure.plans.q_stats import SQL_HYP
from tenure.plans.registry import register, with_views
from tenure.sources import views

MODELS = ("rule_batch", "rule_lookup", "tenure_grp")
ROW_HASH = hash32_sql("CAST(user_id AS VARCHAR) || '|' || CAST(p_mt AS VARCHAR)", SEED)


def _scores(raw: bool = False) -> dict:
    extra = {"is_ott": F.lit(0), "recency": F.lit(0), "ott_flag": F.lit(False)} if raw else {}
    return {
        "rule_batch": seg.churn_score(variant="batch", **extra) / 100.0,
        "rule_lookup": seg.churn_score(variant="lookup", **extra) / 100.0,
        "tenure_grp": F.least(F.greatest(F.col("last_view_grp").cast("double") / 5.0, F.lit(0.0)), F.lit(1.0)),
    }


def predictions(spark, sf_dir, raw: bool = False, folds: bool = False) -> DataFrame:
    """(user_id, p_mt, label, is_val, [fold,] score per model) over the whole churn v2 panel."""
    split = _split(spark, sf_dir, _scores(raw))
    return stratified_folds(split, "label", ["user_id", "p_mt"], 5, SEED) if folds else split


def _split(spark, sf_dir, scores: dict) -> DataFrame:
    panel, log = views.panel(spark, sf_dir), views.activity(spark, sf_dir)
    v2 = ds.churn_v1v2(panel, log, REF_DATE)
    scored = v2.select("user_id", "p_mt", F.col("cancel_yn").alias("label"), *[c.alias(m) for m, c in scores.items()])
    return stratified_split(scored, "label", ["user_id", "p_mt"], 0.2, SEED)


def long_predictions(preds: DataFrame, models=MODELS) -> DataFrame:
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])
    keep = [c for c in ("user_id", "p_mt", "label", "is_val", "fold") if c in preds.columns]
    return preds.select(*keep, F.explode(items).alias("_m")).select(*keep, "_m.model", "_m.score")


def _sql_scores(raw: bool = False) -> str:
    batch, lookup = _churn_sql(True), _churn_sql(False)
    if raw:
        for a, b in (("COALESCE(is_ott, 0)", "0"), ("COALESCE(CAST(recency AS DOUBLE), 0.0)", "0.0"),
                     ("COALESCE(ott_yn, FALSE)", "FALSE")):
            batch, lookup = batch.replace(a, b), lookup.replace(a, b)
    return (f"({batch}) / 100.0 AS rule_batch, ({lookup}) / 100.0 AS rule_lookup, "
            "LEAST(GREATEST(CAST(last_view_grp AS DOUBLE) / 5.0, 0.0), 1.0) AS tenure_grp")


def _sql_preds(raw: bool = False, name: str = "pv") -> str:
    return f"""{name}0 AS (SELECT user_id, p_mt, cancel_yn AS label, {_sql_scores(raw)}
       FROM (SELECT *, CASE WHEN ott_yn THEN 1 ELSE 0 END AS is_ott FROM v2)),
{name} AS (SELECT *,
       ROW_NUMBER() OVER (PARTITION BY label ORDER BY {ROW_HASH}, user_id, p_mt)
         <= CEIL(COUNT(*) OVER (PARTITION BY label) * CAST(0.2 AS DOUBLE)) AS is_val,
       CAST((ROW_NUMBER() OVER (PARTITION BY label ORDER BY {ROW_HASH}, user_id, p_mt) - 1) % 5 + 1 AS INT) AS fold
  FROM {name}0)"""


SQL_PREDS = ",\n".join([SQL_V1AGG, SQL_V1, SQL_FR, SQL_V2]) + ",\n" + _sql_preds()
SQL_PREDS_RAW = SQL_PREDS + ",\n" + _sql_preds(True, "pr")


def _sql_long(src: str, models=MODELS, where: str = "TRUE", name: str = "lp") -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT user_id, p_mt, label, is_val, fold, '{m}' AS model, {m} AS score FROM {src} WHERE {where}"
        for m in models) + ")"


def _sql_ap(src: str, groups: list[str], name: str) -> str:
    """AP / ROC-AUC per group over a (groups..., score, label) table, as in ``metrics.ap_auc``."""
    g = ", ".join(groups)
    gp = f"PARTITION BY {g} " if groups else ""
    gsel = f"{g}, " if groups else ""
    join = " AND ".join(f"c.{x} = t.{x}" for x in groups) or "TRUE"
    return f"""{name}_g AS (SELECT {gsel}score, SUM(label) AS tp, COUNT(*) AS n FROM {src} GROUP BY {gsel}score),
{name}_c AS (SELECT *, n - tp AS neg,
   SUM(tp) OVER ({gp}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
   SUM(n) OVER ({gp}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
   SUM(n - tp) OVER ({gp}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cneg FROM {name}_g),
{name}_t AS (SELECT {gsel}SUM(tp) AS npos, SUM(n) - SUM(tp) AS nneg FROM {name}_g {'GROUP BY ' + g if groups else ''}),
{name} AS (SELECT {', '.join('c.' + x for x in groups) + ', ' if groups else ''}
   CASE WHEN MIN(t.npos) > 0 THEN {fix_sql('SUM(CAST(c.tp AS DOUBLE) * (CAST(c.ctp AS DOUBLE) / CAST(c.cn AS DOUBLE))) / CAST(MIN(t.npos) AS DOUBLE)')} END AS ap,
   CASE WHEN MIN(t.npos) > 0 AND MIN(t.nneg) > 0 THEN {fix_sql('SUM(CAST(c.tp AS DOUBLE) * (CAST(t.nneg - c.cneg AS DOUBLE) + CAST(c.neg AS DOUBLE) * 0.5)) / (CAST(MIN(t.npos) AS DOUBLE) * CAST(MIN(t.nneg) AS DOUBLE))')} END AS roc_auc,
   CAST(MIN(t.npos) AS BIGINT) AS n_pos, CAST(MIN(t.nneg) AS BIGINT) AS n_neg
   FROM {name}_c c JOIN {name}_t t ON {join} {'GROUP BY ' + ', '.join('c.' + x for x in groups) if groups else ''})"""


def _val(preds, model="rule_batch"):
    return preds.filter("is_val").select("user_id", "p_mt", "label", F.col(model).alias("score"))


# ---------------------------------------------------------------- M9 / W4 / W5
@register("m9_ranking_metrics", with_views(SQL_PREDS + """,
p AS (SELECT user_id, p_mt, label, rule_batch AS score FROM pv WHERE is_val),
""" + _sql_ap("p", [], "apx") + """,
r AS (SELECT label, ROW_NUMBER() OVER (ORDER BY score DESC, user_id, p_mt) AS rk, COUNT(*) OVER () AS n FROM p),
pk AS (SELECT
  CAST(SUM(CASE WHEN rk <= GREATEST(1, FLOOR(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE))) THEN label END) AS DOUBLE)
    / CAST(COUNT(CASE WHEN rk <= GREATEST(1, FLOOR(CAST(n AS DOUBLE) * CAST(0.1 AS DOUBLE))) THEN 1 END) AS DOUBLE) AS precision_at_10,
  CAST(SUM(CASE WHEN rk <= GREATEST(1, FLOOR(CAST(n AS DOUBLE) * CAST(0.2 AS DOUBLE))) THEN label END) AS DOUBLE)
    / CAST(COUNT(CASE WHEN rk <= GREATEST(1, FLOOR(CAST(n AS DOUBLE) * CAST(0.2 AS DOUBLE))) THEN 1 END) AS DOUBLE) AS precision_at_20,
  CAST(SUM(label) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS base_rate FROM r)""", """
SELECT apx.ap, apx.roc_auc, apx.n_pos, apx.n_neg, pk.precision_at_10, pk.precision_at_20,
       CASE WHEN pk.base_rate > 0 THEN pk.precision_at_10 / pk.base_rate END AS lift_at_10, pk.base_rate
FROM apx JOIN pk ON TRUE"""))
def m9_ranking_metrics(spark, sf_dir):
    return mt.ranking_metrics(_val(predictions(spark, sf_dir)), "score", "label", ["user_id", "p_mt"])


# ---------------------------------------------------------------- M10
@register("m10_threshold_metrics", with_views(SQL_PREDS + """,
cm AS (SELECT COUNT(*) FILTER (WHERE rule_batch >= 0.5 AND label = 1) AS tp,
              COUNT(*) FILTER (WHERE rule_batch >= 0.5 AND NOT label = 1) AS fp,
              COUNT(*) FILTER (WHERE NOT rule_batch >= 0.5 AND label = 1) AS fn,
              COUNT(*) FILTER (WHERE NOT rule_batch >= 0.5 AND NOT label = 1) AS tn FROM pv WHERE is_val)""", """
SELECT tp, fp, fn, tn,
  CASE WHEN tp + fp + fn + tn > 0 THEN CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1
FROM cm"""))
def m10_threshold_metrics(spark, sf_dir):
    return mt.threshold_metrics(_val(predictions(spark, sf_dir)), "score", "label", 0.5)


# ---------------------------------------------------------------- M11
@register("m11_regression_metrics", with_views(SQL_HYP, f"""
SELECT {fix_sql("CASE WHEN VAR_POP(CAST(vod_purchase_cnt AS DOUBLE)) * COUNT(vod_purchase_cnt) > 0 THEN 1.0 - SUM(POW(CAST(vod_purchase_cnt AS DOUBLE) - GREATEST(CAST(lagged_rvod_cnt AS DOUBLE), 0.0), 2)) / (VAR_POP(CAST(vod_purchase_cnt AS DOUBLE)) * COUNT(vod_purchase_cnt)) END")} AS r2,
       {fix_sql("AVG(ABS(CAST(vod_purchase_cnt AS DOUBLE) - GREATEST(CAST(lagged_rvod_cnt AS DOUBLE), 0.0)))")} AS mae,
       {fix_sql("SQRT(SUM(POW(CAST(vod_purchase_cnt AS DOUBLE) - GREATEST(CAST(lagged_rvod_cnt AS DOUBLE), 0.0), 2)) / COUNT(*))")} AS rmse,
       COUNT(*) AS n
FROM pur"""))
def m11_regression_metrics(spark, sf_dir):
    from tenure.plans.q_stats import _purchase
    return mt.regression_metrics(_purchase(spark, sf_dir), "lagged_rvod_cnt", "vod_purchase_cnt")


# ---------------------------------------------------------------- M8
@register("m8_fold_scores", with_views(SQL_PREDS + ",\nfp AS (SELECT fold, label, rule_batch AS score FROM pv),\n"
                                       + _sql_ap("fp", ["fold"], "fa"), "SELECT fold, ap AS prc_auc FROM fa"))
def m8_fold_scores(spark, sf_dir):
    p = predictions(spark, sf_dir, folds=True)
    return mt.fold_scores(p.select("fold", "label", F.col("rule_batch").alias("score")), "score", "label", "fold")


# ---------------------------------------------------------------- M12
@register("m12_overfit_gap", with_views(SQL_PREDS + """,
sp AS (SELECT CASE WHEN is_val THEN 'val' ELSE 'train' END AS split, label, rule_batch AS score FROM pv),
""" + _sql_ap("sp", ["split"], "sa"), f"""
SELECT t.ap AS train_ap, v.ap AS val_ap, {fix_sql('t.ap - v.ap')} AS gap, t.ap - v.ap > 0.1 AS overfit
FROM sa t JOIN sa v ON t.split = 'train' AND v.split = 'val'"""))
def m12_overfit_gap(spark, sf_dir):
    p = predictions(spark, sf_dir).select("is_val", "label", F.col("rule_batch").alias("score"))
    both = mt.ap_auc(p, "score", "label", ["is_val"])
    return mt.overfit_gap(both.filter(~F.col("is_val")), both.filter(F.col("is_val")))


# ---------------------------------------------------------------- M15 / J12 / U1 / U3
def boards(spark, sf_dir):
    lp = long_predictions(predictions(spark, sf_dir))
    old = mt.ap_auc(lp.filter(~F.col("is_val")), "score", "label", ["model"]).withColumn("split", F.lit("train"))
    new = mt.ap_auc(lp.filter(F.col("is_val") & F.col("model").isin("rule_batch", "rule_lookup")), "score", "label",
                    ["model"]).withColumn("split", F.lit("val"))
    return mt.leaderboard(old, new, "ap")


SQL_BOARD = SQL_PREDS + ",\n" + _sql_long("pv", name="lp") + """,
lt AS (SELECT model, label, score FROM lp WHERE NOT is_val),
lv AS (SELECT model, label, score FROM lp WHERE is_val AND model IN ('rule_batch', 'rule_lookup')),
""" + _sql_ap("lt", ["model"], "bt") + ",\n" + _sql_ap("lv", ["model"], "bv") + """,
board AS (SELECT model, ap, roc_auc, n_pos, n_neg, 'train' AS split FROM bt WHERE model NOT IN (SELECT model FROM bv)
          UNION ALL SELECT model, ap, roc_auc, n_pos, n_neg, 'val' AS split FROM bv)"""


@register("m15_leaderboard", with_views(SQL_BOARD, "SELECT * FROM board"))
def m15_leaderboard(spark, sf_dir):
    return boards(spark, sf_dir)


# ---------------------------------------------------------------- M16
@register("m16_gate", with_views(SQL_BOARD, """
SELECT model, ap, COALESCE(ap >= 0.5, FALSE) AS gate_pass,
       model = (SELECT arg_max(model, CAST(COALESCE(ap >= 0.5, FALSE) AS INT) * 10 + ap) FROM board) AS is_champion
FROM board"""))
def m16_gate(spark, sf_dir):
    return mt.gate(boards(spark, sf_dir), "churn").select("model", "ap", "gate_pass", "is_champion")


# ---------------------------------------------------------------- M17 / J10
@register("m17_feature_impact", with_views(SQL_PREDS_RAW + ",\n" + _sql_long("pv", where="is_val", name="le") + ",\n"
                                           + _sql_long("pr", models=("rule_batch", "rule_lookup"), where="is_val", name="lr")
                                           + ",\n" + _sql_ap("le", ["model"], "ea") + ",\n" + _sql_ap("lr", ["model"], "ra"), f"""
SELECT COALESCE(e.model, r.model) AS model, e.ap AS engineered, r.ap AS raw, {fix_sql('e.ap - r.ap')} AS delta,
       {fix_sql('(e.ap - r.ap) / ABS(r.ap) * 100.0')} AS delta_pct
FROM ea e FULL OUTER JOIN ra r ON e.model = r.model"""))
def m17_feature_impact(spark, sf_dir):
    # both score sets share the rows, the split and one curve pass
    raw = {f"raw {m}": c for m, c in _scores(raw=True).items() if m != "tenure_grp"}
    preds = _split(spark, sf_dir, _scores() | raw).filter("is_val")
    board = mt.ap_auc(long_predictions(preds, (*MODELS, *raw)), "score", "label", ["model"])
    is_raw = F.col("model").startswith("raw ")
    return mt.feature_impact(board.filter(~is_raw), board.filter(is_raw).withColumn("model", F.substring("model", 5, 100)), "ap")


# ---------------------------------------------------------------- M8 (regression) / M16 (purchase gate)
def _purchase_preds(spark, sf_dir):
    from tenure.plans.q_stats import _purchase
    p = stratified_folds(_purchase(spark, sf_dir), None, ["user_id", "p_mt"], 5, SEED)
    return p.select("user_id", "p_mt", "fold", F.col("vod_purchase_cnt").alias("y"),
                    F.col("lagged_rvod_cnt").cast("double").alias("lagged"),
                    F.lit(0.0).alias("zero"),
                    (F.col("lagged_rvod_cnt") + F.col("svod_cnt") * 0.1).alias("lag_plus_svod"))


SQL_PURCHASE_FOLDS = SQL_HYP + f""",
pf AS (SELECT user_id, p_mt, vod_purchase_cnt AS y, CAST(lagged_rvod_cnt AS DOUBLE) AS lagged, 0.0 AS zero,
              lagged_rvod_cnt + svod_cnt * CAST(0.1 AS DOUBLE) AS lag_plus_svod,
              CAST((ROW_NUMBER() OVER (ORDER BY {ROW_HASH}, user_id, p_mt) - 1) % 5 + 1 AS INT) AS fold FROM pur)"""


def _reg_sql(src, pred, group):
    p = f"GREATEST(CAST({pred} AS DOUBLE), 0.0)"
    gsel = f"{group}, " if group else ""
    gby = f"GROUP BY {group}" if group else ""
    return f"""SELECT {gsel}{fix_sql(f"CASE WHEN VAR_POP(CAST(y AS DOUBLE)) * COUNT(y) > 0 THEN 1.0 - SUM(POW(CAST(y AS DOUBLE) - {p}, 2)) / (VAR_POP(CAST(y AS DOUBLE)) * COUNT(y)) END")} AS r2,
       {fix_sql(f"AVG(ABS(CAST(y AS DOUBLE) - {p}))")} AS mae,
       {fix_sql(f"SQRT(SUM(POW(CAST(y AS DOUBLE) - {p}, 2)) / COUNT(*))")} AS rmse, COUNT(*) AS n FROM {src} {gby}"""


@register("m8_regression_fold_scores", with_views(SQL_PURCHASE_FOLDS, _reg_sql("pf", "lagged", "fold")))
def m8_regression_fold_scores(spark, sf_dir):
    """M8 for the purchase task: R2 / MAE / RMSE per fold of the previous-month predictor."""
    return mt.regression_metrics(_purchase_preds(spark, sf_dir), "lagged", "y", ["fold"])


PURCHASE_MODELS = ("lagged", "zero", "lag_plus_svod")


@register("m16_gate_purchase", with_views(SQL_PURCHASE_FOLDS + ",\nrb AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, * FROM ({_reg_sql('pf', m, '')})" for m in PURCHASE_MODELS) + ")", """
SELECT model, r2, mae, COALESCE(r2 >= 0.6 AND mae <= 0.6, FALSE) AS gate_pass,
       model = (SELECT arg_max(model, CAST(COALESCE(r2 >= 0.6 AND mae <= 0.6, FALSE) AS INT) * 10 + r2) FROM rb)
         AS is_champion
FROM rb"""))
def m16_gate_purchase(spark, sf_dir):
    """Purchase gate: R2 >= 0.6 and MAE <= 0.6; champion = best passing by R2, else best."""
    p = _purchase_preds(spark, sf_dir)
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in PURCHASE_MODELS])
    long = p.select("y", F.explode(items).alias("_m")).select("y", "_m.model", "_m.pred")
    board = mt.regression_metrics(long, "pred", "y", ["model"])
    return mt.gate(board, "vod_purchase").select("model", "r2", "mae", "gate_pass", "is_champion")
