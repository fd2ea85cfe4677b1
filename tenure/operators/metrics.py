"""Model metrics, leaderboard, gate and feature impact.

Ranking metrics never sort the whole prediction table in one task: scores
are first counted per distinct value, then cumulative counts come from the
distributed running sum (W5). Precision@k uses the two-pass global rank with
the row key as tie-break (W4).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.numeric import fix
from tenure.operators.joins import full_outer_fill, upsert
from tenure.operators.ranking import global_rank, running_sums
from tenure.session import cut_lineage

# Acceptance thresholds of the gate.
THRESH_AP = 0.5
THRESH_R2 = 0.6
THRESH_MAE = 0.6
OVERFIT_GAP = 0.1


def score_curve(preds: DataFrame, score_col: str, label_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (descending), positives, rows and cumulative positives / rows / negatives."""
    groups = list(group_cols)
    g = preds.filter(F.col(score_col).isNotNull() & F.col(label_col).isNotNull()) \
             .groupBy(*groups, F.col(score_col).alias("_s")) \
             .agg(F.sum(F.col(label_col).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n")) \
             .withColumn("neg", F.col("n") - F.col("tp"))
    return running_sums(g, ["_s"], ["tp", "n", "neg"], group_cols=groups, descending=[True], total_prefix="tot_")


def ap_auc(preds: DataFrame, score_col: str, label_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Average precision (step sum over thresholds) and ROC-AUC, per group.

    AP = sum_t (tp_t / P) * (cum_tp_t / cum_n_t); AUC = sum_t pos_t * (negatives
    scored lower + half the tied negatives) / (P * N). Null when a class is empty.
    """
    groups = list(group_cols)
    agg = score_curve(preds, score_col, label_col, groups).groupBy(*groups).agg(*_curve_sums())
    return agg.select(*groups, *_ap_auc_columns())


def _curve_sums() -> list[Column]:
    prec = F.col("cum_tp").cast("double") / F.col("cum_n").cast("double")
    below = (F.col("tot_neg") - F.col("cum_neg")).cast("double") + F.col("neg").cast("double") * 0.5
    return [F.sum(F.col("tp").cast("double") * prec).alias("_ap_num"), F.sum(F.col("tp").cast("double") * below).alias("_auc_num"),
            F.first("tot_tp").alias("_pos"), F.first("tot_neg").alias("_neg")]


def _ap_auc_columns() -> list[Column]:
    pos, neg = F.col("_pos"), F.col("_neg")
    return [F.when(pos > 0, fix(F.col("_ap_num") / pos.cast("double"))).alias("ap"),
            F.when((pos > 0) & (neg > 0), fix(F.col("_auc_num") / (pos.cast("double") * neg.cast("double")))).alias("roc_auc"),
            pos.alias("n_pos"), neg.alias("n_neg")]


def precision_at(preds: DataFrame, score_col: str, label_col: str, key_cols: Sequence[str],
                 fractions: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """Mean label among the top max(1, int(n * k)) rows by score (ties by key), for each k."""
    ranked = global_rank(preds.select(score_col, label_col, *key_cols), [score_col, *key_cols],
                         descending=[True] + [False] * len(key_cols), rank_col="_r", count_col="_n")
    cols = []
    for k in fractions:
        m = F.greatest(F.lit(1), F.floor(F.col("_n").cast("double") * k)).cast("long")
        tag = int(round(k * 100))
        cols += [F.sum(F.when(F.col("_r") <= m, F.col(label_col).cast("long"))).alias(f"_tp{tag}"),
                 F.count(F.when(F.col("_r") <= m, 1)).alias(f"_m{tag}")]
    agg = ranked.agg(*cols, F.sum(F.col(label_col).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_all"))
    out = []
    for k in fractions:
        tag = int(round(k * 100))
        out.append((F.col(f"_tp{tag}").cast("double") / F.col(f"_m{tag}").cast("double")).alias(f"precision_at_{tag}"))
    base = F.col("_pos").cast("double") / F.col("_all").cast("double")
    t0 = int(round(fractions[0] * 100))
    lift = F.when(base > 0, (F.col(f"_tp{t0}").cast("double") / F.col(f"_m{t0}").cast("double")) / base)
    return agg.select(*out, lift.alias(f"lift_at_{t0}"), base.alias("base_rate"))


TIES_AT_ONCE = 100_000


def ranking_metrics(preds: DataFrame, score_col: str, label_col: str, key_cols: Sequence[str], fractions: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """M9: AP, ROC-AUC, P@10%, P@20%, Lift@10% in one row, all from one score curve.

    The top k rows are whole scores of the curve, and of the score at the cut the first rows by key: only where a
    cut falls among rows of equal score are those rows ranked. The needed columns are written once to the
    checkpoint folder, so the upstream plan (features over the whole log) runs once.
    """
    preds = cut_lineage(preds.select(score_col, label_col, *key_cols))
    curve = score_curve(preds, score_col, label_col)
    tops = [F.greatest(F.lit(1), F.floor(F.col("tot_n").cast("double") * k)).cast("long") for k in fractions]
    cuts = []
    for i, m in enumerate(tops):
        cuts += [F.max(m).alias(f"m{i}"), F.max(F.when(F.col("cum_n") <= m, F.struct("cum_n", "cum_tp"))).alias(f"upto{i}"),
                 F.max(F.when(F.col("cum_n") > m, F.struct("_s", "n", "tp"))).alias(f"at{i}")]
    row = curve.agg(*_curve_sums(), *cuts).select(*_ap_auc_columns(), "*").first().asDict()
    out = {c: row[c] for c in ("ap", "roc_auc", "n_pos", "n_neg")}
    total = (out["n_pos"] or 0) + (out["n_neg"] or 0)
    for i, k in enumerate(fractions):
        m, upto, at = row[f"m{i}"], row[f"upto{i}"], row[f"at{i}"]
        hits = upto["cum_tp"] if upto else 0
        rest = min(m or 0, total) - (upto["cum_n"] if upto else 0)
        if rest > 0:
            ties = preds.where(F.col(score_col) == F.lit(at["_s"])).where(F.col(label_col).isNotNull())
            if rest <= TIES_AT_ONCE:
                first = ties.orderBy(*key_cols).limit(rest)
            else:
                first = global_rank(ties, list(key_cols), rank_col="_r").where(F.col("_r") <= rest)
            hits += first.agg(F.sum(F.col(label_col).cast("long"))).first()[0] or 0
        out[f"precision_at_{int(round(k * 100))}"] = hits / min(m, total) if total else None
    out["base_rate"] = out["n_pos"] / total if total else None
    first = f"precision_at_{int(round(fractions[0] * 100))}"
    out["lift_at_10"] = out[first] / out["base_rate"] if out["base_rate"] else None
    schema = ("ap double, roc_auc double, n_pos long, n_neg long, precision_at_10 double, precision_at_20 double, "
              "lift_at_10 double, base_rate double")
    names = [f.split()[0] for f in schema.split(", ")]
    return preds.sparkSession.createDataFrame([tuple(out[n] for n in names)], schema)


def threshold_metrics(preds: DataFrame, score_col: str, label_col: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and accuracy / precision / recall / F1 at a threshold; 0 on zero division."""
    pred = F.col(score_col) >= threshold
    y = F.col(label_col) == 1
    agg = preds.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                    F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def safe(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))
    return agg.select("tp", "fp", "fn", "tn", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                      safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
                      safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def regression_metrics(preds: DataFrame, pred_col: str, y_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """R2, MAE, RMSE with predictions floored at 0."""
    p = F.greatest(F.col(pred_col).cast("double"), F.lit(0.0))
    y = F.col(y_col).cast("double")
    agg = preds.groupBy(*group_cols).agg(
        F.sum((y - p) * (y - p)).alias("_ssr"), (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.avg(F.abs(y - p)).alias("_mae"), F.count(F.lit(1)).alias("n"))
    return agg.select(*group_cols,
                      fix(F.when(F.col("_sst") > 0, 1.0 - F.col("_ssr") / F.col("_sst"))).alias("r2"),
                      fix(F.col("_mae")).alias("mae"), fix(F.sqrt(F.col("_ssr") / F.col("n"))).alias("rmse"), "n")


def fold_scores(preds: DataFrame, score_col: str, label_col: str, fold_col: str = "fold") -> DataFrame:
    """M8: AP per fold (one pass for all folds)."""
    return ap_auc(preds, score_col, label_col, [fold_col]).select(fold_col, F.col("ap").alias("prc_auc"))


def overfit_gap(train_ap: DataFrame, val_ap: DataFrame, gap: float = OVERFIT_GAP) -> DataFrame:
    """Train AP - validation AP and a flag when above 0.1 (both inputs are one-row ``ap`` tables)."""
    t = train_ap.select("ap").first()["ap"]
    v = val_ap.select("ap").first()["ap"]
    d = None if t is None or v is None else t - v
    out = train_ap.sparkSession.createDataFrame([(t, v, d, d is not None and d > gap)],
                                                "train_ap double, val_ap double, gap double, overfit boolean")
    return out.withColumn("gap", fix("gap"))


def leaderboard(existing: DataFrame | None, new: DataFrame, metric: str, key: str = "model") -> DataFrame:
    """Replace rows of re-run models, append the new ones, sort by the metric (desc, then name)."""
    board = new if existing is None else upsert(existing, new, key)
    return board.orderBy(F.col(metric).desc_nulls_last(), F.col(key))


def gate(board: DataFrame, task: str = "churn", key: str = "model") -> DataFrame:
    """Pass flag per model and the champion: best passing model by the gate metric, else the best."""
    if task == "churn":
        metric = "ap"
        passed = F.col("ap") >= THRESH_AP
    else:
        metric = "r2"
        passed = (F.col("r2") >= THRESH_R2) & (F.col("mae") <= THRESH_MAE)
    flagged = board.withColumn("gate_pass", F.coalesce(passed, F.lit(False)))
    # the board holds one row per model, so a window over all of it is bounded
    w = Window.partitionBy(F.lit(1))
    champion = F.max_by(F.col(key), F.struct(F.col("gate_pass").cast("int"), F.col(metric))).over(w)
    return flagged.withColumn("is_champion", F.col(key) == champion)


def feature_impact(engineered: DataFrame, raw: DataFrame, metric: str, key: str = "model") -> DataFrame:
    """Per model the metric with and without derived features, delta and percent of |raw|."""
    e = engineered.select(key, F.col(metric).alias("engineered"))
    r = raw.select(key, F.col(metric).alias("raw"))
    j = full_outer_fill(e, r, key, fill=None)
    delta = F.col("engineered") - F.col("raw")
    return j.select(key, "engineered", "raw", fix(delta).alias("delta"),
                    fix(F.try_divide(delta, F.abs(F.col("raw"))) * 100.0).alias("delta_pct"))
