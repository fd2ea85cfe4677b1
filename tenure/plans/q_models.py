"""Registered queries: model training, tuning, selection, importance, ablation, save and batch scoring.

Covers M4-M7, M13, M14, M18-M20 and Q2. Learned numbers depend on the
library, so these have no SQL oracle (rows-only check); the metric operators
they report with are oracle-checked in ``q_metrics``.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.operators import boosting as bo
from tenure.operators import models as md
from tenure.operators.leakage import has_risk_token
from tenure.operators.sampling import split_and_folds
from tenure.plans import datasets as ds
from tenure.plans.fixture import REF_DATE, SEED, YEAR_END, YEAR_START
from tenure.plans.q_stats import V2_FEATURES, _purchase, _v2
from tenure.plans.registry import register, with_views
from tenure.session import cut_lineage, ensure_checkpoint_dir
from tenure.sources import views

KEYS = ["user_id", "p_mt"]
PURCHASE_FEATURES = ["tv_hours", "last_view_grp", "agmt_end_seg", "ott_yn", "voc_yn", "voc_cancel_yn", "fod_cnt",
                     "svod_cnt", "lagged_rvod_cnt"]
DERIVED = ["flag_kids", "flag_movie", "recency", "total_watch_time", "log_watch_time", "is_ott", "risk_kids_ott", "lagged_rvod_cnt"]
RESULT_SCHEMA = "task string, model string, metric string, value double"
TOP_FEATURES = 10
#: Rows of training data in a part at most, parts at least, and models trained at a time.
PART_ROWS, LEAST_PARTS, AT_ONCE = 1_000_000, 8, 3
#: Models whose training is the longest chain of jobs, longest first.
CHAINS = ("gbt", "logistic", "linear")


def _dealt(df: DataFrame) -> DataFrame:
    """Cached with the same rows in the same places each time: forests and boosting draw by partition and position.

    One part per core, more where a part would pass ``PART_ROWS``: every pass of a forest sends the sums of all its
    open nodes from each part, so parts beyond the cores only add to the shuffle and to the short jobs of boosting.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, LEAST_PARTS, -(-df.count() // PART_ROWS))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    return df.repartition(parts, *KEYS).sortWithinPartitions(*KEYS).cache()


def churn_data(spark, sf_dir) -> DataFrame:
    panel, log = views.panel(spark, sf_dir), views.activity(spark, sf_dir)
    v2 = ds.churn_v1v2(panel, log, REF_DATE)
    return _dealt(split_and_folds(v2, "cancel_yn", KEYS, 0.2, 5, SEED))


def purchase_data(spark, sf_dir) -> DataFrame:
    return _dealt(split_and_folds(_purchase(spark, sf_dir), None, KEYS, 0.2, 5, SEED))


def _side_by_side(spark, work, items) -> list:
    """``work`` of each item, a few at a time: training is a chain of short jobs that leave cores idle.

    Models that are a longer chain of jobs begin first (``CHAINS``), so that the forests fill the cores beside them; what
    comes back is in the order of ``items``.
    """
    items = list(items)
    begun = sorted(range(len(items)), key=lambda i: _chain(items[i]))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = dict(zip(begun, pool.map(inheritable_thread_target(spark)(work), [items[i] for i in begun])))
    return [done[i] for i in range(len(items))]


def _chain(item) -> int:
    """Place in ``CHAINS`` of the model that ``item``, a tuple with a model's name or else a task, is about; the end if none."""
    names = item if isinstance(item, tuple) else TASKS.get(item, ())[:1]
    return min((CHAINS.index(n) for n in names if n in CHAINS), default=len(CHAINS))


def _rows(task, model, result: dict):
    return [(task, model, k, None if v is None else float(v)) for k, v in result.items()]


def _prepared(data, features, label) -> md.Prepared:
    return md.prepare(data.filter(~F.col("is_val")), features, label)


def _fit_eval(task, name, data, features, label, prep=None, **params):
    """The model, its preparation (``prep``, fitted for these and perhaps more features, spares fitting one) and its metrics."""
    train, val = data.filter(~F.col("is_val")), data.filter("is_val")
    prep = prep.subset(features) if prep else md.prepare(train, features, label)
    if task == "churn":
        model = md.fit_classifier(name, train, prep, **params)
    else:
        model = md.fit_regressor(name, train, prep, **params)
    return model, prep, md.evaluate(model, train, val, prep, KEYS, task)


# ---------------------------------------------------------------- M4
@register("m4_baseline_models")
def m4_baseline_models(spark, sf_dir):
    rows = []
    _, _, r = _fit_eval("churn", "logistic", churn_data(spark, sf_dir), V2_FEATURES, "cancel_yn")
    rows += _rows("churn", "logistic", r)
    _, _, r = _fit_eval("vod_purchase", "linear", purchase_data(spark, sf_dir), PURCHASE_FEATURES, "vod_purchase_cnt")
    rows += _rows("vod_purchase", "linear", r)
    return spark.createDataFrame(rows, RESULT_SCHEMA)


# ---------------------------------------------------------------- M5
@register("m5_tree_models")
def m5_tree_models(spark, sf_dir):
    data = {task: rows(spark, sf_dir) for task, (_, _, rows, _, _) in TASKS.items()}
    preps = {task: _prepared(data[task], features, label) for task, (*_, features, label) in TASKS.items()}

    def fitted(which):
        task, name = which
        *_, features, label = TASKS[task]
        return _rows(task, name, _fit_eval(task, name, data[task], features, label, preps[task])[2])
    rows = _side_by_side(spark, fitted, [(task, name) for task in TASKS for name in ("random_forest", "gbt")])
    return spark.createDataFrame([row for part in rows for row in part], RESULT_SCHEMA)


# ---------------------------------------------------------------- M6
BOOSTED = ("lightgbm", "xgboost", "catboost")


def boosted(spark, sf_dir, task: str, trees: int | None = None) -> DataFrame:
    """The three families fitted together on a task's training rows, and scored on all its rows."""
    _, _, training_rows, features, label = TASKS[task]
    data = bo.numbered(training_rows(spark, sf_dir))
    columns, rows = bo.prepare(data.filter(~F.col("is_val")), features, label, KEYS)
    more = {} if trees is None else {"trees": trees}
    models = bo.grow(rows, columns, [bo.rules(f, task == "churn", columns.of(f), **more) for f in BOOSTED], KEYS)
    return cut_lineage(bo.scored(data.select("_row", *KEYS, *features, label, "is_val"), columns, dict(zip(BOOSTED, models)))
                       .select(*KEYS, label, "is_val", *BOOSTED))


@register("m6_boosted_families")
def m6_boosted_families(spark, sf_dir):
    """Leaf-wise, depth-wise and symmetric boosting for both tasks, each family by its own rule."""
    def fitted(task):
        scores, label = boosted(spark, sf_dir, task), TASKS[task][4]
        mine = [(name, scores.withColumnRenamed(name, "score")) for name in BOOSTED]
        return [row for name, s in mine for row in _rows(task, name, md.evaluate_scores(s.filter(~F.col("is_val")), s.filter("is_val"), label, KEYS, task))]

    with ThreadPoolExecutor(len(TASKS)) as pool:  # both tasks at a time: their passes are short jobs
        rows = [row for part in pool.map(inheritable_thread_target(spark)(fitted), TASKS) for row in part]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


# ---------------------------------------------------------------- M7 / M8
def tuning(spark, sf_dir, task: str, family: str, n_trials: int = bo.TRIALS, bounds: dict | None = None, startup: int = 10) -> DataFrame:
    """Every trial's fold scores for one task and family; ``best`` marks the setting with the best mean."""
    _, _, training_rows, features, label = TASKS[task]
    data = training_rows(spark, sf_dir).filter(~F.col("is_val"))
    sample = bo.tuning_sample(data, features, label, KEYS, "fold")
    best, trials = bo.tune(spark, sample, family, task == "churn", n_trials, bounds, startup)
    rows = [(task, family, i, str(t["params"]), fold, None if s is None else float(s), t["params"] == best)
            for i, t in enumerate(trials) for fold, s in enumerate(t["folds"], start=1)]
    return spark.createDataFrame(rows, "task string, family string, trial int, params string, fold int, score double, best boolean")


def _register_tuning(task: str, family: str) -> None:
    """One query per task and family: all its ``TRIALS`` trials within the family's bounds, with five folds each."""
    register(f"m7_tuning_{task}_{family}")(lambda spark, sf_dir: tuning(spark, sf_dir, task, family))


for _task in ("churn", "vod_purchase"):
    for _family in bo.SEARCH:
        _register_tuning(_task, _family)


# ---------------------------------------------------------------- M14 / Q2
def _prior_rf(spark, sf_dir, trees: int = 50, depth: int = 8, task: str = "churn", data: DataFrame | None = None):
    _, _, training_rows, features, label = TASKS[task]
    data = training_rows(spark, sf_dir) if data is None else data
    train = data.filter(~F.col("is_val"))
    prep = md.prepare(train, features, label)
    fit = md.fit_classifier if task == "churn" else md.fit_regressor
    model = fit("random_forest", train, prep, numTrees=trees, maxDepth=depth)
    return md.importances(model, prep.features), data, prep


def importance_shares(spark, sf_dir, task: str = "churn") -> DataFrame:
    """Feature and share of the importance, for Q7; no rows where the label does not vary, as nothing can be fitted."""
    _, _, training_rows, _, label = TASKS[task]
    data = training_rows(spark, sf_dir)
    labels = data.filter(~F.col("is_val")).agg(F.countDistinct(label)).first()[0]
    rows = [(f, float(v)) for f, v in _prior_rf(spark, sf_dir, task=task, data=data)[0]] if labels > 1 else []
    return spark.createDataFrame(rows, "feature string, share double")


@register("m14_prior_importance")
def m14_prior_importance(spark, sf_dir):
    each = _side_by_side(spark, lambda task: _prior_rf(spark, sf_dir, task=task)[0], TASKS)
    rows = [(task, i + 1, f, float(v), f in DERIVED) for task, imp in zip(TASKS, each) for i, (f, v) in enumerate(imp)]
    return spark.createDataFrame(rows, "task string, rank int, feature string, importance double, derived boolean")


@register("q2_dominance")
def q2_dominance(spark, sf_dir):
    rows = []
    for task, imp in zip(TASKS, _side_by_side(spark, lambda task: _prior_rf(spark, sf_dir, task=task)[0], TASKS)):
        top, share = imp[0] if imp else (None, None)
        rows.append((task, top, None if share is None else float(share), bool(md.dominance(imp))))
    return spark.createDataFrame(rows, "task string, top_feature string, importance double, dominant boolean")


# ---------------------------------------------------------------- M13
@register("m13_topk_selection")
def m13_topk_selection(spark, sf_dir):
    """Order features by RF importance, then validation AP of a logistic model on the top k, k = 5..15.

    ``chosen`` marks the best k; ``selected`` names the features kept in the end, always ``TOP_FEATURES`` of them
    where there are as many.
    """
    imp, churn, prep = _prior_rf(spark, sf_dir, trees=100, depth=10)
    order = [f for f, _ in imp]
    train, val = churn.filter(~F.col("is_val")), churn.filter("is_val")

    def fitted(k):
        sub = prep.subset(order[:k])  # statistics fitted once on the training rows
        model = md.fit_classifier("logistic", train, sub)
        ap = md.mt.ap_auc(md.score(model, val, sub), "score", "cancel_yn").first()["ap"]
        return k, ", ".join(order[:k]), ap
    rows = _side_by_side(spark, fitted, range(5, min(15, len(order)) + 1))
    best_k = max(rows, key=lambda x: (x[2] if x[2] is not None else -1, -x[0]))[0] if rows else None
    selected = ", ".join(order[:TOP_FEATURES])
    return spark.createDataFrame([(k, f, ap, k == best_k, selected) for k, f, ap in rows],
                                 "k int, features string, val_ap double, chosen boolean, selected string")


# ---------------------------------------------------------------- M18
def ablation(spark, sf_dir, task: str) -> DataFrame:
    """All features, those without a risky name (for every model), and the derived features alone."""
    _, _, training_rows, features, label = TASKS[task]
    data, safe, plain = training_rows(spark, sf_dir), [f for f in features if not has_risk_token(f)], "logistic" if task == "churn" else "linear"
    variants = [("random_forest", "all", features), *[(m, "no_temporal_tokens", safe) for m in (plain, "random_forest", "gbt")],
                ("random_forest", "derived_only", [f for f in features if f in DERIVED])]
    prep = _prepared(data, features, label)  # each feature's statistics are its own: all variants share them

    def fitted(which):
        name, variant, feats = which
        return _rows(task, f"{name}[{variant}]", _fit_eval(task, name, data, feats, label, prep)[2])
    return spark.createDataFrame([row for part in _side_by_side(spark, fitted, variants) for row in part], RESULT_SCHEMA)


@register("m18_ablation")
def m18_ablation(spark, sf_dir):
    return ablation(spark, sf_dir, "churn")


@register("m18_ablation_purchase")
def m18_ablation_purchase(spark, sf_dir):
    return ablation(spark, sf_dir, "vod_purchase")


# ---------------------------------------------------------------- M19 / M20
#: Task: model, rows to score, rows to train on, features, label.
TASKS = {"churn": ("gbt", _v2, churn_data, V2_FEATURES, "cancel_yn"),
         "vod_purchase": ("random_forest", _purchase, purchase_data, PURCHASE_FEATURES, "vod_purchase_cnt")}


def model_path(spark, sf_dir: str, task: str) -> str:
    """Where the model of a task and dataset lies, on the cluster's file system."""
    key = hashlib.md5(sf_dir.rstrip("/").encode()).hexdigest()[:12]
    return f"{ensure_checkpoint_dir(spark)}/models/{task}-{key}"


def train_task(spark, sf_dir: str, task: str) -> str:
    name, _, training_rows, features, label = TASKS[task]
    path = model_path(spark, sf_dir, task)
    md.train_served(training_rows(spark, sf_dir).filter(~F.col("is_val")), features, label, task, name).save(path)
    return path


def task_scores(spark, sf_dir: str, task: str) -> DataFrame:
    """The rows of a task scored by its saved model, which is trained first where none is saved."""
    path = model_path(spark, sf_dir, task)
    if not md.Served.saved(spark, path):
        train_task(spark, sf_dir, task)
    scored = md.Served.load(spark, path).predict(TASKS[task][1](spark, sf_dir))
    return scored.select(F.lit(task).alias("task"), *KEYS, F.round("prediction", 1).alias("prediction"))


@register("m19_train_and_save")
def m19_train_and_save(spark, sf_dir):
    rows = []
    for task, path in zip(TASKS, _side_by_side(spark, lambda task: train_task(spark, sf_dir, task), TASKS)):
        prep = md.Served.load(spark, path).prep
        rows.append((task, path, len(prep.features), prep.dictionary.count(), ", ".join(prep.features)))
    return spark.createDataFrame(rows, "task string, path string, n_features int, n_codes long, features string")


@register("m20_batch_scoring")
def m20_batch_scoring(spark, sf_dir):
    """Every panel row's churn risk and every year row's purchases, by the saved models."""
    churn, purchases = _side_by_side(spark, lambda task: task_scores(spark, sf_dir, task), ("churn", "vod_purchase"))
    return churn.unionByName(purchases)


@register("m20_scoring_facts", with_views("", f"""
SELECT 'churn' AS task, COUNT(*) AS n, COUNT(DISTINCT CAST(user_id AS VARCHAR) || '|' || CAST(p_mt AS VARCHAR)) AS n_keys,
       TRUE AS in_bounds FROM panel
UNION ALL
SELECT 'vod_purchase', COUNT(*), COUNT(DISTINCT CAST(user_id AS VARCHAR) || '|' || CAST(p_mt AS VARCHAR)), TRUE
FROM panel WHERE p_mt BETWEEN {YEAR_START} AND {YEAR_END}"""))
def m20_scoring_facts(spark, sf_dir):
    """Per task: rows scored, their keys, and whether all predictions keep the task's bounds."""
    low = F.when(F.col("task") == "churn", 5.0).otherwise(0.0)
    high = F.when(F.col("task") == "churn", 95.0).otherwise(float("inf"))
    return m20_batch_scoring(spark, sf_dir).groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(*KEYS).alias("n_keys"),
        F.bool_and(F.coalesce(F.col("prediction").between(low, high), F.lit(False))).alias("in_bounds"))
