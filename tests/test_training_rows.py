"""Training rows: one rank for split and folds, parts by cores, small ranges merged, statistics shared by all models."""

import pytest
from pyspark.sql import functions as F

from tenure.operators import models as md
from tenure.operators.ranking import global_rank
from tenure.operators.sampling import split_and_folds, stratified_folds, stratified_split
from tenure.plans import q_models as qm

KEYS = ["user_id", "p_mt"]


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _panel(spark, n=300):
    return spark.range(n).select((F.col("id") % 97).alias("user_id"), F.col("id").cast("int").alias("p_mt"), (F.col("id") % 7 == 0).cast("int").alias("cancel_yn"),
                                 F.when(F.col("id") % 11 > 0, F.col("id") * 1.5).alias("tv_hours"), (F.col("id") % 5).cast("int").alias("last_view_grp"))


@pytest.mark.parametrize("label", ["cancel_yn", None])
def test_split_and_folds_are_those_of_two_ranks(spark, label):
    df = _panel(spark)
    want = stratified_folds(stratified_split(df, label, KEYS, 0.2, 42), label, KEYS, 5, 42)
    got = split_and_folds(df, label, KEYS, 0.2, 5, 42)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).fillna(-1).collect())) == sorted(map(tuple, want.fillna(-1).collect()))


def test_training_rows_have_a_part_per_core(many_partitions, monkeypatch):
    spark = many_partitions
    assert qm._dealt(_panel(spark)).rdd.getNumPartitions() == max(qm.LEAST_PARTS, spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(qm, "PART_ROWS", 10)
    assert qm._dealt(_panel(spark, 299)).rdd.getNumPartitions() == 30
    monkeypatch.setattr(qm, "PART_ROWS", 1)
    assert qm._dealt(_panel(spark, 298)).rdd.getNumPartitions() == 200


def test_ranks_of_few_rows_take_few_ranges(many_partitions):
    ranked = global_rank(many_partitions.range(500).withColumn("v", F.col("id") % 7), ["v", "id"], rank_col="r")
    assert ranked.rdd.getNumPartitions() < 20
    assert [r.id for r in ranked.orderBy("r").collect()] == sorted(range(500), key=lambda i: (i % 7, i))


def test_models_share_statistics_of_their_features(spark):
    df = _panel(spark).withColumn("is_val", F.lit(False)).cache()
    features = ["tv_hours", "last_view_grp"]
    whole, own = md.prepare(df, features, "cancel_yn").subset(["tv_hours"]), md.prepare(df, ["tv_hours"], "cancel_yn")
    assert (whole.features, whole.medians["tv_hours"], whole.scaler["tv_hours"]) == (own.features, own.medians["tv_hours"], own.scaler["tv_hours"])
    for name, params in (("random_forest", {"numTrees": 3}), ("logistic", {"maxIter": 5})):
        a, b = (md.fit_classifier(name, df, p, **params) for p in (whole, own))
        assert md.score(a, df, whole).select("score").collect() == md.score(b, df, own).select("score").collect()


def test_boosting_blocks_lie_in_few_partitions_and_give_the_same_trees(spark, monkeypatch):
    from tenure.operators import boosting as bo
    data = bo.numbered(_panel(spark, 600))
    columns, rows = bo.prepare(data, ["tv_hours", "last_view_grp"], "cancel_yn", KEYS)
    setting = [bo.rules("xgboost", True, columns.of("xgboost"), trees=2)]

    def grown():
        return [t.value.tolist() for m in bo.grow(rows, columns, setting, KEYS) for t in m.trees]
    one = grown()
    monkeypatch.setattr(bo, "BLOCK_ROWS", 10)
    monkeypatch.setattr(bo, "PASS_CELLS", 16)
    most = 3 * spark.sparkContext.defaultParallelism
    assert most < 60 and bo._blocks(rows, columns, KEYS, None, 600).rdd.getNumPartitions() == most
    assert grown() == one


@pytest.mark.parametrize("make", [md.classifier, md.regressor])
def test_forests_keep_the_node_of_each_row_and_grow_the_same_trees(spark, make):
    df = _panel(spark).withColumn("is_val", F.lit(False)).cache()
    prep = md.prepare(df, ["tv_hours", "last_view_grp"], "cancel_yn")
    ours = make("random_forest", numTrees=4, maxDepth=6)
    assert ours.getCacheNodeIds() and ours.getMaxMemoryInMB() > 256
    with md._ready(df, prep) as data:
        assert ours.fit(data).toDebugString.split("\n")[1:] == ours.copy({ours.cacheNodeIds: False, ours.maxMemoryInMB: 256}).fit(data).toDebugString.split("\n")[1:]


def test_forests_keep_nodes_that_fit_and_rows_of_logistic_models_are_kept_once(spark, monkeypatch):
    df, seen = _panel(spark).withColumn("is_val", F.lit(False)).cache(), []
    prep = md.prepare(df, ["tv_hours", "last_view_grp"], "cancel_yn")
    for kind in (md.RandomForestClassifier, md.RandomForestRegressor):
        monkeypatch.setattr(kind, "fit", lambda self, data: seen.append((self.getCacheNodeIds(), data.storageLevel.useMemory)))
    monkeypatch.setattr(md.LogisticRegression, "fit", lambda self, data: seen.append(("logistic", data.storageLevel.useMemory)))
    for room in (md.NODE_BYTES, 1):
        monkeypatch.setattr(md, "NODE_BYTES", room)
        md.fit_classifier("random_forest", df, prep)
        md.fit_regressor("random_forest", df, prep)
    md.fit_classifier("logistic", df, prep)
    assert seen == [(True, True)] * 2 + [(False, True)] * 2 + [("logistic", False)]


def test_long_chains_begin_first_and_results_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(qm, "AT_ONCE", 1)
    begun, items = [], [("random_forest", "all"), ("logistic", "safe"), ("random_forest", "safe"), ("gbt", "safe")]
    assert qm._side_by_side(spark, lambda x: begun.append(x) or x, items) == items
    assert begun == [items[3], items[1], items[0], items[2]]
    assert qm._side_by_side(spark, lambda k: k, range(5, 9)) == [5, 6, 7, 8]
    assert qm._side_by_side(spark, lambda task: task, ("vod_purchase", "churn")) == ["vod_purchase", "churn"]


def test_columns_of_many_values_are_not_counted_exactly(spark, monkeypatch):
    from tenure.operators import encode as en
    counted, exact = [], F.countDistinct
    monkeypatch.setattr(en.F, "countDistinct", lambda c: counted.append(c) or exact(c))
    df = spark.range(2000).select(F.col("id").alias("all"), (F.col("id") % 20).alias("twenty"), (F.col("id") % 21).cast("double").alias("more"),
                                  F.lit(None).cast("int").alias("none"), (F.col("id") % 100 == 0).alias("flag"))
    assert en.column_kinds(df, df.columns) == {"all": "numeric", "twenty": "categorical", "more": "numeric", "none": "categorical", "flag": "categorical"}
    assert counted == ["twenty", "more", "none"]
    assert en.column_kinds(df, ["all"], min_distinct=2000) == {"all": "categorical"}
