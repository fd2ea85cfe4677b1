"""Saved models that score without their training rows; CSV files of one column with different types; one-scan lag."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from tenure.operators import models as md
from tenure.operators.joins import attach, calendar_lag, with_lag
from tenure.sources import ingest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, float(i % 40), "abc"[i % 3] if i % 7 else None, int(i % 40 > 20), float(i % 40 > 20) * 3 + i % 2) for i in range(240)]
    return spark.createDataFrame(rows, "user_id int, hours double, plan string, cancel_yn int, bought double").cache()


@pytest.mark.parametrize("task, label, name, low, high", [("churn", "cancel_yn", "gbt", 5.0, 95.0),
                                                          ("vod_purchase", "bought", "random_forest", 0.0, 5.0)])
def test_saved_model_scores_new_rows(spark, train, tmp_path, task, label, name, low, high):
    params = {"maxIter": 5} if name == "gbt" else {"numTrees": 10, "maxDepth": 4}
    path = f"file:{tmp_path}/model"
    assert not md.Served.saved(spark, path)
    fitted = md.train_served(train, ["hours", "plan"], label, task, name, **params)
    fitted.save(path)
    assert md.Served.saved(spark, path)
    loaded = md.Served.load(spark, path)
    assert (loaded.prep.features, loaded.prep.categorical, loaded.prep.label, loaded.task) == (["hours", "plan"], ["plan"], label, task)
    new = spark.createDataFrame([(1, 35.0, "a", "kept"), (2, 2.0, "zzz", "kept"), (3, None, None, "kept"), (4, 0.0, "a", "kept")],
                                "user_id int, hours double, plan string, features string")
    got = {r.user_id: r for r in loaded.predict(new).collect()}
    assert len(got) == 4 and all(low <= r.prediction <= high and r.features == "kept" for r in got.values())
    assert got[1].prediction > got[2].prediction
    assert got[3].prediction == got[4].prediction  # nulls count as 0, of a category as code 0
    again = {r.user_id: r.prediction for r in fitted.predict(new).collect()}
    assert again == {k: r.prediction for k, r in got.items()}
    lacking = loaded.predict(new.select("user_id", "plan")).where("user_id = 4").first()
    assert lacking.prediction == got[4].prediction
    assert loaded.predict(new.limit(0)).count() == 0


def test_files_of_different_types_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,day,n,flag\n1,2024-01-02,5,true\n2,2024-01-03,6,FALSE\n")
    (tmp_path / "b.csv").write_text("k,n,extra\nabc,1.5,9999999999\n,,\n")
    df = ingest.read_csv_union(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert dict(df.dtypes) == {"k": "string", "day": "date", "n": "double", "flag": "boolean", "extra": "bigint"}
    assert sorted(str(r.k) for r in df.collect()) == ["1", "2", "None", "abc"]
    declared = ingest.read_csv_union(spark, [str(tmp_path / "a.csv")], types={"k": "bigint"})
    assert dict(declared.dtypes)["k"] == "bigint"


def test_one_scan_lag_equals_the_lookup(spark):
    monthly = spark.createDataFrame([(1, 202312, 4), (1, 202401, 5), (1, 202403, 7), (2, 202402, 1)], "user_id int, p_mt int, cnt long")
    base = spark.createDataFrame([(u, m) for u in (1, 2, 3) for m in (202312, 202401, 202402, 202403, 202404)], "user_id int, p_mt int")
    keys = ["user_id", "p_mt"]
    want = calendar_lag(attach(base, monthly, keys, {"cnt": 0}), monthly, ["cnt"])
    got = attach(base, with_lag(monthly, ["cnt"], ["cnt"]), keys, {"cnt": 0, "lagged_cnt": 0})
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    assert got.where((F.col("user_id") == 1) & (F.col("p_mt") == 202401)).first().lagged_cnt == 4


def test_scoring_facts_of_saved_models_match_duckdb(spark):
    from check_oracle import digest, duck

    import __spark_entry__ as entry
    from given_tables import SF001
    from tenure.plans import q_models as qm

    entry.queries()
    small = {"churn": {"maxIter": 2, "maxDepth": 2}, "vod_purchase": {"numTrees": 3, "maxDepth": 3}}
    for task, (name, _, rows, features, label) in qm.TASKS.items():  # the query finds these and does not train
        data = rows(spark, SF001).filter(~F.col("is_val"))
        md.train_served(data, features, label, task, name, **small[task]).save(qm.model_path(spark, SF001, task))
    got = qm.m20_scoring_facts(spark, SF001)
    want = duck(SF001).execute(entry.oracle_sql()["m20_scoring_facts"])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert digest([tuple(r) for r in got.collect()], got.columns, None) == digest(want.fetchall(), columns, None)
