"""A subset of the driver's Spark-vs-DuckDB comparison at sf0.001 (the full set runs in tools/check_oracle.py)."""

import os
import sys

import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import digest, duck  # noqa: E402

from given_tables import SF001

NAMES = ["a5_monthly_activity", "a2_user_activity", "j2_fanout_activity", "a3_a4_churn_v2", "j6_purchase_dataset",
         "a8_churn_v3", "l2_class_ratio_sample", "l5_train_val_split", "w1_rank_buckets", "f10_f15_scores",
         "a14_class_mix_shift", "p3_p5_clean_panel", "t3_normality", "t4_t5_mann_whitney", "t10_decisions", "t6_t7_chi_square",
         "a19_usage_rates", "a20_overlapping_segments",
         "m9_ranking_metrics", "m17_feature_impact"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    sdf = entry.queries()[name](spark, SF001)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = [tuple(r) for r in res.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(srows, sdf.columns, None) == digest(drows, dcols, None)
