"""Fixture facts of the stand-in views and the driver contract."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tenure.sources import views

from given_tables import SF001, SF01


def test_view_facts(spark):
    c = views.content(spark, SF01)
    assert c.count() == 2000
    assert {r[0]: r[1] for r in c.groupBy("asset_prod").count().collect()} == {0: 667, 1: 667, 2: 666}
    assert c.filter("adult_yn").count() == 40
    a = views.activity(spark, SF01)
    assert a.count() == 60000
    assert a.filter("strt_dt is null").count() == 8598
    p = views.panel(spark, SF01)
    assert p.count() == 14060
    assert p.select("user_id", "p_mt").distinct().count() == 14060
    assert p.agg(F.sum("cancel_yn")).first()[0] == 967
    assert p.filter("ott_yn is null").count() == 2773


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "p_mt", "vod_view_cnt", "vod_use_tms_sum"]
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_fixture_counts(spark):
    qs = entry.queries()
    assert qs["a5_monthly_activity"](spark, SF01).count() == 4898
    lag = qs["j6_purchase_dataset"](spark, SF01)
    assert lag.count() == 2072
    assert lag.filter("lagged_rvod_cnt <> 0").count() == 267
    sample = qs["l2_class_ratio_sample"](spark, SF01)
    assert {r[0]: r[1] for r in sample.groupBy("cancel_yn").count().collect()} == {0: 540, 1: 128}
    assert qs["a5_monthly_activity"](spark, SF001).count() > 0


def test_scale_conf_partition_bounds():
    from tenure.session import scale_conf
    c = scale_conf(30 * 1024 ** 4)  # a 30 TiB shuffle: about 256 MiB per reduce partition
    assert int(c["spark.sql.shuffle.partitions"]) == 30 * 1024 ** 4 // (256 << 20)
    assert scale_conf(1)["spark.sql.shuffle.partitions"] == "200"
    assert int(scale_conf(10 ** 18)["spark.sql.shuffle.partitions"]) == -(-10 ** 18 // (256 << 20))
    assert scale_conf(10 ** 18, max_partitions=200_000)["spark.sql.shuffle.partitions"] == "200000"


def test_a_missing_library_costs_only_the_queries_that_need_it():
    import os
    import subprocess
    import sys
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) >= 100 and 'op9_url_filter' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)), timeout=120)
