"""Plan-shape checks: pruning and pushdown reach the scan, and no operator sorts everything in one task."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tenure.operators.ranking import first_rows, global_rank, share_within
from tenure.operators.sampling import rule_samples, seeded_sample

from given_tables import SF001


def _formatted(df) -> str:
    """The text ``df.explain("formatted")`` prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_flagship_pushes_year_and_prunes_columns(spark):
    text = _formatted(entry.queries()["a5_monthly_activity"](spark, SF001))
    assert "GreaterThanOrEqual(l_shipdate,1998-01-01T00:00)" in text
    assert "LessThan(l_shipdate,1999-01-01T00:00)" in text
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in text
    # lineitem scan reads only the five columns the view needs
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double," \
           "l_shipdate:timestamp_ntz>" in text
    # partial aggregation before the shuffle
    assert "partial_count" in text


def test_global_rank_has_no_unpartitioned_window(spark):
    df = spark.range(0, 1000).withColumn("v", F.col("id") % 7)
    ranked = global_rank(df, ["v", "id"], rank_col="r", num_partitions=4)
    text = _formatted(ranked)
    # the only window is over the per-partition counts (one row per range partition)
    assert "RangePartitioning" in text or "Scan ExistingRDD" in text
    assert ranked.filter("r is null").count() == 0


def _scans(df, table: str) -> int:
    """Reads of a table's file in the plan, a reused exchange not counted again."""
    return _formatted(df).split("\n(1) ")[-1].count(f"/{table}.parquet]")


@pytest.mark.parametrize("name, scans", [("a2_user_activity", 1), ("a3_a4_churn_v2", 1), ("a5_monthly_activity", 1), ("a8_churn_v3", 1),
                                         ("j6_purchase_dataset", 1), ("a9_channel_dataset", 2)])
def test_log_scans(spark, name, scans):
    """The log (lineitem) is read once; a9 needs one year with its assets and, apart, the time over all years."""
    assert _scans(entry.queries()[name](spark, SF001), "lineitem") == scans


def test_profiles_sort_no_distinct_values_as_a_whole(spark):
    for name in ("a1_schema_profile", "a17_top_values", "l7_rule_sample"):
        text = _formatted(entry.queries()[name](spark, SF001))
        assert "WindowGroupLimit" in text and "_mid" not in text and "spark_partition_id" not in text.lower()


def test_grouped_ranks_deal_the_rows_once(spark):
    df = spark.range(0, 500).selectExpr("id", "id % 3 AS g", "id % 7 AS v")
    text = _formatted(global_rank(df, ["v", "id"], group_cols=["g"], rank_col="r", num_partitions=4))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_first_rows_and_rule_samples_equal_the_whole_sort(spark):
    rows = [(i, i % 5 if i % 9 else None, (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g long, v long")
    got = {(r.g, r.rank): r.id for r in first_rows(df, ["g"], [F.col("v").desc(), F.col("id")], 4).collect()}
    for g in {r[1] for r in rows}:
        want = sorted((-v, i) for i, h, v in rows if h == g)[:4]
        assert [got[(g, k + 1)] for k in range(len(want))] == [i for _, i in want]
    rules = [("low", F.col("g") <= 1, 3, 1), ("all", F.lit(True), 5, 2), ("none", F.col("g") > 99, 2, 3)]
    picked = rule_samples(df, rules, ["id"]).collect()
    for name, cond, n, seed in rules:
        want = {r.id for r in seeded_sample(df.filter(cond), n, ["id"], seed).collect()}
        assert {r.id for r in picked if r.grp == name} == want
    assert rule_samples(df.limit(0), rules, ["id"]).count() == 0


def test_share_within_uses_aggregate_not_window(spark):
    df = spark.createDataFrame([(0, 1, 5), (0, 2, 5), (1, 1, 10)], "g int, k int, n long")
    out = share_within(df, "n", ["g"], "s")
    assert "Window" not in _formatted(out)
    assert sorted(r.s for r in out.collect()) == [0.5, 0.5, 1.0]


def test_flagship_does_no_text_work_per_event(spark):
    """The month comes from the timestamp fields: no event time is formatted or cut in the monthly build."""
    text = _formatted(entry.queries()["a5_monthly_activity"](spark, SF001))
    assert "date_format" not in text
    assert "substring" not in text


def test_recency_parses_days_once_per_group(spark):
    """Churn v2 aggregates the int day key; the only date conversion (make_date) sits after the aggregate."""
    import re
    text = _formatted(entry.queries()["a3_a4_churn_v2"](spark, SF001))
    assert "try_to_timestamp" not in text
    # node details are numbered bottom-up; split them into (id, body) sections
    parts = re.split(r"\n\((\d+)\) ", text)
    sections = [(int(parts[i]), parts[i + 1]) for i in range(1, len(parts) - 1, 2)]
    partial = min(i for i, body in sections if body.startswith("HashAggregate") and "partial_count(1)" in body
                  and "use_tms" in body)
    dated = [i for i, body in sections if "make_date" in body]
    assert dated and all(i > partial for i in dated)


def test_seeded_sample_merges_only_candidates(spark):
    """The top-n input is filtered by the hash-prefix cut before the single merge."""
    df = spark.range(0, 5000).withColumn("m", F.col("id") % 3)
    text = _formatted(seeded_sample(df, 10, ["id", "m"], 42))
    assert "TakeOrderedAndProject" in text
    assert "Filter" in text


def test_bucketed_tables_join_without_a_shuffle(spark):
    from tenure.plans import q_streaming as qs
    log, panel = qs.bucketed_tables(spark, SF001, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large to broadcast
    try:
        plan = qs.bucketed_counts(log, panel)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 4 and "Bucketed: true" in plan
