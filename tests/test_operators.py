"""Hand-made edge frames per operator (FIXTURES.md section 4) and properties."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tenure.functions import distributions as dist
from tenure.functions.months import day_of, last_day_of, prev_month, valid_month
from tenure.operators import activity as act
from tenure.operators import encode as enc
from tenure.operators import leakage as lk
from tenure.operators import metrics as mt
from tenure.operators import stats as st
from tenure.operators.joins import calendar_lag
from tenure.operators.quantiles import exact_quantiles, grouped_quantiles
from tenure.operators.ranking import global_rank, rank_buckets, running_sums
from tenure.operators.sampling import (class_ratio_sample, hash32, seeded_sample, stratified_folds,
                                      stratified_split)
from tenure.sources import ingest


def test_calendar_lag_gap_and_january(spark):
    monthly = spark.createDataFrame([(1, 199803, 5), (1, 199805, 7), (2, 199712, 3)], "user_id long, p_mt int, rvod_cnt long")
    base = spark.createDataFrame([(1, 199804), (1, 199805), (1, 199806), (2, 199801)], "user_id long, p_mt int")
    got = {(r.user_id, r.p_mt): r.lagged_rvod_cnt for r in calendar_lag(base, monthly, ["rvod_cnt"]).collect()}
    assert got == {(1, 199804): 5, (1, 199805): 0, (1, 199806): 7, (2, 199801): 3}


def test_prev_month_and_bad_month(spark):
    df = spark.createDataFrame([(199801,), (199812,), (202313,), (202300,)], "p_mt int")
    rows = df.select(prev_month("p_mt").alias("pm"), valid_month("p_mt").alias("ok")).collect()
    assert [r.pm for r in rows] == [199712, 199811, 202312, 202299]
    assert [r.ok for r in rows] == [True, True, False, False]
    issues = lk.month_format_issues(df, "p_mt", "p_mt").first()
    assert issues.invalid == 2


def test_day_key_matches_date_parse(spark):
    """The arithmetic day key accepts exactly the strings a yyyyMMdd parse accepts (years 1000-9999)."""
    import datetime
    days, d = [], datetime.date(1899, 1, 1)
    while d.year < 2101:
        days.append(d.strftime("%Y%m%d") + "120000")
        d += datetime.timedelta(days=1)
    odd = [f"{y}{m:02d}{dd:02d}" for y in (1900, 2000, 2023, 2024) for m in range(0, 14) for dd in range(0, 33)]
    odd += ["2023011", " 2023011", "+2023011", "2023-01-", "abcdefgh", "", None]
    df = spark.createDataFrame([(v,) for v in days + odd], "s string")
    parsed = F.try_to_timestamp(F.substring("s", 1, 8), F.lit("yyyyMMdd")).cast("date")
    assert df.filter(~F.equal_null(parsed, day_of("s"))).count() == 0
    # latest day per user from the aggregated key equals the max of parsed days
    ev = spark.createDataFrame([(1, "20231231010101"), (1, "20230229000000"), (1, "20240101"), (2, None), (2, "2023133")],
                               "u int, s string")
    got = {r.u: r.d for r in ev.groupBy("u").agg(last_day_of("s").alias("d")).collect()}
    assert got == {1: datetime.date(2024, 1, 1), 2: None}


@pytest.mark.parametrize("n", [1, 3, 500, 19000, 30000])
def test_seeded_sample_equals_plain_top_n(spark, n):
    """The prefix-count pre-filter returns the rows of a plain hash-order top-n (null keys sort first)."""
    df = spark.range(0, 20000).select((F.col("id") % 7001).alias("u"), (F.col("id") % 13).alias("m")) \
              .union(spark.createDataFrame([(None, 1), (None, 2)], "u long, m long"))
    keys = ["u", "m"]
    plain = df.withColumn("_h", hash32(keys, 42)).orderBy("_h", *keys).limit(n).drop("_h")
    got = sorted(map(tuple, seeded_sample(df, n, keys, 42, prefix_bits=8).collect()), key=repr)
    assert got == sorted(map(tuple, plain.collect()), key=repr)
    assert len(got) == min(n, 20002)


def test_fanout_equals_distinct_times_multiplicity(spark):
    log = spark.createDataFrame([(1, "a", 10), (1, "b", 5), (1, "a", 1), (2, "c", 4)], "user_id long, asset string, use_tms long")
    panel = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "user_id long, p_mt int")
    d = {r.user_id: r for r in act.user_activity(log, users=panel).collect()}
    f = {r.user_id: r for r in act.user_activity(log, users=panel, fanout=True, user_rows=panel).collect()}
    assert (d[1].vod_view_cnt, d[1].vod_use_tms_sum, d[1].vod_asset_cnt) == (3, 16, 2)
    assert (f[1].vod_view_cnt, f[1].vod_use_tms_sum, f[1].vod_asset_cnt) == (9, 48, 2)
    assert (f[2].vod_view_cnt, f[2].vod_use_tms_sum) == (1, 4)


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 2), (3, 2), (3, 2)], "u long, m int")
    got = {(r.u, r.m): r.cnt for r in lk.duplicate_keys(df, ["u", "m"]).collect()}
    assert got == {(1, 1): 2, (3, 2): 3}


@pytest.mark.parametrize("n,q,expected", [(6, 4, [1, 1, 2, 3, 4, 4]), (8, 4, [1, 1, 2, 2, 3, 3, 4, 4]), (1, 4, [1])])
def test_rank_bucket_is_rank_first_qcut(spark, n, q, expected):
    df = spark.createDataFrame([(i, 5.0) for i in range(n)], "user_id long, v double")  # all tied: order by user
    got = [r.b for r in rank_buckets(df, "v", "user_id", q, "b").orderBy("user_id").collect()]
    assert got == expected


def test_global_rank_matches_row_number(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 5), rnd.choice(["a", "b", "c"])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v int, g string").repartition(7)
    ours = global_rank(df, ["v", "k"], group_cols=["g"], rank_col="r", num_partitions=5)
    w = Window.partitionBy("g").orderBy("v", "k")
    ref = df.withColumn("r2", F.row_number().over(w))
    j = ours.join(ref, ["k", "v", "g"])
    assert j.count() == 500
    assert j.filter("r <> r2").count() == 0


def test_running_sums(spark):
    rows = [(i, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x double")
    out = running_sums(df, ["k"], ["x"], num_partitions=6).orderBy("k").collect()
    assert [r.cum_x for r in out] == list(np.cumsum([x for _, x in rows]))


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    vals = [float(rnd.choice([0, 0, 0, rnd.random() * 100])) for _ in range(1001)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, "x", [0.25, 0.5, 0.75, 0.99])
    want = np.quantile(np.array(vals), [0.25, 0.5, 0.75, 0.99])
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12)
    g = grouped_quantiles(df.withColumn("grp", F.lit("a")), "x", [0.5], ["grp"]).first()
    assert math.isclose(g.q, float(np.median(vals)), rel_tol=1e-12)


def test_category_codes_null_is_minus_one(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    d = enc.code_dictionary(df, ["c"])
    assert [r.c for r in enc.apply_codes(df, ["c"], d).collect()] == [1, -1, 0]
    nums = spark.createDataFrame([(10,), (2,), (None,)], "c int")
    dn = enc.code_dictionary(nums, ["c"])
    assert [r.c for r in enc.apply_codes(nums, ["c"], dn).collect()] == [1, 0, -1]


def test_standardize_population_sd(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    s = enc.scaler_stats(df, ["x"])
    assert math.isclose(s["x"][1], 1.118033988749895)


def test_csv_differing_headers(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("x,y\n1,2\n3,4\n")
    b.write_text("y,z\n5,6\n")
    df = ingest.read_csv_union(spark, [str(a), str(b)])
    assert sorted(df.columns) == ["x", "y", "z"]
    rows = sorted((repr(r.x), r.y, repr(r.z)) for r in df.collect())
    assert rows == sorted([("1", 2, "None"), ("3", 4, "None"), ("None", 5, "6")])


def test_chi_square_yates_and_3x2():
    stat, dof, p = st.chi_square(np.array([[10, 20], [30, 40]]))
    # hand computation with Yates' correction: expected 12,18,28,42
    exp = np.array([[12, 18], [28, 42]])
    obs = np.array([[10.5, 19.5], [29.5, 40.5]])
    assert dof == 1 and math.isclose(stat, float(((obs - exp) ** 2 / exp).sum()))
    stat3, dof3, p3 = st.chi_square(np.array([[10, 20], [30, 40], [5, 5]]))
    t = np.array([[10, 20], [30, 40], [5, 5]], dtype=float)
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    assert dof3 == 2 and math.isclose(stat3, float(((t - e) ** 2 / e).sum()))
    assert math.isclose(p3, math.exp(-stat3 / 2), rel_tol=1e-9)


def test_distributions_known_values():
    assert math.isclose(dist.norm_sf(1.959963984540054), 0.025, rel_tol=1e-9)
    assert math.isclose(dist.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-7)
    assert math.isclose(dist.t_two_sided_p(2.228138851986274, 10), 0.05, rel_tol=1e-7)


def test_mann_whitney_matches_brute_force(spark):
    rnd = random.Random(9)
    a = [rnd.randint(0, 6) for _ in range(40)]
    b = [rnd.randint(1, 8) for _ in range(55)]
    df = spark.createDataFrame([("c", True, float(v)) for v in a] + [("c", False, float(v)) for v in b],
                               "column string, is_pos boolean, value double")
    r = st.rank_sums(df).first()
    allv = np.array(a + b, dtype=float)
    order = allv.argsort(kind="mergesort")
    ranks = np.empty(len(allv))
    ranks[order] = np.arange(1, len(allv) + 1)
    for v in np.unique(allv):  # average ranks for ties
        ranks[allv == v] = ranks[allv == v].mean()
    assert math.isclose(r.rank_sum_pos, ranks[:len(a)].sum())
    u1 = ranks[:len(a)].sum() - len(a) * (len(a) + 1) / 2
    brute_u = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)
    assert math.isclose(u1, brute_u)
    u, z, p = st.mann_whitney_from(r.n_pos, r.n_neg, r.rank_sum_pos, r.tie_term)
    assert math.isclose(u, brute_u) and 0 < p < 1


def _brute_ap(labels, scores):
    pairs = sorted(zip(scores, labels), key=lambda x: -x[0])
    npos = sum(labels)
    ap, tp, n, i = 0.0, 0, 0, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        grp = pairs[i:j]
        gtp = sum(l for _, l in grp)
        tp += gtp
        n += len(grp)
        ap += gtp / npos * (tp / n)
        i = j
    return ap


def test_average_precision_is_step_sum(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, label int, score double")
    got = mt.ap_auc(df, "score", "label").first()
    assert math.isclose(got.ap, _brute_ap([r[1] for r in rows], [r[2] for r in rows]), rel_tol=1e-9)
    pos = [s for _, l, s in rows if l == 1]
    neg = [s for _, l, s in rows if l == 0]
    auc = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert math.isclose(got.roc_auc, auc, rel_tol=1e-9)


def test_empty_positive_class(spark):
    df = spark.createDataFrame([(i, 0, i / 10.0) for i in range(10)], "k long, label int, score double")
    m = mt.ranking_metrics(df, "score", "label", ["k"]).first()
    assert m.ap is None and m.lift_at_10 is None and m.precision_at_10 == 0.0
    th = mt.threshold_metrics(df, "score", "label").first()
    assert th.precision == 0.0 and th.recall == 0.0 and th.f1 == 0.0


def test_samples_stable_under_repartitioning(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(400)], "user_id long, label int")
    a = {r.user_id for r in seeded_sample(df.repartition(1), 37, ["user_id"]).collect()}
    b = {r.user_id for r in seeded_sample(df.repartition(16), 37, ["user_id"]).collect()}
    assert a == b and len(a) == 37
    s1 = {r.user_id for r in class_ratio_sample(df.repartition(1), "label", "user_id", 0.5, {0: 0.5, 1: 0.5}).collect()}
    s2 = {r.user_id for r in class_ratio_sample(df.repartition(16), "label", "user_id", 0.5, {0: 0.5, 1: 0.5}).collect()}
    assert s1 == s2 and s1 <= set(range(400))


def test_split_and_folds_are_stratified(spark):
    df = spark.createDataFrame([(i, 1 if i < 50 else 0) for i in range(500)], "user_id long, label int")
    sp = stratified_split(df, "label", ["user_id"], 0.2)
    got = {(r.label, r.is_val): r["count"] for r in sp.groupBy("label", "is_val").count().collect()}
    assert got[(1, True)] == 10 and got[(0, True)] == 90
    f = stratified_folds(df, "label", ["user_id"], 5)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_name_tokens():
    assert lk.has_risk_token("AGMT_END_SEG") and lk.has_risk_token("voc_cancel_yn")
    assert not lk.has_risk_token("SMS_SEND_CLS_NM")


def test_vif_sweeps_equal_the_inverse_and_skip_dependent_columns(spark):
    def vif(names, pairs):
        return {r.feature: r.vif for r in st.vif_columns(spark.createDataFrame(pairs, "col_a string, col_b string, r double"), names).collect()}

    got = vif(["a", "b", "c"], [("a", "b", 0.5), ("a", "c", 0.2), ("b", "c", 0.3)])
    m = np.array([[1, .5, .2], [.5, 1, .3], [.2, .3, 1]])
    assert np.allclose([got[n] for n in "abc"], np.diag(np.linalg.inv(m)))
    x = np.random.default_rng(1).standard_normal((400, 7))
    x[:, 3] = x[:, 0] + 0.3 * x[:, 1]
    x[:, 5] = x[:, 4]  # equal columns
    x[:, 6] = x[:, 2] + 0.2 * x[:, 6]
    names, r = list("abcdefg"), np.corrcoef(x.T)
    got = vif(names, [(names[i], names[j], float(r[i, j])) for i in range(7) for j in range(i + 1, 7)])
    for i, n in enumerate(names):
        rest = [j for j in range(7) if j != i]
        r2 = r[i, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], rcond=1e-10, hermitian=True) @ r[i, rest]
        assert got[n] == float("inf") if r2 >= 0.9999 else math.isclose(got[n], 1 / (1 - r2), rel_tol=1e-6)
    assert got["e"] == got["f"] == float("inf") and got["g"] > 10
    assert vif(["a", "b"], [("a", "b", None)]) == {"a": 1.0, "b": 1.0}


def test_small_samples_without_ties_have_exact_p(spark):
    rows = [("exact", 1.0, True), ("exact", 4.0, True), ("exact", 9.0, True), ("exact", 2.0, False), ("exact", 3.0, False), ("exact", 5.0, False), ("exact", 7.0, False)]
    rows += [("ties", v, p) for v, p in ((1.0, True), (1.0, False), (2.0, True), (3.0, False))]
    rows += [("large", float(i), i % 3 == 0) for i in range(60)]
    sums = st.rank_sums(spark.createDataFrame(rows, "column string, value double, is_pos boolean"))
    got = {r.column: r for r in st.mann_whitney_columns(sums).withColumnsRenamed({"u_pos": "u", "p_value": "p"}).collect()}
    us = [sum(c) - 3 for c in itertools.combinations(range(7), 3)]
    least = min(got["exact"].u, 12 - got["exact"].u)
    assert math.isclose(got["exact"].p, min(1.0, 2 * sum(u <= least for u in us) / len(us)))
    for c in ("ties", "large"):
        r = got[c]
        assert math.isclose(r.p, st.mann_whitney_from(r.n_pos, r.n_neg, r.rank_sum_pos, r.tie_term)[2], rel_tol=1e-9)


def test_sweep_names_test_and_effect_of_each_column(spark):
    rng = np.random.default_rng(2)
    rows = [(int(y := i % 2), float(rng.normal(y)), float(rng.exponential()), "ab"[int(rng.random() < 0.3 + 0.4 * y)], 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "y int, normal double, skewed double, kind string, flat double")
    got = {r.column: r for r in st.eda_sweep(df, "y", ["normal", "skewed", "flat"], ["kind"]).collect()}
    assert {c: r.test for c, r in got.items()} == {"normal": "t-test", "skewed": "Mann-Whitney U", "flat": "Mann-Whitney U", "kind": "chi2"}
    assert got["normal"].significant and got["kind"].significant and not got["flat"].significant and got["flat"].effect == 0.0
    a, b = ([r[1] for r in rows if r[0] == g] for g in (0, 1))
    m = [{"n": len(v), "mean": np.mean(v), "var": np.var(v, ddof=1)} for v in (a, b)]
    t, p = st.welch_t(*m)
    assert math.isclose(got["normal"].statistic, t, rel_tol=1e-9) and math.isclose(got["normal"].p_value, p, rel_tol=1e-7)


def test_multi_rank_buckets_equal_single(spark):
    from tenure.operators.ranking import multi_rank_buckets
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, float(rnd.randint(0, 9)), float(rnd.randint(0, 3))) for i in range(103)],
                               "user_id long, a double, b double")
    multi = multi_rank_buckets(df, "user_id", {"qa": (F.col("a"), 4), "qb4": (F.col("b"), 4), "qb5": (F.col("b"), 5)})
    single = rank_buckets(rank_buckets(rank_buckets(df, "a", "user_id", 4, "qa"), "b", "user_id", 4, "qb4"),
                          "b", "user_id", 5, "qb5")
    j = multi.alias("m").join(single.alias("s"), "user_id")
    assert j.count() == 103
    assert j.filter("m.qa <> s.qa OR m.qb4 <> s.qb4 OR m.qb5 <> s.qb5").count() == 0


def test_recency_month_end_is_point_in_time(spark):
    log = spark.createDataFrame([(1, "19980305000000"), (1, "19980520000000"), (2, None)],
                                "user_id long, strt_dt string")
    panel = spark.createDataFrame([(1, 199802), (1, 199803), (1, 199804), (1, 199805), (2, 199805)],
                                  "user_id long, p_mt int")
    got = {(r.user_id, r.p_mt): r.recency_month_end for r in act.recency_month_end(panel, log).collect()}
    assert got == {(1, 199802): 999, (1, 199803): 26, (1, 199804): 56, (1, 199805): 11, (2, 199805): 999}


def test_type_inference_reads_every_value(spark):
    from tenure.operators import profile as prof
    codes = [str(i) for i in range(30)]
    rows = [(c, c if i else "abc", f"{c}.5", "Y" if i % 2 else "n", None, f" {c} ") for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "whole string, late string, number string, flag string, none string, padded string")
    got = {c: t for c, (_, t) in prof.infer_types(df, prof.schema_profile(df, "t")).items()}
    assert got == {"whole": "BIGINT", "late": "CATEGORY", "number": "DOUBLE", "flag": "BOOLEAN", "none": "VARCHAR", "padded": "BIGINT"}


def test_chi_square_columns_equal_the_array_form(spark):
    from tenure.operators import stats as st
    tables = {"two": [[8, 2], [1, 5]], "three": [[3, 0], [4, 6], [1, 9]], "flat": [[4, 4]]}
    cells = [(c, str(i), j, n) for c, t in tables.items() for i, r in enumerate(t) for j, n in enumerate(r) if n]
    got = {r["column"]: r for r in st.chi_square_columns(spark.createDataFrame(cells, "column string, value string, group int, cnt long")).collect()}
    assert set(got) == {"two", "three"}
    for c, r in got.items():
        stat, dof, _ = st.chi_square(np.array(tables[c]))
        assert abs(r["chi2"] - stat) < 1e-9 and r["dof"] == dof and r["n"] == sum(map(sum, tables[c]))


def test_severity_rolls_up_findings(spark):
    from tenure.operators import leakage as lk
    df = spark.createDataFrame([(1, 202313, 1.0), (1, 202313, 2.0), (2, 202301, 3.0)], "user_id long, p_mt int, agmt_end_seg double")
    corr = spark.createDataFrame([("agmt_end_seg", 0.99, True), ("x", 0.1, False)], "feature string, corr_with_target double, critical boolean")
    dominance = spark.createDataFrame([("x", 0.6), ("y", 0.2)], "feature string, share double")
    r = lk.severity(lk.findings(df, ["agmt_end_seg", "user_id"], ["user_id"], corr, ["user_id", "p_mt"], "p_mt", dominance)).first()
    assert tuple(r) == ("critical", 1, 1, 1, 1, 2, 1, "agmt_end_seg")
    clean = df.where("user_id = 2")
    none = lk.severity(lk.findings(clean, ["tv"], ["user_id"], corr.where("NOT critical"), ["user_id", "p_mt"], "p_mt")).first()
    assert tuple(none) == ("none", 0, 0, 0, 0, 0, 0, "")


@pytest.mark.parametrize("share, n", [(0.7, 1), (0.5, 0)])
def test_leakage_report_checks_dominance(spark, monkeypatch, share, n):
    import __spark_entry__ as entry
    from given_tables import SF001
    from tenure.plans import q_models as qm
    report = entry.queries()["q7_leakage_report"]
    monkeypatch.setattr(qm, "_prior_rf", lambda *a, **k: ([("tv_hours", share), ("recency", 1 - share)], None, None))
    assert report(spark, SF001).first()["n_dominance"] == n


def test_checkpoint_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as N
    from tenure.session import ensure_checkpoint_dir
    sc = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(N(sparkContext=sc, conf=N(get=lambda k, d: d)))
