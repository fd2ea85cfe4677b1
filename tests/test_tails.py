"""Tail probabilities as columns against the scalar forms, exact counts against enumeration, and the DuckDB twins."""

import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tenure.functions import distributions as dist
from tenure.functions import tails


def test_log_gamma_and_beta(spark):
    values = [1e-3, 0.5, 1.0, 2.5, 7.0, 30.0, 31.0, 500.5, 1e6]
    df = spark.createDataFrame([(v,) for v in values], "z double")
    for r in df.select("z", tails.log_gamma(F.col("z")).alias("g"), tails.log_beta(F.col("z"), F.lit(0.5)).alias("b")).collect():
        assert r.g == pytest.approx(math.lgamma(r.z), rel=1e-13, abs=1e-13)
        assert r.b == pytest.approx(math.lgamma(r.z) + math.lgamma(0.5) - math.lgamma(r.z + 0.5), rel=1e-12, abs=1e-8 if r.z > 1e5 else 1e-12)


def test_tails_equal_the_scalar_forms(spark):
    pairs = [(x, d) for x in (0.0, 0.01, 0.7, 3.84, 12.5, 80.0, 900.0) for d in (1, 2, 3, 17, 140, 3000)]
    df = tails.with_t_two_sided(spark.createDataFrame(pairs, "x double, d int"), {"t": ("x", "d")})
    got = df.select("x", "d", "t", tails.chi_square_tail(F.col("x"), F.col("d")).alias("c"), tails.normal_two_sided(F.col("x")).alias("n")).collect()
    for r in got:
        assert r.c == pytest.approx(dist.chi2_sf(r.x, r.d), rel=1e-9, abs=1e-14)
        assert r.t == pytest.approx(dist.t_two_sided_p(r.x, r.d), rel=1e-9, abs=1e-14)
        assert r.n == pytest.approx(min(1.0, 2 * dist.norm_sf(r.x)), rel=1e-9)
    odd = spark.createDataFrame([(None, 3.0), (float("nan"), 3.0), (1.0, 0.0), (1.0, None)], "x double, d double")
    assert [r.t for r in tails.with_t_two_sided(odd, {"t": ("x", "d")}).collect()] == [None] * 4
    assert [r.c for r in odd.limit(2).select(tails.chi_square_tail(F.col("x"), F.col("d")).alias("c")).collect()] == [None] * 2


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 6), (3, 4), (5, 5), (8, 3)])
def test_exact_rank_sums_equal_enumeration(spark, n1, n2):
    counts = [0] * (n1 * n2 + 1)
    for chosen in itertools.combinations(range(n1 + n2), n1):
        counts[sum(chosen) - n1 * (n1 - 1) // 2] += 1
    want = [min(1.0, 2 * sum(counts[:min(u, n1 * n2 - u) + 1]) / sum(counts)) for u in range(n1 * n2 + 1)]
    df = spark.range(n1 * n2 + 1).select(tails.rank_sum_exact(F.col("id").cast("double"), F.lit(n1), F.lit(n2)).alias("p"))
    assert [r.p for r in df.collect()] == pytest.approx(want, rel=1e-12)


def test_duckdb_twins(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE s AS SELECT x AS stat, CAST(d AS DOUBLE) AS dof FROM (VALUES (0.3), (2.5), (7.0), (60.0)) v(x), (VALUES (1), (4), (37), (900)) w(d)")
    q = con.execute("WITH RECURSIVE " + tails.gamma_q_sql("g", "s", ["stat", "dof"], "dof / 2", "stat / 2") + " SELECT * FROM g").fetchall()
    t = con.execute("WITH RECURSIVE " + tails.t_two_sided_sql("g", "s", ["stat", "dof"], "stat", "dof") + " SELECT * FROM g").fetchall()
    assert len(q) == len(t) == 16
    for x, d, p in q:
        assert p == pytest.approx(dist.chi2_sf(float(x), d), rel=1e-9)
    for x, d, p in t:
        assert p == pytest.approx(dist.t_two_sided_p(float(x), d), rel=1e-9)
