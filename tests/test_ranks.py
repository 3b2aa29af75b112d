"""Exact ranks, percentiles and rank tests against brute force, with one group holding most rows."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestlens.operators import comparisons, grouping, ranks


def skewed(spark, n=3000):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        v = rnd.choice([None, float("nan"), 1.0, 2.0, rnd.gauss(0, 1), rnd.gauss(1e6, 1), -1e12]) if i % 3 else rnd.random()
        rows.append((g, v))
    return rows, spark.createDataFrame(rows, "g string, v double")


def known(rows, g):
    return sorted(v for k, v in rows if k == g and v is not None and not math.isnan(v))


@pytest.mark.parametrize("levels,slices", [(1, 4), (2, 3), (1, 512)])
def test_counts_below(spark, levels, slices):
    rows, df = skewed(spark)
    got = ranks.cumulative_counts(df, ["g"], "v", levels=levels, slices=slices).collect()
    assert sum(r["n"] for r in got) == sum(len(known(rows, g)) for g in ("hot", "a", "b", None))
    for r in got:
        values = known(rows, r["g"])
        assert r["below_n"] == sum(v < r["value"] for v in values) and r["total_n"] == len(values)


def test_percentiles_match_linear_interpolation(spark):
    rows, df = skewed(spark)
    got = ranks.percentiles(df, ["g"], "v", {"p10": 0.1, "med": 0.5, "p100": 1.0}, slices=16).collect()
    assert len(got) == 4
    for r in got:
        assert np.allclose([r["p10"], r["med"], r["p100"]], np.percentile(known(rows, r["g"]), [10, 50, 100]))


@pytest.mark.parametrize("make", [lambda i: 1e9 if i == 7 else (i * 7919 % 40000) / 4e4, lambda i: math.exp(NormalDist().inv_cdf((i + 0.5) / 4e4))])
def test_no_slice_holds_most_of_a_group(spark, make):
    """One far value, or a long tail: the largest slice stays near the mean."""
    n = 40000
    df = spark.createDataFrame([("g", float(make(i))) for i in range(n)], "g string, v double")
    cut, _, keys = ranks._sliced(df, ["g"], "v", {"n": F.lit(1)}, ranks.SLICES, ranks.LEVELS)
    sizes = [r["count"] for r in cut.groupBy(*keys).count().collect()]
    assert max(sizes) <= 5 * n / ranks.SLICES
    values = [make(i) for i in range(n)]
    assert math.isclose(ranks.percentiles(df, ["g"], "v", {"m": 0.5}).first()["m"], float(np.median(values)), rel_tol=1e-12)


def test_overall_percentile_and_empty_input(spark):
    rows, df = skewed(spark)
    every = sorted(v for g in ("hot", "a", "b", None) for v in known(rows, g))
    assert math.isclose(ranks.percentiles(df, [], "v", {"m": 0.5}).first()["m"], float(np.median(every)))
    assert ranks.percentiles(df.filter("false"), [], "v", {"m": 0.5}).count() == 0


def test_median_table(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 7), ("b", None, 1)], "g string, x double, y int")
    got = {r["g"]: (r["x"], r["y"]) for r in ranks.median_by(df, ["g"], ["x", "y"]).collect()}
    assert got == {"a": (2.0, 6.0), "b": (None, 1.0)}


def test_group_statistics_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["m"] for r in grouping.with_group_stats(df, ["g"], {"m": F.avg("v")}).collect()}
    assert got == {("a", 1.0): 2.0, ("a", 3.0): 2.0, (None, 5.0): 5.0}


def test_group_statistics_use_no_window(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    plan = grouping.with_group_stats(df, ["g"], {"m": F.avg("v")})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_avg" in plan


def mann_whitney_u(x, y):
    return sum((a > b) + 0.5 * (a == b) for a in x for b in y)


def test_mann_whitney_with_ties(spark):
    rnd = random.Random(5)
    rows = [(int(rnd.random() < 0.4), float(rnd.randrange(6))) for _ in range(200)]
    df = spark.createDataFrame(rows, "f int, v double")
    got = comparisons.mann_whitney(df, "f", ["v"]).first()
    x, y = [v for f, v in rows if f == 0], [v for f, v in rows if f == 1]
    assert got["u_stat"] == mann_whitney_u(x, y) and 0 <= got["p_value"] <= 1


def test_welch_t(spark):
    x, y = [1.0, 2.0, 4.0], [2.0, 5.0, 9.0, 11.0]
    df = spark.createDataFrame([(0, v) for v in x] + [(1, v) for v in y], "f int, v double")
    got = comparisons.welch_t(df, "f", ["v"]).first()
    a, b = np.var(x, ddof=1) / 3, np.var(y, ddof=1) / 4
    assert math.isclose(got["t_stat"], (np.mean(x) - np.mean(y)) / math.sqrt(a + b))
    assert math.isclose(got["df"], (a + b) ** 2 / (a**2 / 2 + b**2 / 3))


def chi_square(table, correct):
    t = np.array(table, float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    d = np.abs(t - e)
    return float(((d - np.minimum(0.5, d) if correct else d) ** 2 / e).sum())


@pytest.mark.parametrize("table", [[[5, 1], [2, 8]], [[4, 0], [3, 6]], [[4, 0], [0, 6]], [[5, 1], [2, 8], [0, 3]]])
def test_chi_square_including_empty_cells(spark, table):
    rows = [(f"r{i}", j) for i, line in enumerate(table) for j, n in enumerate(line) for _ in range(n)]
    got = comparisons.chi2(spark.createDataFrame(rows, "a string, f int"), "a", "f").first()
    assert math.isclose(got["chi2"], chi_square(table, len(table) == 2)) and got["dof"] == len(table) - 1


def test_crosstab_margins(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0), ("y", None)], "a string, f int")
    got = {r["a"]: (r["n_0"], r["n_1"], r["n_total"], r["pct_1"]) for r in comparisons.crosstab(df, "a", "f", [0, 1], True).collect()}
    assert got == {"x": (1, 1, 2, 50.0), "y": (1, 0, 1, 0.0), "All": (2, 1, 3, 100 / 3)}
