"""Tail probabilities against closed forms that hold for whole degrees of freedom."""

import math

import pytest
from pyspark.sql import functions as F

from harvestlens.functions import tails
from harvestlens.operators import comparisons


def chi_square(x, k):
    """Finite sums: of Poisson terms for even k, of half-whole ones and the error function for odd k."""
    h = x / 2
    terms = [] if k % 2 == 0 else [math.erfc(math.sqrt(h))]
    for i in range(k // 2):
        s = i + (k % 2) / 2
        terms.append(math.exp(s * math.log(h) - h - math.lgamma(s + 1)))
    return math.fsum(terms)


def student(t, v):
    """Finite trigonometric sums, one for odd and one for even degrees of freedom."""
    angle = math.atan(abs(t) / math.sqrt(v))
    c, s = math.cos(angle), math.sin(angle)
    if v % 2 == 0:
        terms = [1.0]
        for i in range(1, v // 2):
            terms.append(terms[-1] * (2 * i - 1) / (2 * i) * c * c)
        return 1 - s * math.fsum(terms)
    terms = [c] if v > 1 else []
    for i in range(1, (v - 1) // 2):
        terms.append(terms[-1] * 2 * i / (2 * i + 1) * c * c)
    return 1 - 2 / math.pi * (angle + s * math.fsum(terms))


def test_chi_square_and_student_from_1_to_500_degrees(spark):
    rows = [(k, k * f, 2 * f, chi_square(k * f, k), student(2 * f, k)) for k in range(1, 501) for f in (0.05, 0.5, 0.95, 1.0, 1.1, 1.6, 3.5)]
    df = spark.createDataFrame(rows, "k int, x double, t double, chi double, student double")
    got = df.select("*", tails.chi_square_tail(F.col("x"), F.col("k")).alias("p"), tails.student_tail(F.col("t"), F.col("k")).alias("q")).collect()
    assert max(abs(r["p"] - r["chi"]) for r in got) < 1e-11
    assert max(abs(r["q"] - r["student"]) for r in got) < 1e-11
    assert max(abs(r["p"] / r["chi"] - 1) for r in got if r["chi"] > 1e-200) < 1e-8


def test_many_degrees_and_the_normal_limit(spark):
    df = spark.createDataFrame([(z / 10,) for z in range(-90, 91)], "z double")
    got = df.select("z", tails.normal_tail(F.col("z")).alias("p"), tails.student_tail(F.col("z"), F.lit(1e6)).alias("t")).collect()
    assert max(abs(r["p"] - math.erfc(abs(r["z"]) / math.sqrt(2))) for r in got) < 1e-14
    assert max(abs(r["p"] - r["t"]) for r in got) < 1e-6
    far = spark.range(1).select(tails.chi_square_tail(F.lit(1e6 + 2000.0), F.lit(1_000_000)).alias("p")).first()["p"]
    # the cube-root approximation is good to a few millionths there
    z = ((1 + 2e-3) ** (1 / 3) - (1 - 2 / 9e6)) / math.sqrt(2 / 9e6)
    assert far == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-4)


def test_edges(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(
        tails.normal_tail(none).alias("a"), tails.chi_square_tail(none, F.lit(3)).alias("b"), tails.chi_square_tail(F.lit(2.0), F.lit(0)).alias("c"),
        tails.student_tail(F.lit(1.0), none).alias("d"), tails.student_tail(F.lit(float("inf")), F.lit(4)).alias("e"), tails.student_tail(F.lit(0.0), F.lit(4)).alias("f"),
        tails.chi_square_tail(F.lit(0.0), F.lit(3)).alias("g"), tails.chi_square_tail(F.lit(5000.0), F.lit(3)).alias("h"),
    ).first()
    assert list(row)[:4] == [None] * 4 and list(row)[4:] == [0.0, 1.0, 1.0, 0.0]


def test_p_values_of_the_comparisons(spark):
    rows = [(0, 1.0, "a"), (0, 2.0, "a"), (0, 4.0, "b"), (1, 3.0, "b"), (1, 6.0, "b"), (1, 7.0, "c"), (1, 9.5, "c")]
    df = spark.createDataFrame(rows, "flag int, x double, kind string")
    welch = comparisons.welch_t(df, "flag", ["x"]).first()
    # the degrees of freedom are no whole number, so the density is summed
    v, t = welch["df"], abs(welch["t_stat"])
    scale = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi * v)
    n = 20000
    area = sum((1 if i in (0, n) else 4 if i % 2 else 2) * (1 + (i * t / n) ** 2 / v) ** (-(v + 1) / 2) for i in range(n + 1)) * t / n / 3
    assert welch["p_value"] == pytest.approx(1 - 2 * scale * area, abs=1e-9)
    table = comparisons.chi2(df, "kind", "flag").first()
    assert table["dof"] == 2 and table["p_value"] == pytest.approx(math.exp(-table["chi2"] / 2), abs=1e-12)
    alone = comparisons.chi2(df.filter("flag = 0"), "kind", "flag").first()
    assert alone["dof"] == 0 and alone["p_value"] is None
    same = comparisons.mann_whitney(df.withColumn("x", F.lit(1.0)), "flag", ["x"]).first()
    assert same["p_value"] is None or same["p_value"] == 1.0
