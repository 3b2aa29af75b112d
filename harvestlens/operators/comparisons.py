"""Two-group comparisons, cross tables and test statistics from aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from harvestlens.functions.tails import chi_square_tail, normal_tail, student_tail
from harvestlens.operators.ranks import cumulative_counts, percentiles


def _long(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])
    rows = df.filter(F.col(flag).isin(0, 1)).select(F.col(flag).cast("int").alias("flag"), F.explode(items).alias("i"))
    return rows.select("flag", "i.variable", "i.value").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def two_group(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    """n, mean, sample spread and median of each column in both groups, and the difference of means."""
    long = _long(df, flag, cols)
    in_group = [F.when(F.col("flag") == g, F.col("value")) for g in (0, 1)]
    stats = long.groupBy("variable").agg(
        *[F.count(x).alias(f"n_{g}") for g, x in enumerate(in_group)],
        *[F.avg(x).alias(f"mean_{g}") for g, x in enumerate(in_group)],
        *[F.stddev_samp(x).alias(f"std_{g}") for g, x in enumerate(in_group)],
    )
    medians = percentiles(long, ["variable", "flag"], "value", {"med": 0.5}).groupBy("variable").agg(
        *[F.max(F.when(F.col("flag") == g, F.col("med"))).alias(f"median_{g}") for g in (0, 1)]
    )
    return stats.join(medians, "variable", "left").withColumn("mean_diff", F.col("mean_1") - F.col("mean_0"))


def welch_t(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    """Unequal-variance t statistic and degrees of freedom (group 0 minus group 1), with the two-sided p-value."""
    long = _long(df, flag, cols)
    xs = [F.when(F.col("flag") == g, F.col("value")) for g in (0, 1)]
    s = long.groupBy("variable").agg(
        *[F.count(x).alias(f"n{g}") for g, x in enumerate(xs)], *[F.avg(x).alias(f"m{g}") for g, x in enumerate(xs)],
        *[F.var_samp(x).alias(f"v{g}") for g, x in enumerate(xs)],
    ).filter((F.col("n0") >= 2) & (F.col("n1") >= 2))
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(e0 + e1))
    dof = F.try_divide(
        (e0 + e1) * (e0 + e1), e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1)
    )
    return s.select("variable", t.alias("t_stat"), dof.alias("df"), student_tail(t, dof).alias("p_value"))


def mann_whitney(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    """U of group 0 with tie-corrected z, continuity correction and normal p-value.

    Ranks come from value counts: a value's average rank is the count below it plus half its own ties.
    """
    long = _long(df, flag, cols).withColumns({"is0": F.when(F.col("flag") == 0, 1).otherwise(0)})
    ranks = cumulative_counts(long, ["variable"], "value", {"n": F.lit(1), "n0": F.col("is0")})
    n, n0 = F.col("n").cast("double"), F.col("n0").cast("double")
    mean_rank = F.col("below_n") + (n + 1) / 2
    s = ranks.groupBy("variable").agg(
        F.sum(n0 * mean_rank).alias("r0"), F.sum(n * n * n - n).alias("ties"),
        F.max("total_n").cast("double").alias("n"), F.max("total_n0").cast("double").alias("n0"),
    ).withColumn("n1", F.col("n") - F.col("n0")).filter((F.col("n0") > 0) & (F.col("n1") > 0))
    u = F.col("r0") - F.col("n0") * (F.col("n0") + 1) / 2
    half = F.col("n0") * F.col("n1") / 2
    spread = F.sqrt(
        F.col("n0") * F.col("n1") / 12 * (F.col("n") + 1 - F.try_divide(F.col("ties"), F.col("n") * (F.col("n") - 1)))
    )
    larger = F.greatest(u, F.col("n0") * F.col("n1") - u)
    z = F.try_divide(larger - half - F.lit(0.5), spread)
    return s.select("variable", u.alias("u_stat"), z.alias("z"), F.when(z < 0, F.lit(1.0)).otherwise(normal_tail(z)).alias("p_value"))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence, margins: bool = False, total: str = "All") -> DataFrame:
    """Counts of `a` by the given values of `b`, with the row total and row percentages.

    The values of `b` are passed in, so no extra pass looks for them. Margins add one row over all groups.
    """
    names = [str(v) for v in values]
    counts = [F.count_if(F.col(b) == v).alias(f"n_{n}") for v, n in zip(values, names)]
    rows = df.filter(F.col(b).isNotNull() & F.col(a).isNotNull())
    rows = rows.withColumn("__a", F.col(a).cast("string"))
    every = F.count(F.lit(1)).alias("n_total")
    if margins:
        out = rows.rollup("__a").agg(*counts, every).withColumn("__a", F.coalesce("__a", F.lit(total)))
    else:
        out = rows.groupBy("__a").agg(*counts, every)
    shown = [F.try_divide(F.col(f"n_{n}") * F.lit(100.0), F.col("n_total")).alias(f"pct_{n}") for n in names]
    return out.select(F.col("__a").alias(a), *[f"n_{n}" for n in names], "n_total", *shown)


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square independence test of two columns with its p-value; 2×2 tables get the continuity correction.

    Cells without rows are accounted for through the row and column totals. One row or column alone has no degrees of freedom and no p-value.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("c"))
    tall = rows.agg(F.struct(F.count(F.lit(1)).alias("k"), F.sum("r").alias("n"), F.sum(1 / F.col("r")).alias("inv")).alias("s"))
    wide = cols.agg(F.struct(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("c")).alias("inv")).alias("s"))
    full = cells.join(rows, "a").join(cols, "b").withColumns({"rs": tall.scalar(), "cs": wide.scalar()})
    n = F.col("rs.n")
    full = full.withColumn("e", F.col("r") * F.col("c") / n).withColumn("gap", F.abs(F.col("o") - F.col("e")))
    # expected counts sum to n over all cells, and an unseen cell adds its expected count
    plain = F.sum(F.col("gap") * F.col("gap") / F.col("e")) + F.max(n) - F.sum("e")
    # all four gaps of a 2x2 table are equal, and its reciprocal expected counts multiply out
    gap = F.max("gap") - F.least(F.lit(0.5), F.max("gap"))
    corrected = gap * gap * F.max(n * F.col("rs.inv") * F.col("cs.inv"))
    square = (F.max("rs.k") == 2) & (F.max("cs.k") == 2)
    test = full.agg(
        F.when(square, corrected).otherwise(plain).alias("chi2"),
        ((F.max("rs.k") - 1) * (F.max("cs.k") - 1)).alias("dof"),
    )
    return test.withColumn("p_value", chi_square_tail(F.col("chi2"), F.col("dof")))


def year_vs_rest(df: DataFrame, value: str, case_year: int, year="year") -> DataFrame:
    """Mean in one year, mean in all other years, and their difference."""
    here = F.avg(F.when(F.col(year) == case_year, F.col(value)))
    rest = F.avg(F.when(F.col(year) != case_year, F.col(value)))
    return df.agg(here.alias("case_mean"), rest.alias("other_mean")).withColumn(
        "difference", F.col("case_mean") - F.col("other_mean")
    )
