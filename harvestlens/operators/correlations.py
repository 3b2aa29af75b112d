"""Correlation of the target with features, and column profiles; one aggregate over the table each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window


def safe_corr(x, y) -> Column:
    """Pearson correlation over rows where both values are known; NULL where either is constant."""
    x, y = F.col(x).try_cast("double"), F.col(y).try_cast("double")
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(xx) * F.stddev_pop(yy)
    # a constant column can leave rounding noise in its spread, so its range decides
    varies = (F.min(xx) < F.max(xx)) & (F.min(yy) < F.max(yy))
    return F.when(varies, F.try_divide(F.covar_pop(xx, yy), spread))


def unpivot_row(df: DataFrame, by: Sequence[str], cols: Sequence[str], key: str, value: str) -> DataFrame:
    """Turn the columns of each (already aggregated) row into rows."""
    return df.unpivot(list(by), list(cols), key, value)


def corr_rank(df: DataFrame, target: str, features: Sequence[str], by: Sequence[str] = (), digits: int | None = 4):
    """Correlation of the target with every feature, per group. Sort by abs_correlation to rank."""
    wide = df.groupBy(*by).agg(*[safe_corr(target, f).alias(f) for f in features])
    long = unpivot_row(wide, by, features, "feature", "__r")
    r = F.round("__r", digits) if digits is not None else F.col("__r")
    return long.select(*by, "feature", r.alias("correlation"), F.abs("__r").alias("abs_correlation"))


def ranked(df: DataFrame, *by: str) -> DataFrame:
    return df.orderBy(*by, F.col("abs_correlation").desc_nulls_last(), "feature")


def corr_table(df: DataFrame, target: str, names: dict[str, str], by=("commodity",), digits: int = 3) -> DataFrame:
    """One wide row of rounded correlations per group: {column name: feature}."""
    return df.groupBy(*by).agg(*[F.round(safe_corr(target, f), digits).alias(n) for n, f in names.items()])


def driver_group(ranks: DataFrame, groups: DataFrame, other: str = "Other") -> DataFrame:
    """Add the driver group of each feature."""
    return ranks.join(groups, "feature", "left").withColumn("driver_group", F.coalesce("driver_group", F.lit(other)))


def driver_summary(ranks: DataFrame, score: str, k: int = 3) -> DataFrame:
    """The k best features of each driver group; a rank table holds one row per feature."""
    w = Window.partitionBy("driver_group").orderBy(F.col(score).desc_nulls_last(), "feature")
    return ranks.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return unpivot_row(one, [], cols, "column_name", "n_null")


def range_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column, as doubles."""
    one = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in cols])
    long = unpivot_row(one, [], cols, "column_name", "__r")
    return long.select("column_name", F.col("__r.lo").alias("min_value"), F.col("__r.hi").alias("max_value"))
