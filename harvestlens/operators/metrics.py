"""Regression metrics from running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def metric_columns(actual="yield_amount", pred="pred_yield") -> dict[str, Column]:
    """R², MAE, RMSE and row count; R² is NULL below two rows or without variance in the actuals."""
    a, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    known = a.isNotNull() & p.isNotNull()
    a, gap = F.when(known, a), F.when(known, a - p)
    varies = (F.count(a) >= 2) & (F.min(a) < F.max(a))
    return {
        "n": F.count(a),
        "r2": F.when(varies, 1 - F.try_divide(F.avg(gap * gap), F.var_pop(a))),
        "mae": F.avg(F.abs(gap)),
        "rmse": F.sqrt(F.avg(gap * gap)),
    }


def regression_metrics(df: DataFrame, by: Sequence[str] = (), actual="yield_amount", pred="pred_yield") -> DataFrame:
    return df.groupBy(*by).agg(*[e.alias(n) for n, e in metric_columns(actual, pred).items()])


def metrics_by_split(df: DataFrame, by="commodity", split="split", actual="yield_amount", pred="pred_yield"):
    """R² over all, training and test rows per group and overall, in one pass."""
    def part(name, keep):
        cols = metric_columns("__a", pred)
        return cols["r2"] if keep is None else _filtered_r2(actual, pred, F.col(split) == keep)

    rows = df.withColumn("__a", F.col(actual))
    cols = [part("all", None).alias("r2_all"), part("train", "train").alias("r2_train"),
            part("test", "test").alias("r2_test"), metric_columns("__a", pred)["n"].alias("n")]
    return rows.groupingSets([[by], []], by).agg(*cols).withColumn(by, F.coalesce(by, F.lit("Overall")))


def _filtered_r2(actual: str, pred: str, keep: Column) -> Column:
    a, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    known = keep & a.isNotNull() & p.isNotNull()
    a, gap = F.when(known, a), F.when(known, a - p)
    varies = (F.count(a) >= 2) & (F.min(a) < F.max(a))
    return F.when(varies, 1 - F.try_divide(F.avg(gap * gap), F.var_pop(a)))


def grid(spark: SparkSession, **dims: Sequence[str]) -> DataFrame:
    """Every combination of a few fixed labels."""
    out = spark.range(1)
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.select(*dims)


def r2_grid(df: DataFrame, actual="yield_amount", pred="pred_yield", **dims: Sequence[str]) -> DataFrame:
    """R² and row count of every cell of a fixed grid; empty cells keep n = 0."""
    keys = list(dims)
    cells = grid(df.sparkSession, **dims)
    found = regression_metrics(df, keys, actual, pred).select(*keys, "r2", "n")
    return cells.join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def weighted_r2(df: DataFrame, by="commodity", actual="yield_amount", pred="pred_yield") -> DataFrame:
    """Mean of the groups' R² weighted by rows, so that differing scales do not inflate it."""
    per = regression_metrics(df, [by], actual, pred).filter(F.col("r2").isNotNull())
    return per.agg(F.try_divide(F.sum(F.col("r2") * F.col("n")), F.sum("n")).alias("weighted_r2"), F.sum("n").alias("n"))


def residual_by_year(df: DataFrame, residual="signed_residual") -> DataFrame:
    return df.groupBy("year").agg(F.avg(F.abs(residual)).alias("avg_abs_residual"), F.count(residual).alias("n"))


def coalesce_stats(computed: DataFrame, stored: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row of computed values, each replaced by its stored twin where the sidecar table has one; of several stored rows the
    largest by its values in order counts."""
    values = stored.agg(F.max(F.struct(*names.values())).alias("s")).scalar()
    out = computed.withColumn("__s", values)
    return out.select(*[
        F.coalesce(F.col("__s")[names[c]], F.col(c)).alias(c) if c in names else F.col(c) for c in computed.columns
    ])


