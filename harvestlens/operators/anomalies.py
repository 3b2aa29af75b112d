"""z-scores, residual flags and weather extremity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from harvestlens.functions import labels
from harvestlens.functions.numeric import z_value
from harvestlens.operators.grouping import with_group_stats

# Weather columns watched for extremes.
WATCHED = [
    "avg_precip_mm", "heat_stress_days", "drought_flag", "flood_flag", "extreme_heat_flag", "gdd", "frost_days",
    "dry_days", "heavy_rain_days", "avg_temp_mean_c", "peak_temp_max_c",
]
EPSILON = 1e-8


def zscore(
    df: DataFrame, targets: dict[str, str], by: Sequence[str], fallback: float | None = 0.0, std=F.stddev_samp,
    keep_stats: dict[str, tuple[str, str]] | None = None, small: bool = False,
) -> DataFrame:
    """z-scores of several columns over one grouping: {column: z name}.

    Groups with zero or unknown spread score `fallback`. `keep_stats` names kept means and spreads per column; `small` says that a group fits one task.
    """
    stats = {}
    for c in targets:
        stats |= {f"__m_{c}": F.avg(c), f"__s_{c}": std(c)}
    out = with_group_stats(df, by, stats, small=small)
    out = out.withColumns({z: z_value(c, f"__m_{c}", f"__s_{c}", fallback) for c, z in targets.items()})
    for c, (mean, spread) in (keep_stats or {}).items():
        out = out.withColumns({mean: F.col(f"__m_{c}"), spread: F.col(f"__s_{c}")})
    return out.drop(*stats)


def zscore_flag(df: DataFrame, col="yield_amount", by=("state_fips", "county_fips", "commodity"), limit=2.0) -> DataFrame:
    """z-score within a group, NULL without spread, with a high/low flag beyond the limit."""
    out = zscore(df, {col: "yield_zscore"}, by, fallback=None, small=True)
    return out.withColumn("anomaly_flag_zscore", labels.two_sided_label("yield_zscore", float(limit), "high_z", "low_z"))


def residual_z(
    df: DataFrame, actual="yield_amount", pred="pred_yield", by=("commodity",), limit=2.0, signed=False, two_sided=False,
    inclusive=False, std=F.stddev_samp,
) -> DataFrame:
    """Residual, its z-score per group and a 0/1 flag.

    By default the absolute residual, one-sided and strict. Rows without a prediction stay unflagged.
    """
    gap = F.col(pred) - F.col(actual)
    out = df.withColumn("residual", F.col(actual) - F.col(pred) if signed else F.abs(gap))
    out = zscore(out, {"residual": "residual_zscore"}, by, fallback=None, std=std)
    size = F.abs("residual_zscore") if two_sided else F.col("residual_zscore")
    hit = size >= limit if inclusive else size > limit
    return out.withColumn("anomaly_flag", F.when(hit, 1).otherwise(0))


def weather_extremity(df: DataFrame, cols: Sequence[str] = WATCHED, by=("commodity",), limit=2.0) -> DataFrame:
    """Largest absolute z-score among the weather columns, and whether it passes the limit."""
    present = [c for c in cols if c in df.columns]
    stats = {}
    for c in present:
        stats |= {f"__m_{c}": F.avg(c), f"__s_{c}": F.stddev_samp(c)}
    out = with_group_stats(df, by, stats)
    z = {f"wz_{c}": (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + F.lit(EPSILON)) for c in present}
    out = out.withColumns(z).drop(*stats)
    sizes = [F.abs(n) for n in z]
    out = out.withColumn("weather_extremity", F.greatest(*sizes) if len(sizes) > 1 else sizes[0])
    return out.withColumn("weather_anomaly_flag", F.when(F.col("weather_extremity") > limit, 1).otherwise(0))


def with_anomaly_type(df: DataFrame) -> DataFrame:
    return df.withColumn("anomaly_type", labels.anomaly_type("anomaly_flag", "weather_anomaly_flag"))


def oof_flags(df: DataFrame, residual="yield_residual", limit=2.0) -> DataFrame:
    """Overall residual z-score with population spread and strict two-sided labels; no spread gives z = 0."""
    out = with_group_stats(df, [], {"__m": F.avg(residual), "__s": F.stddev_pop(residual)})
    z = F.when(F.col(residual).isNotNull(), z_value(residual, "__m", "__s"))
    out = out.withColumn("yield_residual_z", z).drop("__m", "__s")
    return out.withColumn("anomaly_flag", labels.two_sided_label("yield_residual_z", float(limit)))


def holdout_flags(df: DataFrame, split="split", residual="yield_residual", factor=2.0, test_name="test") -> DataFrame:
    """Labels on held-out rows whose residual passes `factor` training spreads (population)."""
    trains = F.col(split) != test_name
    out = with_group_stats(df, [], {"__m": F.avg(residual), "__s": F.stddev_pop(residual)}, rows=trains)
    limit = F.when(F.col("__s") > 0, F.col("__s") * F.lit(float(factor))).otherwise(F.lit(0.0))
    out = out.withColumn("yield_residual_z", z_value(residual, "__m", "__s", None))
    label = F.when(~trains, labels.two_sided_label(residual, limit)).otherwise(F.lit(""))
    return out.withColumn("anomaly_flag", label).drop("__m", "__s")


def z_outlier_count(df: DataFrame, residual="signed_residual", limit=2.0) -> DataFrame:
    """How many rows lie at least `limit` sample spreads from the mean."""
    out = with_group_stats(df, [], {"__m": F.avg(residual), "__s": F.stddev_samp(residual)})
    z = z_value(residual, "__m", "__s")
    return out.agg(F.count_if(F.abs(z) >= limit).alias("anomaly_count"), F.count(F.lit(1)).alias("n"))


def top_extreme(df: DataFrame, by=("state_abbr", "county_fips", "year"), k: int | None = 15) -> DataFrame:
    """Most extreme flagged group and the crop that reached it."""
    flagged = df.filter(F.col("weather_anomaly_flag") == 1)
    best = F.max(F.struct(F.col("weather_extremity"), F.col("commodity")))
    out = flagged.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.weather_extremity").alias("weather_extremity"), F.col("b.commodity").alias("commodity")
    )
    return out if k is None else out.orderBy(F.col("weather_extremity").desc(), *by).limit(k)
