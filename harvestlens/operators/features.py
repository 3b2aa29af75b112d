"""Imputation, model features, baselines, trends and the rule-based yield estimate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from harvestlens.functions import weather as wx
from harvestlens.functions.numeric import ratio_plus_one
from harvestlens.operators.ranks import median_by, percentiles

# Feature sets, agronomic constants and estimate coefficients.
BASE_YEAR = 2010
OPTIMAL_TEMP_C = 22.5
COOL_NIGHT_C = 50
TEMPERATURES = ["avg_temp_max_c", "avg_temp_min_c", "avg_temp_mean_c", "peak_temp_max_c"]
SNOW = ["winter_snowfall_mm", "avg_snow_depth_mm", "max_snow_depth_mm", "snow_days"]
RAIN = ["avg_precip_mm", "precip_std_mm"]
CORE_FEATURES = [
    "avg_temp_max_c", "avg_temp_mean_c", "peak_temp_max_c", "temp_range", "temp_stress_index", "optimal_temp_score",
    "heat_stress_days", "frost_days", "avg_precip_mm", "dry_days", "heavy_rain_days", "precip_cv",
    "winter_snowfall_mm", "snow_days", "drought_flag", "extreme_heat_flag", "flood_flag", "extreme_events",
    "heat_dry_combo", "gdd", "gdd_precip", "gdd_per_precip", "year_trend", "year_x_precip", "year_x_heat",
    "is_irrigated",
]
BASELINE_FEATURES = ["state_baseline", "county_baseline"]
WEATHER_FEATURES = [
    "avg_precip_mm", "dry_days", "heavy_rain_days", "precip_std_mm", "avg_temp_max_c", "avg_temp_min_c",
    "avg_temp_mean_c", "peak_temp_max_c", "heat_stress_days", "gdd", "frost_days", "winter_snowfall_mm",
    "drought_flag", "flood_flag", "extreme_heat_flag",
]
STRESS_PAIRS = [
    ("heat_stress_days", "dry_days"), ("avg_precip_mm", "drought_flag"), ("dry_days", "drought_flag"),
    ("heat_stress_days", "extreme_heat_flag"), ("heavy_rain_days", "flood_flag"), ("peak_temp_max_c", "dry_days"),
]


@dataclass(frozen=True)
class EstimateWeights:
    """Weights of the rule-based estimate of one crop."""

    heat: float
    drought: float
    flood: float
    gdd_optimum: float
    gdd: float
    irrigation: float


# Weights of the rule-based estimate.
ESTIMATE = {
    "corn": EstimateWeights(heat=1.9, drought=0.05, flood=1.4, gdd_optimum=2400.0, gdd=0.008, irrigation=8.0),
    "soybeans": EstimateWeights(heat=0.65, drought=0.016, flood=0.55, gdd_optimum=2100.0, gdd=0.0032, irrigation=1.8),
}
HEAT_FREE_DAYS, ENOUGH_RAIN_MM, RAIN_FREE_DAYS, TREND_SHARE = 6.0, 220.0, 5.0, 0.35
# Line of each crop for states without a trend of their own, years counted from FIXED_ORIGIN.
GLOBAL_TREND = {"corn": (130.0, 2.2), "soybeans": (36.0, 0.55)}
FIXED_ORIGIN = 2010


def impute(
    df: DataFrame, group=("commodity", "state_abbr"), group_cols=TEMPERATURES, overall_cols=RAIN, zero_cols=SNOW
) -> DataFrame:
    """Fill gaps: group medians, overall medians, or zero."""
    medians = median_by(df, group, group_cols, "__gm")
    keys = {k: f"__k{i}" for i, k in enumerate(group)}
    side = medians.select(*[F.col(k).alias(a) for k, a in keys.items()], *[f"{c}__gm" for c in group_cols])
    same = [df[k].eqNullSafe(side[a]) for k, a in keys.items()]
    joined = df.join(side, same, "left").drop(*keys.values())
    fills: dict[str, Column] = {c: F.coalesce(c, f"{c}__gm") for c in group_cols}
    overall = median_by(df, [], overall_cols)
    joined = joined.withColumn("__om", overall.select(F.struct(*overall_cols).alias("s")).scalar())
    fills |= {c: F.coalesce(F.col(c), F.col("__om")[c]) for c in overall_cols}
    fills |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero_cols}
    return joined.withColumns(fills).drop("__om", *[f"{c}__gm" for c in group_cols])


def extreme_events(include_flood: bool) -> Column:
    """How many season flags are raised; training and scoring must choose the same way."""
    total = F.col("drought_flag") + F.col("extreme_heat_flag")
    return total + F.col("flood_flag") if include_flood else total


def _shared_features(include_flood: bool) -> dict[str, Column]:
    heat, rain, gdd = F.col("heat_stress_days"), F.col("avg_precip_mm"), F.col("gdd")
    trend = F.col("year") - BASE_YEAR
    return {
        "temp_range": F.col("avg_temp_max_c") - F.col("avg_temp_min_c"),
        "temp_stress_index": F.col("peak_temp_max_c") * heat,
        "optimal_temp_score": -F.abs(F.col("avg_temp_mean_c") - OPTIMAL_TEMP_C),
        "precip_cv": ratio_plus_one("precip_std_mm", rain),
        "heat_dry_combo": heat * F.col("dry_days"),
        "extreme_events": extreme_events(include_flood),
        "gdd_precip": gdd * rain,
        "gdd_per_precip": ratio_plus_one(gdd, rain),
        "year_trend": trend,
        "year_x_precip": trend * rain,
        "year_x_heat": trend * heat,
    }


def _irrigated() -> Column:
    return F.when(F.trim("irrigation") == "Irrigated", 1).otherwise(0)


def features_core(df: DataFrame, include_flood: bool = True) -> DataFrame:
    """The compact feature set used by the regional models."""
    return df.withColumns({"is_irrigated": _irrigated(), **_shared_features(include_flood)})


def _interaction_features() -> dict[str, Column]:
    heat, rain, gdd, peak = F.col("heat_stress_days"), F.col("avg_precip_mm"), F.col("gdd"), F.col("peak_temp_max_c")
    events = extreme_events(False)
    return {
        "peak_vs_mean_temp": peak - F.col("avg_temp_mean_c"),
        "peak_temp_sq": F.pow(peak, F.lit(2.0)),
        "log_heat_days": F.log1p(heat),
        "temprange_x_heat": (F.col("avg_temp_max_c") - F.col("avg_temp_min_c")) * heat,
        "peak_x_heat": peak * heat,
        "extreme_x_precip": F.col("extreme_heat_flag") * rain,
        "gdd_x_heat": gdd * heat,
        "gdd_x_precip": gdd * rain,
        "precip_x_snow": rain * F.col("snow_days"),
        "extreme_x_dry": events * F.col("dry_days"),
        "gdd_x_extreme": gdd * events,
        "stress_gdd_ratio": ratio_plus_one(heat * peak, gdd),
        "cool_moist": (F.lit(COOL_NIGHT_C) - F.col("avg_temp_min_c")) * rain,
        "gdd_precip_heat": ratio_plus_one(gdd * rain, heat),
        "year_x_extreme": (F.col("year") - BASE_YEAR) * events,
    }


def features_mid(df: DataFrame) -> DataFrame:
    """Compact set plus weather interactions, with irrigation and without crop interactions."""
    return df.withColumns({"is_irrigated": _irrigated(), **_shared_features(False), **_interaction_features()})


def features_wide(df: DataFrame, crop: str = "Corn") -> DataFrame:
    """Pooled-crop set: weather interactions plus the crop indicator and its interactions."""
    is_crop = F.when(F.trim("commodity") == crop, 1).otherwise(0)
    name = crop.lower()
    crossed = {"gdd": "gdd", "precip": "avg_precip_mm", "heat": "heat_stress_days", "drought": "drought_flag"}
    return df.withColumns({
        f"is_{name}": is_crop,
        **_shared_features(False),
        **_interaction_features(),
        **{f"{name}_x_{short}": is_crop * F.col(c) for short, c in crossed.items()},
        f"{name}_x_extreme": is_crop * extreme_events(False),
    })


def available_features(df: DataFrame, features: Sequence[str] = WEATHER_FEATURES, min_count: int = 100) -> list[str]:
    """Columns that exist and hold enough readable numbers; one aggregate over the table."""
    present = [c for c in features if c in df.columns]
    if not present:
        return []
    counts = df.agg(*[F.count(F.col(c).try_cast("double")).alias(c) for c in present]).first()
    return [c for c in present if counts[c] >= min_count]


def interactions(df: DataFrame, pairs=STRESS_PAIRS) -> DataFrame:
    """Pairwise products; a pair is skipped when a column is absent. How many numbers a column holds is told by `null_counts`."""
    made = {
        f"{a}_x_{b}": F.col(a).try_cast("double") * F.col(b).try_cast("double")
        for a, b in pairs if a in df.columns and b in df.columns
    }
    return df.withColumns(made) if made else df


def season_ratios(df: DataFrame, rain="total_precip_mm", observed="obs_count") -> DataFrame:
    """Diurnal range, rain per observed day, share of dry days and mean temperature in °F."""
    return df.withColumns({
        "diurnal_range_c": F.col("avg_temp_max_c") - F.col("avg_temp_min_c"),
        "precip_per_day_mm": F.try_divide(F.col(rain), F.col(observed)),
        "pct_dry_days": F.try_divide(F.col("dry_days"), F.col(observed)) * 100,
        "avg_temp_mean_f": wx.c_to_f("avg_temp_mean_c"),
    })


def line_fit(y: str, x: str) -> dict[str, Column]:
    """Least-squares intercept and slope aggregates; a single x value gives NULL instead of an error."""
    y, x = F.col(y).cast("double"), F.col(x).cast("double")
    both = y.isNotNull() & x.isNotNull()
    yy, xx = F.when(both, y), F.when(both, x)
    slope = F.try_divide(F.covar_pop(xx, yy), F.var_pop(xx))
    return {"intercept": F.avg(yy) - slope * F.avg(xx), "slope": slope}


def state_trend(df: DataFrame, by=("commodity", "state_abbr"), min_years: int = 3) -> DataFrame:
    """Line through yearly mean yields. A state with fewer than `min_years` years keeps its row, with a NULL line, so that the fallback holds."""
    yearly = df.groupBy(*by, "year").agg(F.avg("yield_amount").alias("y")).filter(F.col("y").isNotNull())
    enough = F.count(F.lit(1)) >= min_years
    fit = {n: F.when(enough, e) for n, e in line_fit("y", "year").items()}
    return yearly.groupBy(*by).agg(F.count(F.lit(1)).alias("n_years"), *[e.alias(n) for n, e in fit.items()])


def state_trend_rows(df: DataFrame, by=("commodity", "state_abbr"), min_rows: int = 3) -> DataFrame:
    """Line through the rows themselves; small states get their mean and slope 0."""
    fit = line_fit("yield_amount", "year")
    lines = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("yield_amount").alias("m"), *[e.alias(n) for n, e in fit.items()]
    )
    flat = (F.col("n") < min_rows) | F.col("slope").isNull()
    return lines.select(
        *by,
        F.when(flat, F.col("m")).otherwise(F.col("intercept")).alias("intercept"),
        F.when(flat, F.lit(0.0)).otherwise(F.col("slope")).alias("slope"),
    )


def global_line(df: DataFrame, by=("commodity",)) -> DataFrame:
    return df.groupBy(*by).agg(*[e.alias(n) for n, e in line_fit("yield_amount", "year").items()])


def fixed_lines(spark, names: Mapping[str, str] = {"Corn": "corn", "Soybeans": "soybeans"}) -> DataFrame:
    """The fixed line of each crop, to be used as fallback with years counted from FIXED_ORIGIN."""
    rows = [(label, *GLOBAL_TREND[crop]) for label, crop in names.items()]
    return spark.createDataFrame(rows, "commodity string, intercept double, slope double")


def trend_value(
    df: DataFrame, trend: DataFrame, fallback: DataFrame, by=("commodity", "state_abbr"), fallback_by=("commodity",),
    origin: int = 0, name: str = "trend",
) -> DataFrame:
    """Trend of each row: its state's line, else the fallback line with years counted from `origin`."""
    lines = trend.select(*by, F.col("intercept").alias("__i"), F.col("slope").alias("__s"))
    spare = fallback.select(*fallback_by, F.col("intercept").alias("__gi"), F.col("slope").alias("__gs"))
    joined = df.join(lines, list(by), "left").join(spare, list(fallback_by), "left")
    own = F.col("__i") + F.col("__s") * F.col("year")
    shared = F.col("__gi") + F.col("__gs") * (F.col("year") - origin)
    return joined.withColumn(name, F.coalesce(own, shared)).drop("__i", "__s", "__gi", "__gs").select(*df.columns, name)


def detrend(df: DataFrame, train: DataFrame, by=("commodity", "state_abbr"), fallback_by=("commodity",)) -> DataFrame:
    """Trend learned on the training rows and the yield's departure from it."""
    out = trend_value(df, state_trend_rows(train, by), global_line(train, fallback_by), by, fallback_by)
    return out.withColumn("yield_anomaly", F.col("yield_amount") - F.col("trend"))


def retrend(df: DataFrame, predicted: str = "prediction", name: str = "pred_yield") -> DataFrame:
    return df.withColumn(name, F.col(predicted) + F.col("trend"))


def baselines(df: DataFrame, by=("commodity",)) -> tuple[DataFrame, DataFrame]:
    """(state medians, county medians) of the yield."""
    state = percentiles(df, [*by, "state_abbr"], "yield_amount", {"state_baseline": 0.5})
    county = percentiles(df, [*by, "state_fips", "county_fips"], "yield_amount", {"county_baseline": 0.5})
    return state, county


def with_baselines(
    df: DataFrame, train: DataFrame, target: str = "yield_amount", by: Sequence[str] = (), fallback: float | None = None
) -> DataFrame:
    """Mean training yield of the row's county and state as features.

    A county without training rows takes the state's mean and a state without any takes the overall mean,
    or both take `fallback` when one is given.
    """
    by = list(by)
    state = train.groupBy(*by, "state_abbr").agg(F.avg(target).alias("__s"))
    county = train.groupBy(*by, "state_fips", "county_fips").agg(F.avg(target).alias("__c"))
    out = df.join(state, [*by, "state_abbr"], "left").join(county, [*by, "state_fips", "county_fips"], "left")
    if fallback is not None:
        spare = F.lit(float(fallback))
        return out.withColumns({
            "state_baseline": F.coalesce("__s", spare), "county_baseline": F.coalesce("__c", spare),
        }).drop("__s", "__c").select(*df.columns, *BASELINE_FEATURES)
    if by:
        out = out.join(train.groupBy(*by).agg(F.avg(target).alias("__g")), by, "left")
    else:
        out = out.withColumn("__g", train.agg(F.avg(target).alias("g")).scalar())
    state_value = F.coalesce("__s", "__g")
    return out.withColumns({"state_baseline": state_value, "county_baseline": F.coalesce(F.col("__c"), state_value)}).select(
        *df.columns, *BASELINE_FEATURES
    )


def with_region(df: DataFrame, regions: DataFrame, default: str, state: str = "state_abbr", name: str = "region"):
    """Region of each state from a lookup table; `default` where the table has none."""
    side = regions.select(F.upper(F.trim("state_abbr")).alias("__st"), F.col("region").alias("__r"))
    return (
        df.join(side, F.upper(F.trim(F.col(state))) == F.col("__st"), "left")
        .withColumn(name, F.coalesce(F.col("__r"), F.lit(default)))
        .drop("__st", "__r")
    )


def heuristic_yield(df: DataFrame, crop: str = "commodity", name: str = "predicted_yield") -> DataFrame:
    """Rule-based estimate: baseline moved toward the trend, minus stress penalties, at least 1.

    Needs county_baseline, state_baseline and trend beside the season measures. Rounds half to even.
    """
    is_corn = F.lower(F.trim(F.col(crop))) == "corn"

    def by_crop(weight):
        return F.when(is_corn, F.lit(getattr(ESTIMATE["corn"], weight))).otherwise(F.lit(getattr(ESTIMATE["soybeans"], weight)))

    heat_w, drought_w, flood_w = by_crop("heat"), by_crop("drought"), by_crop("flood")
    optimum, gdd_w, bonus = by_crop("gdd_optimum"), by_crop("gdd"), by_crop("irrigation")

    def over(x):
        return F.greatest(F.lit(0.0), x)

    own = F.when((F.col("county_fips") != 0) & (F.col("county_baseline") > 0), F.col("county_baseline")).otherwise(
        F.col("state_baseline"))
    start = F.when(own > 0, own).otherwise(F.col("trend"))
    penalty = (
        over(F.col("heat_stress_days") - HEAT_FREE_DAYS) * heat_w
        + over(F.lit(ENOUGH_RAIN_MM) - F.col("avg_precip_mm")) * drought_w
        + over(F.col("heavy_rain_days") - RAIN_FREE_DAYS) * flood_w
        + F.abs(F.col("gdd") - optimum) * gdd_w
    )
    irrigated = F.when(F.col("is_irrigated") == 1, bonus).otherwise(F.lit(0.0))
    value = start + (F.col("trend") - start) * F.lit(TREND_SHARE) + irrigated - penalty
    return df.withColumn(name, F.greatest(F.lit(1.0), F.bround(value, 1)))


def residuals(df: DataFrame, actual="yield_amount", pred="pred_yield", stored: str | None = None) -> DataFrame:
    """Signed and absolute residual; a stored signed residual is preferred where present."""
    signed = F.col(actual) - F.col(pred)
    if stored:
        signed = F.coalesce(F.col(stored), signed)
    return df.withColumns({"signed_residual": signed, "abs_residual": F.abs(signed)})


def delta_vs_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), prefix: str = "delta_") -> DataFrame:
    """Difference of each column from its group mean."""
    from harvestlens.operators.grouping import with_group_stats

    means = with_group_stats(df, by, {f"__m_{c}": F.avg(c) for c in cols})
    return means.withColumns({f"{prefix}{c}": F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def direction_words(delta, label: str, reference: str) -> Column:
    """Short text telling on which side of the reference a value lies."""
    d = F.col(delta) if isinstance(delta, str) else delta
    side = F.when(d > 0, F.lit("above")).otherwise(F.lit("below"))
    moved = F.format_string(f"{label} was %s the {reference} by %.2f", side, F.abs(d))
    return (
        F.when(d.isNull(), F.lit(f"{label} was unavailable"))
        .when(d != 0, moved)
        .otherwise(F.lit(f"{label} was close to the {reference}"))
    )


