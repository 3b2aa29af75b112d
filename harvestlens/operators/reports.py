"""Report tables over the merged, scored and prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from harvestlens.functions import labels
from harvestlens.functions.numeric import bin_by, safe_div
from harvestlens.operators.grouping import top_groups, value_counts
from harvestlens.operators.ranks import percentiles

# Report bins.
TEMP_BINS = ([15, 18, 21, 24], ["< 15°C (Cool)", "15-18°C (Moderate)", "18-21°C (Optimal)", "21-24°C (Warm)", "> 24°C (Hot)"])
RAIN_BINS = (
    [300, 500, 700, 900],
    ["< 300mm (Dry)", "300-500mm (Moderate)", "500-700mm (Adequate)", "700-900mm (Wet)", "> 900mm (Very Wet)"],
)
HEAT_BINS = ([0, 5, 15, 30], ["0 days", "1-5 days", "6-15 days", "16-30 days", "> 30 days"])
CORN_BELT = ["IA", "IL", "IN", "NE", "MN"]


def rounded_means(spec: Mapping[str, tuple[str, int]]) -> list[Column]:
    """{name: (column, decimals)} to rounded averages."""
    return [F.round(F.avg(c), d).alias(n) for n, (c, d) in spec.items()]


def mismatch_rows(df: DataFrame) -> DataFrame:
    """Rows whose yield departs from their weather, rounded for reading."""
    shown = {
        "yield": ("yield_amount", 1), "avg_temp_c": ("avg_temp_mean_c", 1), "precip_mm": ("total_precip_mm", 0),
        "heat_days": ("heat_stress_days", 0), "yield_z": ("yield_zscore", 2), "temp_z": ("temp_anomaly_z", 2),
        "precip_z": ("precip_anomaly_z", 2),
    }
    return df.filter(F.col("weather_yield_mismatch") != "CONSISTENT").select(
        "state_abbr", "county_name", "commodity", "year", "yield_category", "weather_yield_mismatch",
        *[F.round(c, d).alias(n) for n, (c, d) in shown.items()],
    )


def mismatch_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("weather_yield_mismatch", "commodity").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct("state_abbr").alias("states"),
        F.count_distinct("county_name").alias("counties"),
        *rounded_means({
            "avg_yield": ("yield_amount", 1), "avg_temp": ("avg_temp_mean_c", 1), "avg_precip": ("total_precip_mm", 0),
            "avg_heat_days": ("heat_stress_days", 1),
        }),
    )


def event_impact(df: DataFrame) -> DataFrame:
    """Yield by season event; the label is computed once and grouped on."""
    event = labels.event_label("drought_flag", "flood_flag", "extreme_heat_flag")
    return df.withColumn("weather_event", event).groupBy("commodity", "weather_event").agg(
        F.count(F.lit(1)).alias("n"),
        *rounded_means({
            "avg_yield": ("yield_amount", 1), "avg_yield_zscore": ("yield_zscore", 2),
            "avg_precip_mm": ("total_precip_mm", 0), "avg_heat_days": ("heat_stress_days", 1), "avg_gdd": ("gdd", 0),
        }),
    )


def event_validation(df: DataFrame, states: Sequence[str], years: Sequence[int], commodity: str, kind: str) -> DataFrame:
    """State-year check of a known drought or flood."""
    picked = df.filter(F.col("state_abbr").isin(list(states)) & F.col("year").isin(list(years))
                       & (F.col("commodity") == commodity))
    base = {"avg_yield": ("yield_amount", 1), "avg_precip": ("total_precip_mm", 0)}
    extra = (
        {"avg_yield_z": ("yield_zscore", 2), "avg_temp": ("avg_temp_mean_c", 1), "heat_days": ("heat_stress_days", 1)}
        if kind == "drought" else {"heavy_rain_days": ("heavy_rain_days", 1)}
    )
    return picked.groupBy("state_abbr", "year", "commodity").agg(
        F.count(F.lit(1)).alias("counties"), *rounded_means(base | extra),
        F.sum(f"{kind}_flag").alias(f"{kind}_counties"),
    )


def binned_response(
    df: DataFrame, col: str, bins: tuple[Sequence[float], Sequence[str]], name: str, closed: str = "left",
    means: Mapping[str, tuple[str, int]] | None = None, spread: bool = True, versus: bool = False,
) -> DataFrame:
    """Yield per bin of a weather column, optionally with its distance from the overall mean."""
    out = df.withColumn(name, bin_by(col, *bins, closed=closed)).groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("yield_amount"), 1).alias("avg_yield"),
        *([F.round(F.stddev_samp("yield_amount"), 1).alias("yield_std")] if spread else []),
        F.avg("yield_amount").alias("__mean"),
        *rounded_means(means or {}),
    )
    if versus:
        overall = df.agg(F.avg("yield_amount").alias("m")).scalar()
        out = out.withColumn("yield_vs_avg", F.round(F.col("__mean") - overall, 1))
    return out.drop("__mean")


def vs_overall(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Group mean beside the overall mean."""
    overall = df.agg(F.avg(col).alias("m")).scalar()
    means = df.groupBy(*by).agg(F.avg(col).alias("group_mean")).withColumn("overall_mean", overall)
    return means.withColumn("difference", F.col("group_mean") - F.col("overall_mean"))


def state_year_heatmap(df: DataFrame) -> DataFrame:
    return df.groupBy("state_abbr", "year", "commodity").agg(
        F.count_distinct("county_name").alias("counties"),
        *rounded_means({
            "avg_yield": ("yield_amount", 1), "avg_yield_z": ("yield_zscore", 2), "avg_temp_c": ("avg_temp_mean_c", 1),
            "avg_precip_mm": ("total_precip_mm", 0), "heat_stress_days": ("heat_stress_days", 1), "gdd": ("gdd", 0),
        }),
        F.sum("drought_flag").alias("drought_counties"),
        F.sum("flood_flag").alias("flood_counties"),
    )


def event_pivot(df: DataFrame, states: Sequence[str], spec: Mapping[str, tuple[str, str, int]], by="year") -> DataFrame:
    """Conditional means side by side: {name: (commodity, column, decimals)} within the states."""
    here = F.col("state_abbr").isin(list(states))
    return df.groupBy(by).agg(*[
        F.round(F.avg(F.when(here & (F.col("commodity") == crop), F.col(c))), d).alias(n)
        for n, (crop, c, d) in spec.items()
    ])


EVENT_PIVOT = {
    "midwest_corn_yield": ("Corn", "yield_amount", 1), "midwest_corn_z": ("Corn", "yield_zscore", 2),
    "midwest_heat_days": ("Corn", "heat_stress_days", 1), "midwest_precip_mm": ("Corn", "total_precip_mm", 0),
    "midwest_soy_yield": ("Soybeans", "yield_amount", 1), "midwest_soy_z": ("Soybeans", "yield_zscore", 2),
}


def distribution(df: DataFrame, col: str, by: Sequence[str] = (), digits: int | None = 2) -> DataFrame:
    """Count, mean, median, quartiles, range and population spread."""
    stats = df.filter(F.col(col).isNotNull()).groupBy(*by).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"),
        F.stddev_pop(col).alias("std"),
    )
    marks = percentiles(df, by, col, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    if by:
        out = stats.join(marks, list(by), "left")
    else:
        both = marks.select(F.struct("median", "p25", "p75").alias("q")).scalar()
        out = stats.withColumn("__q", both).select("*", "__q.median", "__q.p25", "__q.p75").drop("__q")
    shown = ["mean", "median", "min", "max", "std", "p25", "p75"]
    return out.select(*by, "count", *[(F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in shown])


def by_county(df: DataFrame, col: str = "pred_yield") -> DataFrame:
    """Count, mean and range per county."""
    known = df.filter(F.col(col).isNotNull() & (F.trim("county_name") != ""))
    return known.groupBy(F.col("state_abbr").alias("state"), F.trim("county_name").alias("county")).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(col), 2).alias("avg_pred_yield"),
        F.round(F.min(col), 2).alias("min_pred_yield"),
        F.round(F.max(col), 2).alias("max_pred_yield"),
    )


WEATHER_CONTEXT = {
    "avg_precip_mm": "avg_precip_mm", "heat_stress_days": "heat_stress_days", "gdd": "gdd",
    "drought_rate": "drought_flag", "flood_rate": "flood_flag", "extreme_heat_rate": "extreme_heat_flag",
}


def weather_context(df: DataFrame, spec: Mapping[str, str] = WEATHER_CONTEXT) -> DataFrame:
    """Mean weather and flag rates of the matching rows."""
    return df.agg(*[F.round(F.avg(c), 2).alias(n) for n, c in spec.items()])


def _is_flagged(c: str) -> Column:
    return F.col(c) == 1


def hero_kpis(df: DataFrame) -> DataFrame:
    """Headline counts and rates in one pass."""
    counties = F.count_distinct(F.when(F.col("state_abbr").isNotNull(), F.struct("state_abbr", "county_fips")))
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.count_distinct("state_abbr").alias("n_states"),
        counties.alias("n_counties"),
        F.count_distinct("commodity").alias("n_commodities"),
        F.count_if(_is_flagged("anomaly_flag")).alias("anomaly_count"),
        F.count_if(_is_flagged("weather_anomaly_flag")).alias("weather_anomaly_count"),
    ).withColumn("anomaly_rate", safe_div("anomaly_count", "total_records"))


def year_means(df: DataFrame, col: str = "signed_residual") -> DataFrame:
    return df.filter(F.col(col).isNotNull() & F.col("year").isNotNull()).groupBy("year").agg(
        F.avg(col).alias("mean_residual"), F.count(F.lit(1)).alias("n")
    )


def year_extremes(df: DataFrame, col: str = "signed_residual") -> DataFrame:
    """Worst and best year by mean residual; ties go to the earlier year."""
    years = year_means(df, col)
    low = F.min(F.struct("mean_residual", "year", "n"))
    high = F.max(F.struct(F.col("mean_residual"), (-F.col("year")).alias("minus_year")))
    return years.agg(low.alias("lo"), high.alias("hi")).select(
        F.col("lo.year").alias("worst_year"), F.col("lo.mean_residual").alias("worst_mean"),
        F.col("lo.n").alias("worst_n"),
        (-F.col("hi.minus_year")).alias("best_year"), F.col("hi.mean_residual").alias("best_mean"),
    )


def anomaly_by_state(df: DataFrame, k: int | None = 12) -> DataFrame:
    """Flagged rows per state, most first."""
    flagged = df.filter(_is_flagged("anomaly_flag") & F.col("state_abbr").isNotNull())
    if k is None:
        return value_counts(flagged, "state_abbr", name="anomalies")
    return top_groups(flagged, "state_abbr", k, "anomalies")


def anomaly_trend(df: DataFrame) -> DataFrame:
    """Rows, flagged rows and their share per year."""
    return df.filter(F.col("year").isNotNull()).groupBy("year").agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("anomaly_flag"), F.lit(0)).alias("anomalies")
    ).withColumn("anomaly_pct", F.round(F.col("anomalies") * F.lit(100.0) / F.col("total"), 2))


def _map_measures(flagged: Column, residual: str) -> list[Column]:
    return [
        F.count("yield_amount").alias("n_rows"), F.count_if(flagged).alias("n_anomalies"),
        F.avg("yield_amount").alias("avg_yield"), F.avg(residual).alias("avg_residual"),
    ]


def map_agg(df: DataFrame, by: Sequence[str], flagged: Column | None = None, residual="yield_residual") -> DataFrame:
    """Rows, anomalies, mean yield and mean residual per map unit."""
    flagged = F.col("anomaly_flag") != "" if flagged is None else flagged
    return df.groupBy(*by).agg(*_map_measures(flagged, residual))


def anomaly_rates(df: DataFrame, by: Sequence[str] = ("state_fips", "county_fips")) -> DataFrame:
    """Share of flagged years per unit among rows with a prediction."""
    return df.filter(F.col("pred_yield").isNotNull()).groupBy(*by).agg(
        F.avg("anomaly_flag").alias("anomaly_rate"), F.avg("weather_anomaly_flag").alias("weather_anomaly_rate"),
        F.avg("residual_zscore").alias("avg_residual_zscore"),
    )


def regional_summary(df: DataFrame, residual: str = "yield_residual") -> DataFrame:
    """Mean and median residual, share above zero, and high/low counts per region."""
    known = df.filter(F.col(residual).isNotNull())
    stats = known.groupBy("region").agg(
        F.count("yield_amount").alias("n_rows"),
        F.avg(residual).alias("mean_residual"),
        F.avg((F.col(residual) > 0).cast("int")).alias("positive_residual_rate"),
        F.count_if(F.col("anomaly_flag") == labels.HIGH_YIELD).alias("high_anomaly_count"),
        F.count_if(F.col("anomaly_flag") == labels.LOW_YIELD).alias("low_anomaly_count"),
    )
    return stats.join(percentiles(known, ["region"], residual, {"median_residual": 0.5}), "region", "left")


def region_insights(county_agg: DataFrame, min_units: int = 1, near: float = 1.0) -> DataFrame:
    """Regions by mean county residual, with a word for its side; regions of fewer than `min_units` counties are left out."""
    g = county_agg.filter(F.col("avg_residual").isNotNull() & F.col("state_abbr").isNotNull()).groupBy("region").agg(
        F.avg("avg_residual").alias("mean_residual"), F.count(F.lit(1)).alias("n_counties")
    )
    side = F.when(F.col("mean_residual") > near, F.lit("underestimation")).when(
        F.col("mean_residual") < -near, F.lit("negative")).otherwise(F.lit("mixed"))
    return g.filter(F.col("n_counties") >= min_units).withColumn("reading", side)


def case_by_crop(df: DataFrame, year: int, residual="yield_residual") -> DataFrame:
    return df.filter(F.col("year") == year).groupBy("commodity").agg(
        F.count("yield_amount").alias("n"), F.avg("yield_amount").alias("mean_yield"),
        F.avg(residual).alias("mean_residual"),
        F.count_if(F.col("anomaly_flag") == labels.HIGH_YIELD).alias("n_high"),
        F.count_if(F.col("anomaly_flag") == labels.LOW_YIELD).alias("n_low"),
    )


def case_by_state(df: DataFrame, year: int, residual="yield_residual") -> DataFrame:
    return df.filter(F.col("year") == year).groupBy("state_abbr").agg(
        F.count("yield_amount").alias("n"), F.avg("yield_amount").alias("mean_yield"),
        F.avg(residual).alias("mean_residual"), F.avg("heat_stress_days").alias("mean_heat_days"),
        F.avg("dry_days").alias("mean_dry_days"),
    )


def stress_rates(df: DataFrame, year: int, flags=("drought_flag", "flood_flag", "extreme_heat_flag")) -> DataFrame:
    """Share of rows under each stress in one year; missing flags count as 0."""
    one = df.filter(F.col("year") == year).agg(*[F.avg(F.coalesce(F.col(f), F.lit(0)).cast("double")).alias(f) for f in flags])
    return one.unpivot([], list(flags), "indicator", "value")


def extreme_years(df: DataFrame, years: Sequence[int], min_rows: int = 1) -> DataFrame:
    """Yield and stress shares of given years; years of fewer than `min_rows` rows are left out."""
    def share(flag):
        return F.round(100 * F.avg(F.coalesce(F.col(flag), F.lit(0))), 1)

    return df.filter(F.col("year").isin(list(years))).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_counties"), F.round(F.avg("yield_amount"), 2).alias("avg_yield"),
        share("drought_flag").alias("drought_pct"), share("flood_flag").alias("flood_pct"),
        share("extreme_heat_flag").alias("extreme_heat_pct"),
    ).filter(F.col("n_counties") >= min_rows)


def residual_diag(df: DataFrame, cols: Sequence[str] = ("yield_residual", "yield_residual_z")) -> DataFrame:
    """Mean, sample spread, range and share above zero of residual columns, one row each."""
    one = df.agg(*[
        F.struct(
            F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
            F.max(c).alias("max"), F.avg((F.col(c) > 0).cast("int")).alias("share_positive"),
        ).alias(c) for c in cols
    ])
    return one.unpivot([], list(cols), "variable", "s").select("variable", "s.*")


def flag_rates(df: DataFrame, by: Sequence[str], flag: str = "anomaly_flag") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(flag).alias("sum"), F.avg(flag).alias("mean"), F.count(flag).alias("count"))


SUMMARY_SETS = {
    "overall": [], "commodity": ["commodity"], "region": ["commodity", "region"], "state": ["commodity", "state_abbr"],
}


def summary_levels(df: DataFrame, sets: Mapping[str, Sequence[str]] = SUMMARY_SETS, value: str = "pred_yield") -> DataFrame:
    """Prediction summary at several levels in one table, each row marked with its level and key.

    Rows are expanded once per level; statistics and percentiles then share the expanded grouping.
    """
    dims = sorted({c for cols in sets.values() for c in cols})
    levels = F.array(*[
        F.struct(F.lit(level).alias("group_type"), *[
            (F.col(d) if d in cols else F.lit(None).cast("string")).alias(d) for d in dims
        ]) for level, cols in sets.items()
    ])
    measured = [value, "avg_precip_mm", "heat_stress_days", "gdd"]
    rows = df.select(
        F.explode(levels).alias("__l"), F.struct("state_abbr", "county_fips").alias("__county"),
        *[F.col(c).alias(f"__{c}") for c in measured], "year", "noaa_window_start", "noaa_window_end",
    ).select("__l.*", "__county", *[f"__{c}" for c in measured], "year", "noaa_window_start", "noaa_window_end")
    by = ["group_type", *dims]
    v = f"__{value}"
    stats = rows.groupBy(*by).agg(
        F.count_distinct("__county").alias("n_counties"), F.count(F.lit(1)).alias("n_rows"),
        F.avg(v).alias("pred_mean"), F.stddev_samp(v).alias("pred_std"), F.min(v).alias("pred_min"),
        F.max(v).alias("pred_max"), F.avg("__avg_precip_mm").alias("avg_precip_mm_mean"),
        F.avg("__heat_stress_days").alias("heat_stress_days_mean"), F.avg("__gdd").alias("gdd_mean"),
        F.max("year").alias("year"), F.min("noaa_window_start").alias("noaa_window_start"),
        F.max("noaa_window_end").alias("noaa_window_end"),
    )
    marks = percentiles(rows, by, v, {"pred_median": 0.5, "pred_p25": 0.25, "pred_p75": 0.75})
    side = marks.select(*[F.col(b).alias(f"__b_{b}") for b in by], "pred_median", "pred_p25", "pred_p75")
    same = stats["group_type"] == side["__b_group_type"]
    for d in dims:
        same = same & stats[d].eqNullSafe(side[f"__b_{d}"])
    out = stats.join(side, same, "left").drop(*[f"__b_{b}" for b in by])
    return out.withColumn("group_key", F.concat_ws("|", "group_type", *dims))
