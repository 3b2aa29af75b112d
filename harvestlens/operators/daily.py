"""Daily features and the station, state and climatology aggregates built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window

from harvestlens.functions import weather as wx
from harvestlens.functions.numeric import z_value
from harvestlens.functions.labels import weather_event_type
from harvestlens.operators.seasons import DAILY, DailyColumns

SEASON = (4, 10)


def year_filter(df: DataFrame, first: int, last: int, date: str = "date") -> DataFrame:
    """Whole years as a date range, so that row groups can be skipped."""
    return df.filter((F.col(date) >= F.lit(f"{first}-01-01").cast("date"))
                     & (F.col(date) < F.lit(f"{last + 1}-01-01").cast("date")))


def prefix_filter(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.filter(F.col(col).startswith(prefix))


def bbox_filter(df: DataFrame, lat: str, lon: str, box: Sequence[float]) -> DataFrame:
    return df.filter(wx.in_box(lat, lon, box))


def in_scope(df: DataFrame, years: tuple[int, int], prefix="US", box=wx.CORN_BELT_BOX, c: DailyColumns = DAILY):
    """Stations of one country inside a box, over whole years."""
    return bbox_filter(prefix_filter(year_filter(df, *years, c.date), c.station, prefix), c.lat, c.lon, box)


def date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"year": F.year(date), "month": F.month(date), "day_of_year": F.dayofyear(date)})


def daily_temps(df: DataFrame, c: DailyColumns = DAILY) -> DataFrame:
    """Quality-masked °C and °F temperatures with the daily mean and range."""
    masked = df.withColumns({
        "temp_max_c": wx.from_tenths(wx.quality_mask(c.tmax, c.tmax_attrs)),
        "temp_min_c": wx.from_tenths(wx.quality_mask(c.tmin, c.tmin_attrs)),
        "temp_range_c": wx.from_tenths(
            wx.quality_mask(c.tmax, c.tmax_attrs) - wx.quality_mask(c.tmin, c.tmin_attrs)),
    })
    mean = masked.withColumn("temp_avg_c", (F.col("temp_max_c") + F.col("temp_min_c")) / 2)
    return mean.withColumns({f"temp_{k}_f": wx.c_to_f(f"temp_{k}_c") for k in ("max", "min", "avg")})


def daily_units(df: DataFrame, c: DailyColumns = DAILY, snow_scale: int = 1) -> DataFrame:
    """Precipitation and snow with sentinels nulled."""
    return df.withColumns({
        "precip_mm": wx.from_tenths(wx.drop_negative(c.rain)),
        "snowfall_mm": wx.from_tenths(wx.drop_negative(c.snow), snow_scale),
        "snow_depth_mm": wx.from_tenths(wx.drop_negative(c.depth), snow_scale),
    })


def daily_features(
    df: DataFrame, c: DailyColumns = DAILY, season=SEASON, respect_quality=False, frost_inclusive=True, snow_scale=1
) -> DataFrame:
    """All per-day columns: units, temperatures, calendar, crop stages, heat units and stress flags.

    Stress flags read the raw temperatures unless `respect_quality` is set.
    """
    out = date_parts(daily_temps(daily_units(df, c, snow_scale), c), c.date)
    high, low = ("temp_max_c", "temp_min_c") if respect_quality else (wx.from_tenths(c.tmax), wx.from_tenths(c.tmin))
    return out.withColumns({
        "is_growing_season": wx.flag(wx.in_season("month", *season)),
        "corn_growth_phase": wx.growth_phase("month", "corn"),
        "soy_growth_phase": wx.growth_phase("month", "soy"),
        "gdd_corn": wx.gdd_f("temp_max_f", "temp_min_f"),
        "gdd_soy": wx.gdd_f("temp_max_f", "temp_min_f", cap=None),
        **wx.day_flags(high, low, "precip_mm", frost_inclusive),
    })


def with_state(df: DataFrame, c: DailyColumns = DAILY, boxes=wx.STATE_BOXES, other="OTHER", keep_other=False):
    """State of each row by its position; rows outside all boxes are dropped unless kept as `other`."""
    rows = df if keep_other else df.filter(wx.in_any_box(c.lat, c.lon, boxes))
    return rows.withColumn("state_abbr", wx.state_by_box(c.lat, c.lon, boxes, other))


MONTH_KEYS = ["station", "state_abbr", "latitude", "longitude", "year", "month", "corn_growth_phase", "soy_growth_phase"]


def monthly_station(df: DataFrame, boxes=wx.STATE_BOXES, parts: bool = False) -> DataFrame:
    """Monthly measures per station. State and crop stages follow from position and month, so they are added
    to the few result rows instead of being grouped on. With `parts` also counts and squared departures, which merge into a climatology."""
    rain = F.col("precip_mm")
    extra = [
        F.count("temp_avg_c").alias("n_temp"), F.var_pop("temp_avg_c").alias("var_temp"), F.count(rain).alias("n_rain"),
        F.var_pop(rain).alias("var_rain"), F.count("gdd_corn").alias("n_gdd"),
    ] if parts else []
    months = df.groupBy("station", "latitude", "longitude", "year", "month").agg(
        F.avg("temp_avg_c").alias("avg_temp_c"),
        F.avg("temp_avg_f").alias("avg_temp_f"),
        F.max("temp_max_c").alias("max_temp_c"),
        F.min("temp_min_c").alias("min_temp_c"),
        F.avg("temp_range_c").alias("avg_diurnal_range_c"),
        F.stddev_samp("temp_avg_c").alias("temp_variability"),
        F.sum(rain).alias("total_precip_mm"),
        F.avg(rain).alias("avg_daily_precip_mm"),
        F.max(rain).alias("max_daily_precip_mm"),
        F.count_if(rain > 0).alias("rainy_days"),
        F.count_if(rain.isNull() | (rain == 0)).alias("dry_days"),
        *[F.sum(f"gdd_{crop}").alias(f"total_gdd_{crop}") for crop in ("corn", "soy")],
        *[F.sum(f"{f}_flag").alias(f"{f}_days") for f in ("heat_stress", "frost", "heavy_rain")],
        F.sum("dry_day_flag").alias("consecutive_dry_days_approx"),
        F.count(F.lit(1)).alias("total_obs_days"),
        *extra,
    )
    return months.withColumns({
        "state_abbr": wx.state_by_box("latitude", "longitude", boxes),
        "corn_growth_phase": wx.growth_phase("month", "corn"),
        "soy_growth_phase": wx.growth_phase("month", "soy"),
    })


# period prefix -> months (None: the growing season flag); then measures as (suffix, aggregate, column)
PERIODS = {
    "gs": (None, [
        ("avg_temp_c", "avg", "temp_avg_c"), ("avg_temp_f", "avg", "temp_avg_f"), ("max_temp_c", "max", "temp_max_c"),
        ("min_temp_c", "min", "temp_min_c"), ("total_precip_mm", "sum", "precip_mm"),
        ("avg_daily_precip_mm", "avg", "precip_mm"), ("total_gdd_corn", "sum", "gdd_corn"),
        ("total_gdd_soy", "sum", "gdd_soy"), ("heat_stress_days", "sum", "heat_stress_flag"),
        ("frost_days", "sum", "frost_flag"), ("heavy_rain_days", "sum", "heavy_rain_flag"),
    ]),
    "critical_corn": ([7, 8], [
        ("avg_temp_c", "avg", "temp_avg_c"), ("total_precip_mm", "sum", "precip_mm"),
        ("heat_days", "sum", "heat_stress_flag"), ("gdd", "sum", "gdd_corn"),
    ]),
    "critical_soy": ([7, 8], [
        ("avg_temp_c", "avg", "temp_avg_c"), ("total_precip_mm", "sum", "precip_mm"),
        ("heat_days", "sum", "heat_stress_flag"),
    ]),
    "planting": ([4, 5], [
        ("avg_temp_c", "avg", "temp_avg_c"), ("total_precip_mm", "sum", "precip_mm"),
        ("frost_days", "sum", "frost_flag"),
    ]),
    "harvest": ([9, 10], [("avg_temp_c", "avg", "temp_avg_c"), ("total_precip_mm", "sum", "precip_mm")]),
}
YEAR_KEYS = ["station", "state_abbr", "latitude", "longitude", "year"]


def annual_station(df: DataFrame, periods=PERIODS, boxes=wx.STATE_BOXES) -> DataFrame:
    """Yearly measures per station with one conditional aggregate per period and measure, in one scan.

    The state follows from the position and is added to the result rows. Days outside a period add 0 to its sums, so a station without such days sums to 0 instead of NULL.
    """
    measures = []
    for prefix, (months, items) in periods.items():
        inside = F.col("is_growing_season") == 1 if months is None else wx.in_months("month", months)
        for suffix, how, col in items:
            value = F.when(inside, F.col(col))
            if how == "sum":
                value = F.when(~inside, F.lit(0)).otherwise(F.col(col))
            measures.append(getattr(F, how)(value).alias(f"{prefix}_{suffix}"))
    return df.groupBy("station", "latitude", "longitude", "year").agg(
        *measures,
        F.sum("precip_mm").alias("annual_total_precip_mm"),
        F.avg("temp_avg_c").alias("annual_avg_temp_c"),
        F.sum("gdd_corn").alias("annual_total_gdd_corn"),
        F.count(F.lit(1)).alias("total_obs_days"),
        F.count("temp_avg_c").alias("days_with_temp"),
        F.count("precip_mm").alias("days_with_precip"),
    ).withColumn("state_abbr", wx.state_by_box("latitude", "longitude", boxes))


# state measure -> (aggregate, station measure, final name, decimals)
STATE_MEASURES = {
    "state_gs_avg_temp_c": ("avg", "gs_avg_temp_c", "gs_avg_temp_c", 2),
    "state_gs_avg_temp_f": ("avg", "gs_avg_temp_f", "gs_avg_temp_f", 2),
    "state_gs_max_temp_c": ("avg", "gs_max_temp_c", "gs_max_temp_c", 2),
    "state_gs_min_temp_c": ("avg", "gs_min_temp_c", "gs_min_temp_c", 2),
    "state_gs_avg_precip_mm": ("avg", "gs_total_precip_mm", "gs_total_precip_mm", 1),
    "state_gs_precip_stddev": ("stddev_samp", "gs_total_precip_mm", "gs_precip_spatial_variability", 1),
    "state_gs_avg_gdd_corn": ("avg", "gs_total_gdd_corn", "gs_gdd_corn", 0),
    "state_gs_avg_gdd_soy": ("avg", "gs_total_gdd_soy", "gs_gdd_soy", 0),
    "state_avg_heat_stress_days": ("avg", "gs_heat_stress_days", "avg_heat_stress_days", 1),
    "state_max_heat_stress_days": ("max", "gs_heat_stress_days", "max_heat_stress_days", 0),
    "state_avg_frost_days": ("avg", "gs_frost_days", "avg_gs_frost_days", 1),
    "state_avg_heavy_rain_days": ("avg", "gs_heavy_rain_days", "avg_heavy_rain_days", 1),
    "state_critical_corn_temp_c": ("avg", "critical_corn_avg_temp_c", "jul_aug_avg_temp_c", 2),
    "state_critical_corn_precip_mm": ("avg", "critical_corn_total_precip_mm", "jul_aug_total_precip_mm", 1),
    "state_critical_corn_heat_days": ("avg", "critical_corn_heat_days", "jul_aug_heat_stress_days", 1),
    "state_critical_corn_gdd": ("avg", "critical_corn_gdd", "jul_aug_gdd_corn", 0),
    "state_critical_soy_temp_c": ("avg", "critical_soy_avg_temp_c", None, 2),
    "state_critical_soy_precip_mm": ("avg", "critical_soy_total_precip_mm", None, 1),
    "state_planting_avg_temp_c": ("avg", "planting_avg_temp_c", "apr_may_avg_temp_c", 2),
    "state_planting_precip_mm": ("avg", "planting_total_precip_mm", "apr_may_precip_mm", 1),
    "state_planting_frost_days": ("avg", "planting_frost_days", "apr_may_frost_days", 1),
    "state_harvest_avg_temp_c": ("avg", "harvest_avg_temp_c", "sep_oct_avg_temp_c", 2),
    "state_harvest_precip_mm": ("avg", "harvest_total_precip_mm", "sep_oct_precip_mm", 1),
    "state_annual_precip_mm": ("avg", "annual_total_precip_mm", "annual_precip_mm", 1),
    "state_annual_avg_temp_c": ("avg", "annual_avg_temp_c", "annual_avg_temp_c", 2),
}


def state_annual(df: DataFrame) -> DataFrame:
    """State-year measures over station-years."""
    return df.groupBy("state_abbr", "year").agg(
        F.count_distinct("station").alias("num_stations"),
        *[getattr(F, how)(col).alias(name) for name, (how, col, _, _) in STATE_MEASURES.items()],
    )


def state_features(df: DataFrame) -> DataFrame:
    """The state table under its final names, rounded half away from zero."""
    kept = [
        F.round(name, digits).alias(final) for name, (_, _, final, digits) in STATE_MEASURES.items() if final is not None
    ]
    return df.select("state_abbr", "year", "num_stations", *kept)


def climatology(df: DataFrame, by=("station", "state_abbr", "month")) -> DataFrame:
    """Long-term monthly mean and spread per station, over daily rows."""
    return df.groupBy(*by).agg(
        F.avg("temp_avg_c").alias("clim_avg_temp_c"),
        F.stddev_samp("temp_avg_c").alias("clim_std_temp_c"),
        F.avg("precip_mm").alias("clim_avg_precip_mm"),
        F.stddev_samp("precip_mm").alias("clim_std_precip_mm"),
        F.avg("gdd_corn").alias("clim_avg_gdd_corn"),
    )


def join_climatology(monthly: DataFrame, clim: DataFrame, keys=("station", "month", "state_abbr")) -> DataFrame:
    return monthly.join(clim, list(keys), "inner")


def monthly_anomalies(monthly: DataFrame, clim: DataFrame) -> DataFrame:
    """z-scores and departures of each station-month; rain is compared with n days of normal rain."""
    return _anomalies(join_climatology(monthly, clim))


def _anomalies(joined: DataFrame) -> DataFrame:
    days = F.col("total_obs_days")
    normal_rain = F.col("clim_avg_precip_mm") * days
    rain_spread = F.col("clim_std_precip_mm") * F.sqrt(days)
    return joined.select(
        "station", "state_abbr", "year", "month", "avg_temp_c", "total_precip_mm", "total_gdd_corn",
        "heat_stress_days", "frost_days",
        z_value("avg_temp_c", "clim_avg_temp_c", "clim_std_temp_c").alias("temp_anomaly_zscore"),
        z_value("total_precip_mm", normal_rain, rain_spread).alias("precip_anomaly_zscore"),
        (F.col("avg_temp_c") - F.col("clim_avg_temp_c")).alias("temp_departure_c"),
        (F.col("total_precip_mm") - normal_rain).alias("precip_departure_mm"),
    )


def with_climatology(months: DataFrame, by=("station", "state_abbr", "month")) -> DataFrame:
    """The climatology beside each station-month, merged from the months' own counts, means and squared departures.

    The months of a station are few, so they are one window. Equals `climatology` over the daily rows."""
    group = Window.partitionBy(*by)

    def merged(mean, var, n):
        total = F.sum(F.col(n)).over(group)
        overall = F.sum(F.col(mean) * F.col(n)).over(group) / total
        spread = F.sum(F.col(n) * (F.col(var) + F.pow(F.col(mean) - F.col("__mean"), 2))).over(group)
        return overall, total, spread

    out = months
    for name, mean, var, n in (("temp", "avg_temp_c", "var_temp", "n_temp"), ("precip", "avg_daily_precip_mm", "var_rain", "n_rain")):
        overall, total, spread = merged(mean, var, n)
        unit = "c" if name == "temp" else "mm"
        out = out.withColumns({"__mean": overall, "__n": total}).withColumn("__m2", spread)
        # months without any departure leave rounding dust, which is no spread
        dust = F.col("__m2") <= F.lit(1e-20) * F.col("__n") * (1 + F.pow(F.col("__mean"), 2))
        std = F.when(F.col("__n") > 1, F.when(dust, F.lit(0.0)).otherwise(F.sqrt(F.col("__m2") / (F.col("__n") - 1))))
        out = out.withColumns({f"clim_avg_{name}_{unit}": F.col("__mean"), f"clim_std_{name}_{unit}": std}).drop("__mean", "__n", "__m2")
    gdd = F.sum("total_gdd_corn").over(group) / F.sum("n_gdd").over(group)
    return out.withColumn("clim_avg_gdd_corn", gdd)


def anomalies_of_months(months: DataFrame) -> DataFrame:
    """`monthly_anomalies` for months that carry their parts."""
    return _anomalies(with_climatology(months))


def extreme_months(anomalies: DataFrame, limit: float = 1.5) -> DataFrame:
    """Months beyond the limit in either z-score, with their event label."""
    t, p = F.col("temp_anomaly_zscore"), F.col("precip_anomaly_zscore")
    return anomalies.filter((F.abs(t) > limit) | (F.abs(p) > limit)).select(
        "station", "state_abbr", "year", "month", "avg_temp_c", "total_precip_mm",
        "temp_anomaly_zscore", "precip_anomaly_zscore", weather_event_type(t, p).alias("weather_event_type"),
    )


def event_counts(events: DataFrame, by=("state_abbr", "year", "weather_event_type")) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("event_months"))


def dry_share(df: DataFrame, by=("station", "state_abbr", "year", "month")) -> DataFrame:
    """Share of dry days per station-month."""
    dry, days = F.sum("dry_day_flag"), F.count(F.lit(1))
    return df.groupBy(*by).agg(
        dry.alias("dry_days_in_month"),
        days.alias("days_in_month"),
        F.round(dry * F.lit(100.0) / days, 1).alias("pct_dry_days"),
        F.sum(F.col("dry_day_flag") * F.col("is_growing_season")).alias("gs_dry_days"),
    )


def coverage(features: DataFrame) -> DataFrame:
    """Years covered and mean conditions per state."""
    return features.groupBy("state_abbr").agg(
        F.count_distinct("year").alias("years_covered"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.round(F.avg("gs_gdd_corn"), 0).alias("avg_gdd_corn"),
        F.round(F.avg("gs_total_precip_mm"), 0).alias("avg_gs_precip"),
        F.round(F.avg("avg_heat_stress_days"), 1).alias("avg_heat_days"),
    )


def station_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("state_abbr").agg(
        F.count(F.lit(1)).alias("record_count"), F.count_distinct("station").alias("station_count")
    )


def known_years(features: DataFrame, years: Sequence[int]) -> DataFrame:
    """State features in years picked for checking against known events."""
    return features.filter(F.col("year").isin(list(years))).select(
        "state_abbr", "year", "gs_avg_temp_f", "gs_total_precip_mm", "avg_heat_stress_days",
        "jul_aug_avg_temp_c", "jul_aug_total_precip_mm",
    )
