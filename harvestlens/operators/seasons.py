"""Season aggregates per station, and their county means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from harvestlens.functions import weather as wx


@dataclass(frozen=True)
class DailyColumns:
    """Names of the daily observation columns; measures are in tenths."""

    station: str = "station"
    date: str = "date"
    lat: str = "latitude"
    lon: str = "longitude"
    rain: str = "precipitation"
    snow: str = "snowfall"
    depth: str = "snow_depth"
    tmax: str = "temp_max"
    tmin: str = "temp_min"
    tmax_attrs: str = "temp_max_attrs"
    tmin_attrs: str = "temp_min_attrs"


DAILY = DailyColumns()
GROWING, WINTER = (4, 9), (10, 3)

# county measure -> how stations combine
MEAN_MEASURES = [
    "precip_std_mm", "dry_days", "heavy_rain_days", "avg_temp_max_c", "avg_temp_min_c", "avg_temp_mean_c",
    "peak_temp_max_c", "heat_stress_days", "gdd", "frost_days", "winter_snowfall_mm", "avg_snow_depth_mm",
    "max_snow_depth_mm", "snow_days",
]
FLAG_MEASURES = ["drought_flag", "flood_flag", "extreme_heat_flag"]


def season_filter(df: DataFrame, first: int, last: int, date: str = "date") -> DataFrame:
    return df.filter(wx.in_season(F.month(date), first, last))


def _growing_measures(c: DailyColumns, null_guard: bool, frost_inclusive: bool) -> dict[str, tuple]:
    """name -> (aggregate, per-day expression)"""
    tmax, tmin, rain = F.col(c.tmax), F.col(c.tmin), F.col(c.rain)
    frost = tmin <= 0 if frost_inclusive else tmin < 0
    return {
        "total_precip": (F.sum, rain),
        "precip_std": (F.stddev_samp, rain),
        "dry_days": (F.sum, wx.flag(rain == 0)),
        "heavy_rain_days": (F.sum, wx.flag(rain > wx.SEASON_HEAVY_RAIN_TENTHS)),
        "avg_temp_max": (F.avg, tmax),
        "avg_temp_min": (F.avg, tmin),
        "peak_temp_max": (F.max, tmax),
        "avg_temp_mean": (F.avg, (tmax + tmin) / 2),
        "heat_stress_days": (F.sum, wx.flag(tmax > int(wx.HEAT_C * 10))),
        "gdd_raw": (F.sum, wx.gdd_c(tmax, tmin, null_guard=null_guard)),
        "frost_days": (F.sum, wx.flag(frost)),
        "obs_count_growing": (F.count, F.lit(1)),
    }


def growing_season(df, months=GROWING, c: DailyColumns = DAILY, null_guard=True, frost_inclusive=False) -> DataFrame:
    """Growing-season totals per station, year and position."""
    measures = _growing_measures(c, null_guard, frost_inclusive)
    return season_filter(df, *months, c.date).groupBy(
        c.station, F.year(c.date).alias("year"), c.lat, c.lon
    ).agg(*[f(x).alias(n) for n, (f, x) in measures.items()])


def winter_season(df, months=WINTER, c: DailyColumns = DAILY, season_year: bool = False) -> DataFrame:
    """Snow totals per station and year; with `season_year`, late-year months count toward the next year."""
    year = F.year(c.date)
    if season_year:
        year = year + F.when(F.month(c.date) >= months[0], 1).otherwise(0)
    return season_filter(df, *months, c.date).groupBy(c.station, year.alias("year")).agg(
        F.sum(c.snow).alias("winter_snowfall"),
        F.avg(c.depth).alias("avg_snow_depth"),
        F.max(c.depth).alias("max_snow_depth"),
        F.sum(wx.flag(F.col(c.snow) > 0)).alias("snow_days"),
    )


def join_seasons(growing: DataFrame, winter: DataFrame, keys=("station", "year")) -> DataFrame:
    return growing.join(winter, list(keys), "left")


def station_seasons(
    df, growing=GROWING, winter=WINTER, c: DailyColumns = DAILY, null_guard=True, frost_inclusive=False
) -> DataFrame:
    """Growing and winter measures from one scan and one shuffle of the daily rows.

    Equals join_seasons(growing_season(df), winter_season(df)): winter sums are kept per position first and
    added up per station-year over the few positions a station had.
    """
    month = F.month(c.date)
    grows, winters = wx.in_season(month, *growing), wx.in_season(month, *winter)

    def during(season: Column, x) -> Column:
        return F.when(season, x)

    snow, depth = F.col(c.snow), F.col(c.depth)
    parts = df.groupBy(c.station, F.year(c.date).alias("year"), c.lat, c.lon).agg(
        *[f(during(grows, x)).alias(n) for n, (f, x) in _growing_measures(c, null_guard, frost_inclusive).items()],
        F.sum(during(winters, snow)).alias("__snow"),
        F.sum(during(winters, depth)).alias("__depth"),
        F.count(during(winters, depth)).alias("__depth_n"),
        F.max(during(winters, depth)).alias("__depth_max"),
        F.sum(during(winters, wx.flag(snow > 0))).alias("__snow_days"),
    )
    w = Window.partitionBy(c.station, "year")
    return (
        parts.select(
            "*",
            F.sum("__snow").over(w).alias("winter_snowfall"),
            F.try_divide(F.sum("__depth").over(w), F.sum("__depth_n").over(w)).alias("avg_snow_depth"),
            F.max("__depth_max").over(w).alias("max_snow_depth"),
            F.sum("__snow_days").over(w).alias("snow_days"),
        )
        .filter(F.col("obs_count_growing") > 0)
        .drop("__snow", "__depth", "__depth_n", "__depth_max", "__snow_days")
    )


def seasons_to_units(df: DataFrame, scale: int = 10, snow_scale: int | None = None) -> DataFrame:
    """Tenths to °C and mm under the final names."""
    snow_scale = scale if snow_scale is None else snow_scale
    renamed = {
        "total_precip": ("total_precip_mm", scale), "precip_std": ("precip_std_mm", scale),
        "avg_temp_max": ("avg_temp_max_c", scale), "avg_temp_min": ("avg_temp_min_c", scale),
        "avg_temp_mean": ("avg_temp_mean_c", scale), "peak_temp_max": ("peak_temp_max_c", scale),
        "gdd_raw": ("gdd", scale), "winter_snowfall": ("winter_snowfall_mm", snow_scale),
        "avg_snow_depth": ("avg_snow_depth_mm", snow_scale), "max_snow_depth": ("max_snow_depth_mm", snow_scale),
    }
    return df.select(*[
        wx.from_tenths(n, renamed[n][1]).alias(renamed[n][0]) if n in renamed else F.col(n) for n in df.columns
    ])


def with_season_flags(df: DataFrame, rain="total_precip_mm", **limits) -> DataFrame:
    return df.withColumns(wx.season_flags(rain, "heat_stress_days", "heavy_rain_days", **limits))


def attach_county(df: DataFrame, station_map: DataFrame, key: str = "station") -> DataFrame:
    """Inner join with the station map; adaptive execution broadcasts the map when its measured size allows."""
    return df.join(station_map, key, "inner")


def county_weather(df: DataFrame, by=("state_fips", "county_fips", "stusps", "year")) -> DataFrame:
    """County means over stations; flags by maximum; counties without any high temperature are dropped."""
    return df.groupBy(*by).agg(
        F.avg("total_precip_mm").alias("avg_precip_mm"),
        *[F.avg(m).alias(m) for m in MEAN_MEASURES],
        *[F.max(m).alias(m) for m in FLAG_MEASURES],
    ).filter(F.col("avg_temp_max_c").isNotNull())
