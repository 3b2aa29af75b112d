"""Daily rows to analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harvestlens.functions import labels
from harvestlens.operators import anomalies, daily, features, geo, seasons, yields


def station_weather(weather: DataFrame, null_guard: bool = True, **limits) -> DataFrame:
    """Season measures in °C and mm with season flags, one row per station-year."""
    return seasons.with_season_flags(seasons.seasons_to_units(seasons.station_seasons(weather, null_guard=null_guard)), **limits)


def county_table(weather: DataFrame, station_map: DataFrame, null_guard: bool = True, **limits) -> DataFrame:
    """County weather. Days are aggregated per station first, so the map joins station-years, not days."""
    return seasons.county_weather(seasons.attach_county(station_weather(weather, null_guard, **limits), station_map))


def build_merged(
    weather: DataFrame, yield_report: DataFrame, station_map: DataFrame | None = None, counties: DataFrame | None = None,
    null_guard: bool = True, country: str = "US", **limits,
) -> DataFrame:
    """Yields with the weather of their county and year.

    Stations come with a county map, or with county polygons to be placed in. With polygons each station-year counts where
    the station stood, so the daily rows are read once and a moved station is in one county at a time.
    """
    if station_map is None:
        seasons_ = station_weather(weather, null_guard, **limits).filter(F.col("station").startswith(country))
        county = seasons.county_weather(geo.points_in_polygons(seasons_, counties))
    else:
        county = county_table(weather, station_map, null_guard, **limits)
    return yields.merge_yield_weather(yields.clean_yields(yield_report), county)


def scoped_days(weather: DataFrame, years: tuple[int, int], **kw) -> DataFrame:
    """Daily features of stations inside the state boxes."""
    return daily.with_state(daily.daily_features(daily.in_scope(weather, years), **kw))


def build_state_features(weather: DataFrame, years: tuple[int, int] = (2010, 2024)) -> DataFrame:
    """State-year feature table."""
    return daily.state_features(daily.state_annual(daily.annual_station(scoped_days(weather, years))))


def state_views(weather: DataFrame, years: tuple[int, int] = (2010, 2024)) -> dict[str, DataFrame]:
    """The whole chain by view name, for registration as temp views."""
    days = scoped_days(weather, years)
    monthly, clim = daily.monthly_station(days), daily.climatology(days)
    annual = daily.annual_station(days)
    state = daily.state_annual(annual)
    anomalies_ = daily.monthly_anomalies(monthly, clim)
    return {
        "weather_us_filtered": daily.daily_features(daily.in_scope(weather, years)),
        "weather_with_state": daily.with_state(daily.daily_features(daily.in_scope(weather, years)), keep_other=True),
        "weather_target_states": days,
        "weather_monthly_station": monthly,
        "weather_growing_season_station": annual,
        "weather_state_annual": state,
        "station_climatology": clim,
        "weather_monthly_anomalies": anomalies_,
        "extreme_weather_events": daily.extreme_months(anomalies_),
        "dry_spells": daily.dry_share(days),
        "weather_features_final": daily.state_features(state),
    }


def station_month_anomalies(weather: DataFrame, years: tuple[int, int] = (2010, 2024)) -> DataFrame:
    """Anomalies of each station-month against the station's own months, from one scan of the daily rows."""
    return daily.anomalies_of_months(daily.monthly_station(scoped_days(weather, years), parts=True))


def extreme_events(weather: DataFrame, years: tuple[int, int] = (2010, 2024)) -> DataFrame:
    """Event months per state, year and type."""
    return daily.event_counts(daily.extreme_months(station_month_anomalies(weather, years)))


def signal_table(merged: DataFrame) -> DataFrame:
    """Merged rows with season ratios, yield and climate z-scores, classes and mismatch labels."""
    rows = merged
    if "total_precip_mm" not in rows.columns:
        rows = rows.withColumn("total_precip_mm", F.col("avg_precip_mm"))
    rows = features.season_ratios(rows) if "obs_count" in rows.columns else rows
    # a county's rows are few: two windows over one distribution by county
    rows = anomalies.zscore(
        rows, {"avg_temp_mean_c": "temp_anomaly_z", "total_precip_mm": "precip_anomaly_z"}, ["state_fips", "county_fips"],
        keep_stats={"avg_temp_mean_c": ("temp_clim_mean", "temp_clim_std"),
                    "total_precip_mm": ("precip_clim_mean", "precip_clim_std")}, small=True,
    )
    rows = anomalies.zscore(
        rows, {"yield_amount": "yield_zscore"}, ["state_fips", "county_fips", "commodity"],
        keep_stats={"yield_amount": ("yield_mean", "yield_std")}, small=True,
    )
    return rows.withColumns({
        "yield_category": labels.yield_category_z("yield_zscore"),
        "weather_yield_mismatch": labels.mismatch_label("yield_zscore", "temp_anomaly_z", "precip_anomaly_z"),
    })
