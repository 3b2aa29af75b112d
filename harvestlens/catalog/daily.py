"""Queries over daily weather rows: expressions, filters, season, month and year aggregates, anomalies, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens.catalog.base import YEARS, check_table, growing_sql
from harvestlens.catalog.registry import query
from harvestlens.functions import weather as wxf
from harvestlens.functions.labels import weather_event_type
from harvestlens.operators import daily, grouping, runs, seasons
from harvestlens.plans import etl
from harvestlens.sources import tables

# ---- SQL twins of the daily feature chain

_GOOD = {k: f"CASE WHEN temp_{k}_attrs NOT LIKE '%S%' THEN temp_{k} / 1e1 END" for k in ("max", "min")}
_F = "{} * 9e0 / 5e0 + 32e0"
_BOXES = " ".join(
    f"WHEN latitude BETWEEN {s}::DOUBLE AND {n}::DOUBLE AND longitude BETWEEN {w}::DOUBLE AND {e}::DOUBLE THEN '{st}'"
    for st, (s, n, w, e) in wxf.STATE_BOXES.items()
)


def _phase_sql(crop: str) -> str:
    parts = " ".join(
        f"WHEN month IN ({', '.join(map(str, months))}) THEN '{p}'" for p, months in wxf.GROWTH_PHASES[crop].items()
    )
    return f"CASE {parts} ELSE 'dormant' END"


check_table("daily_base", f"""
  SELECT *, (temp_max_c + temp_min_c) / 2e0 AS temp_avg_c, temp_max_c - temp_min_c AS temp_range_c,
    {_F.format('temp_max_c')} AS temp_max_f, {_F.format('temp_min_c')} AS temp_min_f,
    {_F.format('((temp_max_c + temp_min_c) / 2e0)')} AS temp_avg_f
  FROM (SELECT *, {_GOOD['max']} AS temp_max_c, {_GOOD['min']} AS temp_min_c,
      CASE WHEN precipitation >= 0 THEN precipitation / 1e1 END AS precip_mm,
      CASE WHEN snowfall >= 0 THEN snowfall / 1e0 END AS snowfall_mm,
      CASE WHEN snow_depth >= 0 THEN snow_depth / 1e0 END AS snow_depth_mm,
      year(date) AS year, month(date) AS month, dayofyear(date) AS day_of_year FROM wx) d""")
check_table("daily_full", f"""
  SELECT *, CASE WHEN month BETWEEN 4 AND 10 THEN 1 ELSE 0 END AS is_growing_season,
    {_phase_sql('corn')} AS corn_growth_phase, {_phase_sql('soy')} AS soy_growth_phase,
    CASE WHEN temp_max_f IS NULL OR temp_min_f IS NULL THEN NULL
      ELSE greatest(0e0, (least(temp_max_f, 86e0) + greatest(temp_min_f, 50e0)) / 2e0 - 50e0) END AS gdd_corn,
    CASE WHEN temp_avg_f IS NULL THEN NULL ELSE greatest(0e0, temp_avg_f - 50e0) END AS gdd_soy,
    CASE WHEN temp_max > 350 THEN 1 ELSE 0 END AS heat_stress_flag, CASE WHEN temp_min <= 0 THEN 1 ELSE 0 END AS frost_flag,
    CASE WHEN temp_min < -100 THEN 1 ELSE 0 END AS extreme_cold_flag,
    CASE WHEN precipitation > 250 THEN 1 ELSE 0 END AS heavy_rain_flag,
    CASE WHEN precipitation = 0 THEN 1 ELSE 0 END AS dry_day_flag FROM daily_base""")
check_table("days", f"""
  SELECT *, CASE {_BOXES} ELSE 'OTHER' END AS state_abbr FROM daily_full
  WHERE station LIKE 'US%' AND year BETWEEN {YEARS[0]} AND {YEARS[1]}
    AND latitude BETWEEN 36e0 AND 49.5e0 AND longitude BETWEEN -104.5e0 AND -84.5e0 AND CASE {_BOXES} ELSE 'OTHER' END <> 'OTHER'""")
check_table("months", f"""
  SELECT {', '.join(daily.MONTH_KEYS)}, avg(temp_avg_c) AS avg_temp_c, avg(temp_avg_f) AS avg_temp_f, max(temp_max_c) AS max_temp_c,
    min(temp_min_c) AS min_temp_c, avg(temp_range_c) AS avg_diurnal_range_c, stddev_samp(temp_avg_c) AS temp_variability,
    sum(precip_mm) AS total_precip_mm, avg(precip_mm) AS avg_daily_precip_mm, max(precip_mm) AS max_daily_precip_mm,
    count(*) FILTER (precip_mm > 0) AS rainy_days, count(*) FILTER (precip_mm = 0 OR precip_mm IS NULL) AS dry_days,
    sum(gdd_corn) AS total_gdd_corn, sum(gdd_soy) AS total_gdd_soy, sum(heat_stress_flag) AS heat_stress_days,
    sum(frost_flag) AS frost_days, sum(heavy_rain_flag) AS heavy_rain_days, sum(dry_day_flag) AS consecutive_dry_days_approx,
    count(*) AS total_obs_days FROM days GROUP BY {', '.join(daily.MONTH_KEYS)}""")


def _annual_sql() -> str:
    out = []
    for prefix, (months, items) in daily.PERIODS.items():
        inside = "is_growing_season = 1" if months is None else f"month IN ({', '.join(map(str, months))})"
        for suffix, how, col in items:
            other = " ELSE 0" if how == "sum" else ""
            out.append(f"{how}(CASE WHEN {inside} THEN {col}{other} END) AS {prefix}_{suffix}")
    return ", ".join(out)


check_table("years", f"""
  SELECT {', '.join(daily.YEAR_KEYS)}, {_annual_sql()}, sum(precip_mm) AS annual_total_precip_mm,
    avg(temp_avg_c) AS annual_avg_temp_c, sum(gdd_corn) AS annual_total_gdd_corn, count(*) AS total_obs_days,
    count(temp_avg_c) AS days_with_temp, count(precip_mm) AS days_with_precip
  FROM days GROUP BY {', '.join(daily.YEAR_KEYS)}""")
check_table("state_years", f"""
  SELECT state_abbr, year, count(DISTINCT station) AS num_stations,
    {', '.join(f'{how}({col}) AS {name}' for name, (how, col, _, _) in daily.STATE_MEASURES.items())}
  FROM years GROUP BY state_abbr, year""")
check_table("state_final", f"""
  SELECT state_abbr, year, num_stations,
    {', '.join(f'round({name}, {d}) AS {final}' for name, (_, _, final, d) in daily.STATE_MEASURES.items() if final)}
  FROM state_years""")
check_table("clim", """
  SELECT station, state_abbr, month, avg(temp_avg_c) AS clim_avg_temp_c, stddev_samp(temp_avg_c) AS clim_std_temp_c,
    avg(precip_mm) AS clim_avg_precip_mm, stddev_samp(precip_mm) AS clim_std_precip_mm, avg(gdd_corn) AS clim_avg_gdd_corn
  FROM days GROUP BY station, state_abbr, month""")
check_table("month_anomalies", """
  SELECT m.station, m.state_abbr, m.year, m.month, avg_temp_c, total_precip_mm, total_gdd_corn, heat_stress_days, frost_days,
    CASE WHEN clim_std_temp_c > 0 THEN (avg_temp_c - clim_avg_temp_c) / clim_std_temp_c ELSE 0 END AS temp_anomaly_zscore,
    CASE WHEN clim_std_precip_mm > 0 THEN (total_precip_mm - clim_avg_precip_mm * total_obs_days)
      / (clim_std_precip_mm * sqrt(total_obs_days)) ELSE 0 END AS precip_anomaly_zscore,
    avg_temp_c - clim_avg_temp_c AS temp_departure_c, total_precip_mm - clim_avg_precip_mm * total_obs_days AS precip_departure_mm
  FROM months m JOIN clim c ON m.station = c.station AND m.month = c.month AND m.state_abbr = c.state_abbr""")
_EVENT = """CASE WHEN temp_anomaly_zscore > 2 AND precip_anomaly_zscore < -1.5 THEN 'HOT_DRY_EXTREME'
    WHEN temp_anomaly_zscore > 2 THEN 'HEAT_WAVE' WHEN temp_anomaly_zscore < -2 THEN 'COLD_EXTREME'
    WHEN precip_anomaly_zscore > 2 THEN 'FLOOD_RISK' WHEN precip_anomaly_zscore < -2 THEN 'DROUGHT'
    WHEN temp_anomaly_zscore > 1.5 AND precip_anomaly_zscore < -1 THEN 'HOT_DRY'
    WHEN precip_anomaly_zscore > 1.5 AND temp_anomaly_zscore < -0.5 THEN 'COOL_WET' ELSE 'NORMAL' END"""
check_table("extreme_month_rows", f"""
  SELECT *, {_EVENT} AS weather_event_type FROM month_anomalies
  WHERE abs(temp_anomaly_zscore) > 1.5 OR abs(precip_anomaly_zscore) > 1.5""")

# ---- expressions and filters

_ROW = "station:s date:s precipitation:i temp_max:i temp_min:i snowfall:i snow_depth:i"


def _rows(columns: str, extra: str = "") -> str:
    return f"SELECT station, cast(date AS string) AS date, precipitation, temp_max, temp_min, snowfall, snow_depth{columns} FROM {extra}"


@query("p04_wrapping_season_filter", _ROW, _rows("", "wx WHERE month(date) >= 10 OR month(date) <= 3"))
def _(b):
    return seasons.season_filter(b.weather, 10, 3)


@query("p05_prefix_filter", _ROW, _rows("", "wx WHERE station LIKE 'US%'"))
def _(b):
    return daily.prefix_filter(b.weather, "station", "US")


@query("p06_box_filter", _ROW, _rows("", "wx WHERE latitude BETWEEN 40 AND 43.5 AND longitude BETWEEN -100 AND -90"))
def _(b):
    return daily.bbox_filter(b.weather, "latitude", "longitude", (40.0, 43.5, -100.0, -90.0))


@query("p07_year_range_filter", _ROW, _rows("", "wx WHERE year(date) BETWEEN 1997 AND 1999"))
def _(b):
    return daily.year_filter(b.weather, 1997, 1999)


@query(
    "p13_p14_units_and_quality", "station:s date:s precip_mm:d snowfall_mm:d snow_depth_mm:d temp_max_c:d temp_min_c:d",
    "SELECT station, cast(date AS string) AS date, precip_mm, snowfall_mm, snow_depth_mm, temp_max_c, temp_min_c FROM daily_base",
)
def _(b):
    return daily.daily_temps(daily.daily_units(b.weather))


@query(
    "p15_p16_temperatures", "station:s date:s temp_avg_c:d temp_range_c:d temp_max_f:d temp_min_f:d temp_avg_f:d",
    "SELECT station, cast(date AS string) AS date, temp_avg_c, temp_range_c, temp_max_f, temp_min_f, temp_avg_f FROM daily_base",
)
def _(b):
    return daily.daily_temps(b.weather)


@query(
    "p17_p18_calendar_and_phase", "station:s date:s year:i month:i day_of_year:i corn_growth_phase:s soy_growth_phase:s",
    "SELECT station, cast(date AS string) AS date, year, month, day_of_year, corn_growth_phase, soy_growth_phase FROM daily_full",
)
def _(b):
    return daily.date_parts(b.weather).withColumns({
        f"{c}_growth_phase": wxf.growth_phase("month", c) for c in ("corn", "soy")
    })


@query(
    "p19_p20_heat_units_f", "station:s date:s gdd_corn:d gdd_soy:d",
    "SELECT station, cast(date AS string) AS date, gdd_corn, gdd_soy FROM daily_full",
)
def _(b):
    return daily.daily_temps(b.weather).withColumns({
        "gdd_corn": wxf.gdd_f("temp_max_f", "temp_min_f"), "gdd_soy": wxf.gdd_f("temp_max_f", "temp_min_f", cap=None),
    })


@query(
    "p21_heat_units_c", "station:s date:s gdd:d gdd_literal:d",
    """SELECT station, cast(date AS string) AS date,
      CASE WHEN m IS NULL THEN NULL ELSE greatest(least(m, 300) - 100, 0) END AS gdd, greatest(least(m, 300) - 100, 0) AS gdd_literal
      FROM (SELECT *, (temp_max + temp_min) / 2e0 AS m FROM wx) q""",
)
def _(b):
    return b.weather.withColumns({
        "gdd": wxf.gdd_c("temp_max", "temp_min"), "gdd_literal": wxf.gdd_c("temp_max", "temp_min", null_guard=False),
    })


_FLAGS = "heat_stress_flag frost_flag extreme_cold_flag heavy_rain_flag dry_day_flag".split()


@query(
    "p22_day_flags", "station:s date:s " + " ".join(f"{f}:i" for f in _FLAGS),
    f"SELECT station, cast(date AS string) AS date, {', '.join(_FLAGS)} FROM daily_full",
)
def _(b):
    return daily.daily_features(b.weather)


@query(
    "p22_day_flags_quality_masked", "station:s date:s heat_stress_flag:i frost_flag:i",
    """SELECT station, cast(date AS string) AS date, CASE WHEN temp_max_c > 35 THEN 1 ELSE 0 END AS heat_stress_flag,
      CASE WHEN temp_min_c < 0 THEN 1 ELSE 0 END AS frost_flag FROM daily_full""",
)
def _(b):
    return daily.daily_features(b.weather, respect_quality=True, frost_inclusive=False)


@query(
    "p24_state_by_box", "station:s state_abbr:s n:i",
    f"SELECT station, CASE {_BOXES} ELSE 'OTHER' END AS state_abbr, count(*) AS n FROM wx GROUP BY station, 2",
)
def _(b):
    return grouping.value_counts(daily.with_state(b.weather, keep_other=True), "station", "state_abbr")


# ---- season aggregates

_GROW = ("total_precip:i precip_std:d dry_days:i heavy_rain_days:i avg_temp_max:d avg_temp_min:d peak_temp_max:i "
         "avg_temp_mean:d heat_stress_days:i gdd_raw:d frost_days:i obs_count_growing:i")
_POINT = "station:s year:i latitude:d longitude:d "


@query("a01_growing_season", _POINT + _GROW, "SELECT * FROM growing")
def _(b):
    return seasons.growing_season(b.weather)


@query("a01_growing_season_literal_heat_units", _POINT + _GROW, growing_sql(guard=False, months=(4, 10)))
def _(b):
    return seasons.growing_season(b.weather, months=(4, 10), null_guard=False)


_SNOW = "winter_snowfall:i avg_snow_depth:d max_snow_depth:i snow_days:i"


@query("a02_winter_season", "station:s year:i " + _SNOW, "SELECT * FROM winter")
def _(b):
    return seasons.winter_season(b.weather)


@query(
    "a02_winter_by_season_year", "station:s year:i " + _SNOW,
    """SELECT station, year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS year, sum(snowfall) AS winter_snowfall,
      avg(snow_depth) AS avg_snow_depth, max(snow_depth) AS max_snow_depth, count(*) FILTER (snowfall > 0) AS snow_days
      FROM wx WHERE month(date) NOT BETWEEN 4 AND 9 GROUP BY station, 2""",
)
def _(b):
    return seasons.winter_season(b.weather, season_year=True)


_JOINED = "SELECT g.*, winter_snowfall, avg_snow_depth, max_snow_depth, snow_days FROM growing g LEFT JOIN winter w ON g.station = w.station AND g.year = w.year"


@query("j01_growing_with_winter", _POINT + _GROW + " " + _SNOW, _JOINED)
def _(b):
    return seasons.join_seasons(seasons.growing_season(b.weather), seasons.winter_season(b.weather))


@query("j01_one_scan_seasons", _POINT + _GROW + " " + _SNOW, _JOINED)
def _(b):
    return seasons.station_seasons(b.weather)


_SEASON = ("total_precip_mm:d precip_std_mm:d dry_days:d heavy_rain_days:d avg_temp_max_c:d avg_temp_min_c:d avg_temp_mean_c:d "
           "peak_temp_max_c:d heat_stress_days:d gdd:d frost_days:d winter_snowfall_mm:d avg_snow_depth_mm:d "
           "max_snow_depth_mm:d snow_days:d drought_flag:i flood_flag:i extreme_heat_flag:i")


@query("p23_station_season_flags", "station:s year:i " + _SEASON, "SELECT * FROM season")
def _(b):
    return b.station_seasons


@query("a03_j02_county_weather", "state_fips:i county_fips:i stusps:s year:i " + _SEASON.replace("total_precip_mm", "avg_precip_mm"),
       "SELECT * FROM county")
def _(b):
    return b.county_weather


# ---- month, year and state aggregates

@query("a04_monthly_station",
       "station:s state_abbr:s latitude:d longitude:d year:i month:i corn_growth_phase:s soy_growth_phase:s avg_temp_c:d "
       "avg_temp_f:d max_temp_c:d min_temp_c:d avg_diurnal_range_c:d temp_variability:d total_precip_mm:d avg_daily_precip_mm:d "
       "max_daily_precip_mm:d rainy_days:i dry_days:i total_gdd_corn:d total_gdd_soy:d heat_stress_days:i frost_days:i "
       "heavy_rain_days:i consecutive_dry_days_approx:i total_obs_days:i", "SELECT * FROM months")
def _(b):
    return daily.monthly_station(b.days)


_ANNUAL = " ".join(f"{p}_{s}:d" for p, (_, items) in daily.PERIODS.items() for s, _, _ in items)


@query("a05_annual_station",
       f"station:s state_abbr:s latitude:d longitude:d year:i {_ANNUAL} annual_total_precip_mm:d annual_avg_temp_c:d "
       "annual_total_gdd_corn:d total_obs_days:i days_with_temp:i days_with_precip:i", "SELECT * FROM years")
def _(b):
    return daily.annual_station(b.days)


@query("a06_state_annual", "state_abbr:s year:i num_stations:i " + " ".join(f"{n}:d" for n in daily.STATE_MEASURES),
       "SELECT * FROM state_years")
def _(b):
    return daily.state_annual(daily.annual_station(b.days))


_FINAL = "state_abbr:s year:i num_stations:i " + " ".join(f"{f}:d" for _, _, f, _ in daily.STATE_MEASURES.values() if f)


@query("a07_q02_state_features", _FINAL, "SELECT * FROM state_final")
def _(b):
    return etl.build_state_features(b.weather, YEARS)


@query("s13_view_chain", _FINAL, "SELECT * FROM state_final")
def _(b):
    tables.define_views(etl.state_views(b.weather, YEARS))
    return b.spark.sql("SELECT * FROM weather_features_final")


@query("a08_climatology", "station:s state_abbr:s month:i clim_avg_temp_c:d clim_std_temp_c:d clim_avg_precip_mm:d "
       "clim_std_precip_mm:d clim_avg_gdd_corn:d", "SELECT * FROM clim")
def _(b):
    return daily.climatology(b.days)


_ANOM = ("station:s state_abbr:s year:i month:i avg_temp_c:d total_precip_mm:d total_gdd_corn:d heat_stress_days:i frost_days:i "
         "temp_anomaly_zscore:d precip_anomaly_zscore:d temp_departure_c:d precip_departure_mm:d")


@query("w08_j04_monthly_anomalies", _ANOM, "SELECT * FROM month_anomalies")
def _(b):
    return etl.station_month_anomalies(b.weather, YEARS)


@query("p29_weather_event_type", "station:s year:i month:i weather_event_type:s",
       f"SELECT station, year, month, {_EVENT} AS weather_event_type FROM month_anomalies")
def _(b):
    return etl.station_month_anomalies(b.weather, YEARS).withColumn(
        "weather_event_type", weather_event_type("temp_anomaly_zscore", "precip_anomaly_zscore"))


@query("t02_top_monthly_anomalies", "station:s year:i month:i temp_anomaly_zscore:d",
       """SELECT station, year, month, temp_anomaly_zscore FROM month_anomalies
          ORDER BY abs(round(temp_anomaly_zscore, 9)) DESC, station, year, month LIMIT 50""")
def _(b):
    rows = etl.station_month_anomalies(b.weather, YEARS).withColumn("z", F.round("temp_anomaly_zscore", 9))
    return grouping.top_abs(rows, "z", 50, ["station", "year", "month"])


@query("a10_q03_extreme_event_counts", "state_abbr:s year:i weather_event_type:s event_months:i",
       "SELECT state_abbr, year, weather_event_type, count(*) AS event_months FROM extreme_month_rows GROUP BY ALL")
def _(b):
    return etl.extreme_events(b.weather, YEARS)


@query("q03_extreme_months", "station:s state_abbr:s year:i month:i avg_temp_c:d total_precip_mm:d temp_anomaly_zscore:d "
       "precip_anomaly_zscore:d weather_event_type:s", "SELECT * FROM extreme_month_rows")
def _(b):
    return daily.extreme_months(etl.station_month_anomalies(b.weather, YEARS))


@query("a09_dry_share", "station:s state_abbr:s year:i month:i dry_days_in_month:i days_in_month:i pct_dry_days:d gs_dry_days:i",
       """SELECT station, state_abbr, year, month, sum(dry_day_flag) AS dry_days_in_month, count(*) AS days_in_month,
          round(sum(dry_day_flag) * 1e2 / count(*), 1) AS pct_dry_days,
          sum(CASE WHEN is_growing_season = 1 THEN dry_day_flag ELSE 0 END) AS gs_dry_days
          FROM days GROUP BY station, state_abbr, year, month""")
def _(b):
    return daily.dry_share(b.days)


@query("a11_coverage", "state_abbr:s years_covered:i first_year:i last_year:i avg_gdd_corn:d avg_gs_precip:d avg_heat_days:d",
       """SELECT state_abbr, count(DISTINCT year) AS years_covered, min(year) AS first_year, max(year) AS last_year,
          round(avg(gs_gdd_corn), 0) AS avg_gdd_corn, round(avg(gs_total_precip_mm), 0) AS avg_gs_precip,
          round(avg(avg_heat_stress_days), 1) AS avg_heat_days FROM state_final GROUP BY state_abbr""")
def _(b):
    return daily.coverage(etl.build_state_features(b.weather, YEARS))


@query("a11_a48_station_counts", "state_abbr:s record_count:i station_count:i",
       "SELECT state_abbr, count(*) AS record_count, count(DISTINCT station) AS station_count FROM days GROUP BY state_abbr")
def _(b):
    return daily.station_counts(b.days)


@query("a12_known_years", "state_abbr:s year:i gs_avg_temp_f:d gs_total_precip_mm:d avg_heat_stress_days:d jul_aug_avg_temp_c:d "
       "jul_aug_total_precip_mm:d", "SELECT * FROM state_final WHERE year IN (1996, 1998, 1999)")
def _(b):
    return daily.known_years(etl.build_state_features(b.weather, YEARS), [1996, 1998, 1999])


@query("a48_distinct_stations", "n_distinct:i", "SELECT count(DISTINCT station) AS n_distinct FROM wx")
def _(b):
    return grouping.distinct_count(b.weather, ["station"])


# ---- runs and rolling sums

_DAY_SQL = """SELECT station, date, year(date) AS year, sum(precipitation) / 1e1 AS rain FROM wx
  WHERE precipitation >= 0 GROUP BY station, date"""


@query("w11_longest_dry_run", "station:s year:i longest_run_days:i run_start:s", f"""
  WITH d AS ({_DAY_SQL}),
  dry AS (SELECT *, date - cast(row_number() OVER (PARTITION BY station, year ORDER BY date) AS int) AS island FROM d WHERE rain = 0),
  runs AS (SELECT station, year, island, count(*) AS days, min(date) AS start FROM dry GROUP BY station, year, island)
  SELECT station, year, days AS longest_run_days, cast(start AS string) AS run_start FROM
    (SELECT *, row_number() OVER (PARTITION BY station, year ORDER BY days DESC, start) AS k FROM runs) q WHERE k = 1""")
def _(b):
    return runs.longest_dry_run(daily.daily_units(b.weather))


@query("w12_max_five_day_rain", "station:s year:i max_5day_precipitation:i", """
  WITH d AS (SELECT station, date, year(date) AS year, sum(precipitation) AS rain FROM wx WHERE precipitation >= 0 GROUP BY station, date)
  SELECT station, year, max(burst) AS max_5day_precipitation FROM (
    SELECT station, year, sum(rain) OVER (PARTITION BY station, year ORDER BY date
      RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND CURRENT ROW) AS burst FROM d) q GROUP BY station, year""")
def _(b):
    rows = b.weather.filter(F.col("precipitation") >= 0)
    return runs.rolling_max_sum(runs.daily_total(rows, "precipitation"), "precipitation", 5)


