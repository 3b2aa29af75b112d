"""Season, month and run operators on small daily tables."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from harvestlens.operators import daily, runs, seasons, yields
from harvestlens.plans import etl

SCHEMA = ("station string, date date, latitude double, longitude double, group_ string, precipitation int, snowfall int, snow_depth int, "
          "temp_max int, temp_min int, temp_max_attrs string, temp_min_attrs string")


def day(station, date, rain=0, hi=250, lo=100, snow=0, depth=None, lat=41.0, lon=-93.0, attrs=",,W"):
    return (station, dt.date.fromisoformat(date), lat, lon, station[:2], rain, snow, depth, hi, lo, attrs, attrs)


def weather(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def as_dicts(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def random_weather(spark, n=600):
    rnd = random.Random(7)
    rows = []
    for _ in range(n):
        date = dt.date(2011, 1, 1) + dt.timedelta(days=rnd.randrange(730))
        station = rnd.choice(["US1", "US2", "US3"])
        rows.append(day(station, date.isoformat(), rnd.choice([0, 0, 30, 501, 900]), rnd.choice([None, 100, 351, 400]), rnd.choice([None, -5, 0, 80]),
                        rnd.choice([0, 20]), rnd.choice([None, 0, 50]), lat=rnd.choice([41.0, 41.5])))
    return weather(spark, *rows)


def test_growing_season_limits_and_lone_observation(spark):
    df = weather(
        spark, day("US1", "2012-03-31", 999), day("US1", "2012-04-01", 500, 350, 0), day("US1", "2012-09-30", 501, 351, -1),
        day("US1", "2012-10-01", 999), day("US2", "2012-06-01", 0))
    got = as_dicts(seasons.growing_season(df), "station")
    one = got[("US1",)]
    assert (one["total_precip"], one["heavy_rain_days"], one["heat_stress_days"], one["frost_days"], one["obs_count_growing"]) == (1001, 1, 1, 1, 2)
    assert got[("US2",)]["precip_std"] is None and got[("US2",)]["dry_days"] == 1
    longer = as_dicts(seasons.growing_season(df, months=(4, 10)), "station")
    assert longer[("US1",)]["obs_count_growing"] == 3


def test_missing_temperature_scores_nothing_unless_literal(spark):
    df = weather(spark, day("US1", "2012-06-01", hi=None), day("US1", "2012-06-02", hi=200, lo=100))
    assert seasons.growing_season(df).first()["gdd_raw"] == 50.0
    assert seasons.growing_season(df, null_guard=False).first()["gdd_raw"] == 250.0


def test_winter_by_calendar_and_season_year(spark):
    df = weather(spark, day("US1", "2012-01-05", snow=10), day("US1", "2012-11-05", snow=20), day("US1", "2013-02-01", snow=40))
    assert {r["year"]: r["winter_snowfall"] for r in seasons.winter_season(df).collect()} == {2012: 30, 2013: 40}
    assert {r["year"]: r["winter_snowfall"] for r in seasons.winter_season(df, season_year=True).collect()} == {2012: 10, 2013: 60}


def test_one_scan_equals_two_aggregates_even_when_a_station_moves(spark):
    df = random_weather(spark)
    two = seasons.join_seasons(seasons.growing_season(df), seasons.winter_season(df))
    one = seasons.station_seasons(df).select(*two.columns)

    def rounded(d):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())

    key = [str(r) for r in rounded(one)]
    assert key == [str(r) for r in rounded(two)] and len(key) > 4


def test_county_weather_and_merge(spark):
    df = weather(spark, day("US1", "2012-06-01", 100, 300, 100), day("US2", "2012-06-01", 300, 300, 100), day("US3", "2012-06-01", 1, None, None))
    station_map = spark.createDataFrame([("US1", 19, 1, "IA"), ("US2", 19, 1, "IA"), ("US3", 19, 2, "IA")],
                                        "station string, state_fips int, county_fips int, stusps string")
    report = spark.createDataFrame(
        [("1", "19", "Adair  ", "IA", "Corn", "2012", 150.0, " Non-Irrigated"), ("abc", "19", "x", "IA", "Corn", "2012", 1.0, ""),
         ("1", "19", "Adair", "IA", "Soybeans", "2012", None, ""), ("2", "19", "y", "IA", "Corn", "2012", 1.0, "")],
        "`County Code` string, `State Code` string, `County Name` string, `State Abbreviation` string, `Commodity Name` string, "
        "`Yield Year` string, `Yield Amount` double, `Irrigation Practice Name` string")
    assert yields.clean_yields(report).count() == 3
    rows = etl.build_merged(df, report, station_map).collect()
    assert [(r["county_fips"], r["avg_precip_mm"], r["yield_amount"]) for r in rows] == [(1, 20.0, 150.0)]


def test_longest_run_is_broken_by_wet_and_by_missing_days(spark):
    dates = [("2012-06-01", 0), ("2012-06-02", 0), ("2012-06-03", 5), ("2012-06-04", 0), ("2012-06-05", 0), ("2012-06-06", 0),
             ("2012-06-08", 0), ("2013-01-01", 3)]
    df = weather(spark, *[day("US1", d, r) for d, r in dates], day("US1", "2012-06-02", 0))
    got = as_dicts(runs.longest_dry_run(daily.daily_units(df)), "station", "year")
    assert {k: (v["longest_run_days"], str(v["run_start"])) for k, v in got.items()} == {("US1", 2012): (3, "2012-06-04")}


def test_five_day_burst(spark):
    wet = [day("US1", f"2012-06-0{i}", 10 * i) for i in range(1, 7)] + [day("US1", "2012-06-20", 150)]
    got = runs.rolling_max_sum(runs.daily_total(weather(spark, *wet), "precipitation"), "precipitation", 5).first()
    assert got["max_5day_precipitation"] == 200


def test_monthly_anomaly_scores(spark):
    df = weather(spark, *[day("US1", f"{y}-07-{d:02d}", r, 300, 100) for y, d, r in [(2011, 1, 10), (2011, 2, 30), (2012, 1, 50)]])
    days = etl.scoped_days(df, (2011, 2012))
    rows = as_dicts(daily.monthly_anomalies(daily.monthly_station(days), daily.climatology(days)), "year")
    assert rows[(2011,)]["temp_anomaly_zscore"] == 0.0
    assert math.isclose(rows[(2011,)]["precip_anomaly_zscore"], (4 - 3 * 2) / (2 * math.sqrt(2)))
    assert rows[(2012,)]["precip_departure_mm"] == 2.0
    assert daily.monthly_station(days).first()["state_abbr"] == "IA"


def test_scope_drops_other_countries_years_and_places(spark):
    df = weather(spark, day("US1", "2012-07-01"), day("CA1", "2012-07-01"), day("US1", "2009-07-01"), day("US1", "2012-07-01", lat=10.0))
    assert etl.scoped_days(df, (2010, 2024)).count() == 1


def test_views_are_registered(spark):
    from harvestlens.sources import tables

    tables.define_views(etl.state_views(weather(spark, day("US1", "2012-07-01")), (2010, 2024)))
    assert spark.sql("SELECT count(*) AS n FROM weather_features_final").first()["n"] == 1


def test_negative_readings_become_missing(spark):
    df = weather(spark, day("US1", "2012-07-01", rain=-9999))
    row = daily.daily_features(df).first()
    assert row["precip_mm"] is None and row["dry_day_flag"] == 0 and row["heavy_rain_flag"] == 0


def test_quality_and_raw_flags_differ(spark):
    df = weather(spark, day("US1", "2012-07-01", hi=400, attrs=",S,"))
    assert daily.daily_features(df).first()["heat_stress_flag"] == 1
    assert daily.daily_features(df, respect_quality=True).first()["heat_stress_flag"] == 0
    assert df.select(F.lit(1)).count() == 1
