"""Queries over county tables: cleaning, joins, signals, features, baselines, labels and driver reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestlens.catalog.base import LIMITS, PREDICT_FROM, SALT, TEST_FROM, check_table, region_sql
from harvestlens.catalog.registry import query
from harvestlens.functions import labels, numeric, text
from harvestlens.functions.regions import DRIVER_GROUPS, driver_table, region_table
from harvestlens.operators import (
    anomalies, cells, correlations, features, geo, grouping, lookup, reports, seasons, splits, yields,
)
from harvestlens.plans import etl, studies
from harvestlens.session import fresh_folder
from harvestlens.sources import files

KEY = "state_fips:i county_fips:i year:i commodity:s irrigation:s "
KEYS = "state_fips, county_fips, year, commodity, irrigation"
_MEASURES = "avg_precip_mm:d " + " ".join(f"{m}:d" for m in seasons.MEAN_MEASURES) + " drought_flag:i flood_flag:i extreme_heat_flag:i"

# ---- yields and the merged table


@query("p01_p02_p03_clean_yields", "state_fips:i county_fips:i county_name:s state_abbr:s commodity:s year:i yield_amount:d irrigation:s",
       "SELECT * FROM yields")
def _(b):
    return yields.clean_yields(b.yield_report)


@query("j03_q01_merged_yield_weather", KEY + "county_name:s state_abbr:s stusps:s yield_amount:d " + _MEASURES, "SELECT * FROM merged")
def _(b):
    return b.merged_plan


@query("j05_stations_in_counties", "station:s state_fips:i county_fips:i stusps:s",
       """SELECT DISTINCT station, state_fips, county_fips, stusps FROM wx JOIN county_box
          ON latitude > south AND latitude < north AND longitude > west AND longitude < east WHERE group_ = 'US'""")
def _(b):
    return geo.stations_in_counties(b.weather, b.counties)


check_table("located", """SELECT DISTINCT station, state_fips, county_fips, stusps FROM wx JOIN county_box
  ON latitude > south AND latitude < north AND longitude > west AND longitude < east WHERE group_ = 'US'""")


@query("q01_merged_from_polygons", KEY + "avg_precip_mm:d gdd:d",
       """SELECT y.*, w.avg_precip_mm, w.gdd FROM yields y JOIN (
            SELECT state_fips, county_fips, year, avg(total_precip_mm) AS avg_precip_mm, avg(gdd) AS gdd FROM season JOIN located USING (station)
            GROUP BY state_fips, county_fips, year HAVING avg(avg_temp_max_c) IS NOT NULL) w USING (state_fips, county_fips, year)""")
def _(b):
    return etl.build_merged(b.weather, b.yield_report, counties=b.counties, **LIMITS)


# a county with a hole, and an island in it; the hole's edge is outside, the island's as well
_SHAPES = {"outer": ("west", "east", "south", "north")} | {
    name: tuple(f"round({c} * 10 {sign} {step}) / 1e1" for c, sign, step in (("west", "+", x), ("east", "-", x), ("south", "+", y), ("north", "-", y)))
    for name, x, y in (("hole", 5, 4), ("island", 8, 6))
}


def _open(name):
    w, e, lo, hi = _SHAPES[name]
    return f"(longitude > {w} AND longitude < {e} AND latitude > {lo} AND latitude < {hi})"


def _closed(name):
    return _open(name).replace(">", ">=").replace("<", "<=")


@query("j05_counties_with_parts_and_holes", "station:s state_fips:i county_fips:i", f"""SELECT DISTINCT station, state_fips, county_fips FROM wx JOIN county_box
  ON ({_open('outer')} AND NOT {_closed('hole')}) OR {_open('island')} WHERE group_ = 'US'""")
def _(b):
    """Shapes written as a FeatureCollection and read back, joined by the even-odd rule."""
    def ring(name):
        w, e, lo, hi = (F.expr(x) for x in _SHAPES[name])
        return F.array(F.array(w, lo), F.array(e, lo), F.array(e, hi), F.array(w, hi), F.array(w, lo))

    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.create_map(F.lit("STATE"), F.col("state_fips").cast("string"), F.lit("COUNTY"), F.col("county_fips").cast("string"), F.lit("STUSPS"), F.col("stusps")).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring("outer"), ring("hole")), F.array(ring("island"))).alias("coordinates")).alias("geometry"))
    path = fresh_folder(b.spark, "shapes")
    collection = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    b.derived("county_box").select(collection.alias("value")).write.text(path)
    shapes = files.geojson_polygons(b.spark.read.schema(files.GEOJSON_SCHEMA).json(path))
    stations = b.weather.filter(F.col("group_") == "US").select("station", "latitude", "longitude").distinct()
    return geo.points_in_polygons(stations, shapes, ring="rings")


@query("j05_observations_by_cells", "state_fips:i county_fips:i n:i n_stations:i", """SELECT state_fips, county_fips, count(*) AS n, count(DISTINCT station) AS n_stations FROM wx JOIN county_box
  ON longitude > west AND longitude < east AND latitude > south AND latitude < north WHERE group_ = 'US' GROUP BY state_fips, county_fips""")
def _(b):
    """Every observation is placed; stations stand at few points, so the cells are refined and their points dealt."""
    seen = b.weather.filter(F.col("group_") == "US").select("station", "latitude", "longitude")
    placed = cells.points_in_polygons(seen, b.counties, most=2000)
    return placed.groupBy("state_fips", "county_fips").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("station").alias("n_stations"))


@query("j08_map_layer_keeps_empty_counties", "state_fips:i county_fips:i n_rows:i avg_yield:d",
       """SELECT p.state_fips, p.county_fips, n_rows, avg_yield FROM county_box p LEFT JOIN (
            SELECT state_fips, county_fips, count(yield_amount) AS n_rows, avg(yield_amount) AS avg_yield FROM merged
            GROUP BY ALL) a ON p.state_fips = a.state_fips AND p.county_fips = a.county_fips""")
def _(b):
    rows = b.merged.withColumns({"yield_residual": F.lit(0.0), "anomaly_flag": F.lit("")})
    return geo.map_layer(b.counties, reports.map_agg(rows, ["state_fips", "county_fips"]))


# ---- scalar helpers over whole tables

_MESSY = """CASE o_orderkey % 12 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '1.0' WHEN 3 THEN ' Irrigated'
  WHEN 4 THEN ' Non-Irrigated' WHEN 5 THEN '' WHEN 6 THEN 'null' WHEN 7 THEN '2' WHEN 8 THEN '-0.5' WHEN 9 THEN 'YES'
  WHEN 10 THEN 'unknown' ELSE NULL END"""


def _orders(b, **cols):
    return b.table("orders").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                                        *[f"{e} AS {n}" for n, e in cols.items()])


@query("p09_messy_flag", "o_orderkey:i flag:i", f"""SELECT o_orderkey, CASE WHEN w IN ('1','1.0','irrigated','yes','y','true','t') THEN 1
  WHEN w IN ('0','0.0','non-irrigated','non irrigated','no','n','false','f') THEN 0
  WHEN trunc(try_cast(w AS DOUBLE)) >= 1 THEN 1 WHEN trunc(try_cast(w AS DOUBLE)) < 1 THEN 0 END AS flag
  FROM (SELECT o_orderkey, lower(trim({_MESSY})) AS w FROM orders) q""")
def _(b):
    return _orders(b, w=_MESSY).select("o_orderkey", text.norm_flag("w").alias("flag"))


_CROPS = "CASE o_orderkey % 6 WHEN 0 THEN ' CORN' WHEN 1 THEN 'soy ' WHEN 2 THEN 'Soybean' WHEN 3 THEN 'soybeans' WHEN 4 THEN 'wheat' END"


@query("p10_crop_label", "o_orderkey:i crop:s", f"""SELECT o_orderkey, CASE WHEN c = 'corn' THEN 'Corn'
  WHEN c IN ('soy', 'soybean', 'soybeans') THEN 'Soybeans' END AS crop FROM (SELECT o_orderkey, lower(trim({_CROPS})) AS c FROM orders) q""")
def _(b):
    return _orders(b, c=_CROPS).select("o_orderkey", text.norm_crop("c").alias("crop"))


@query("p08_equal_ignoring_case", "c_custkey:i c_mktsegment:s",
       "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) = 'machinery'")
def _(b):
    return b.table("customer").filter(text.eq_ci("c_mktsegment", " Machinery "))


@query("p07_in_list", "o_orderkey:i o_orderpriority:s", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(b):
    return b.table("orders").filter(lookup.in_list("o_orderpriority", ["1-URGENT", "5-LOW"]))


_TEXTS = "CASE o_orderkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN ' 12.5 ' WHEN 2 THEN 'NaN' WHEN 3 THEN cast(o_orderkey AS string) END"


@query("p35_numbers_from_text", "o_orderkey:i v:d w:i", f"""SELECT o_orderkey, coalesce(n, -1) AS v, cast(trunc(coalesce(n, -1)) AS bigint) AS w FROM (
  SELECT o_orderkey, CASE WHEN isnan(try_cast(t AS DOUBLE)) THEN NULL ELSE try_cast(t AS DOUBLE) END AS n
  FROM (SELECT o_orderkey, {_TEXTS} AS t FROM orders) p) q""")
def _(b):
    return _orders(b, t=_TEXTS).select("o_orderkey", numeric.as_num("t", -1).alias("v"), numeric.as_int("t", -1).alias("w"))


@query("p36_p37_geo_keys", "c_custkey:i geoid:s state:s county:s digits:s", """SELECT c_custkey, g AS geoid, substr(g, 1, 2) AS state, substr(g, 3, 3) AS county,
  regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM (
  SELECT *, lpad(cast(c_nationkey AS string), 2, '0') || lpad(cast(c_custkey % 1000 AS string), 3, '0') AS g FROM customer) q""")
def _(b):
    rows = b.table("customer").withColumn("geoid", text.geoid("c_nationkey", F.col("c_custkey") % 1000))
    state, county = text.split_geoid("geoid")
    return rows.select("c_custkey", "geoid", state.alias("state"), county.alias("county"), text.digits_only("c_name").alias("digits"))


@query("p53_safe_ratio", "l_orderkey:i l_linenumber:i ratio:d",
       "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_discount / l_tax ELSE 0 END AS ratio FROM lineitem")
def _(b):
    return b.table("lineitem").select("l_orderkey", "l_linenumber", numeric.safe_div("l_discount", "l_tax").alias("ratio"))


@query("p34_bins", "station:s year:i bin:s", """SELECT station, year, CASE WHEN avg_temp_mean_c < 15 THEN 'cool'
  WHEN avg_temp_mean_c < 21 THEN 'mild' WHEN avg_temp_mean_c < 24 THEN 'warm' ELSE 'hot' END AS bin FROM season""")
def _(b):
    return b.station_seasons.withColumn("bin", numeric.bin_by("avg_temp_mean_c", [15, 21, 24], ["cool", "mild", "warm", "hot"]))


@query("p40_json_payload_round_trip", "event_id:i user_id:i event_type:s k:i",
       "SELECT event_id, user_id, event_type, cast(props->>'$.k' AS bigint) AS k FROM events")
def _(b):
    packed = b.table("events").select(text.to_payload("event_id", "user_id", "event_type", "props").alias("payload"))
    back = packed.select(text.from_payload("payload", "event_id long, user_id long, event_type string, props string").alias("p"))
    return back.select("p.*").withColumn("k", text.from_payload("props", "k long")["k"])


@query("s07_json_map_entries", "key:s n:i total:i",
       "SELECT 'k' AS key, count(*) AS n, sum(cast(props->>'$.k' AS bigint)) AS total FROM events")
def _(b):
    return files.json_map_rows(b.table("events"), "props", "bigint").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# ---- labels on scored rows

_OUTCOME = """CASE WHEN anomaly_flag = 0 THEN 'Normal' WHEN weather_anomaly_flag = 1 AND abs(residual_zscore) < 2 THEN 'Extreme Weather Model Handled'
  WHEN weather_anomaly_flag = 0 AND abs(residual_zscore) >= 2 THEN 'Yield Mismatch / Unexplained' ELSE 'Extreme Weather Yield Impact' END"""


@query("p27_outcome_category", KEY + "outcome_category:s", f"""SELECT {KEYS}, {_OUTCOME} AS outcome_category FROM (
  SELECT * REPLACE (CASE WHEN (state_fips + year) % 17 = 0 THEN NULL ELSE anomaly_flag END AS anomaly_flag) FROM scored) q""")
def _(b):
    rows = b.scored.withColumn("anomaly_flag", F.expr("CASE WHEN (state_fips + year) % 17 = 0 THEN NULL ELSE anomaly_flag END"))
    return rows.withColumn("outcome_category", labels.outcome_category("anomaly_flag", "weather_anomaly_flag", "residual_zscore"))


@query("p28_anomaly_type", KEY + "anomaly_type:s", f"""SELECT {KEYS}, CASE
  WHEN anomaly_flag = 1 AND weather_anomaly_flag = 1 THEN 'Extreme Weather → Yield Impact'
  WHEN anomaly_flag = 1 THEN 'Yield Mismatch (unexplained)' WHEN weather_anomaly_flag = 1 THEN 'Extreme Weather (model handled)'
  ELSE 'Normal' END AS anomaly_type FROM scored""")
def _(b):
    return b.scored


@query("p30_p32_signal_labels", KEY + "yield_category:s weather_yield_mismatch:s",
       f"SELECT {KEYS}, yield_category, weather_yield_mismatch FROM signal_labels")
def _(b):
    return b.signals


@query("p31_yield_category_by_crop", KEY + "c:s", f"""SELECT {KEYS}, CASE WHEN commodity = 'Corn' THEN
    CASE WHEN yield_amount >= 180 THEN 'excellent' WHEN yield_amount >= 150 THEN 'good' WHEN yield_amount >= 110 THEN 'average' ELSE 'poor' END
  ELSE CASE WHEN yield_amount >= 55 THEN 'excellent' WHEN yield_amount >= 45 THEN 'good' WHEN yield_amount >= 35 THEN 'average' ELSE 'poor' END
  END AS c FROM merged""")
def _(b):
    return b.merged.withColumn("c", labels.yield_category_abs("yield_amount", "commodity"))


_EVENT = "CASE WHEN drought_flag = 1 THEN 'Drought' WHEN flood_flag = 1 THEN 'Flood' WHEN extreme_heat_flag = 1 THEN 'Extreme Heat' ELSE 'Normal' END"


@query("p33_event_label", "state_fips:i county_fips:i year:i event:s", f"SELECT state_fips, county_fips, year, {_EVENT} AS event FROM county")
def _(b):
    return b.county_weather.withColumn("event", labels.event_label("drought_flag", "flood_flag", "extreme_heat_flag"))


@query("p25_s09_region_lookup", "state_fips:i county_fips:i year:i scoring:s training:s summary:s map:s",
       f"""SELECT state_fips, county_fips, year, {region_sql('scoring', 'stusps')} AS scoring, {region_sql('training', 'stusps')} AS training,
         {region_sql('summary', 'stusps')} AS summary, {region_sql('map', 'stusps')} AS map FROM county""")
def _(b):
    out = b.county_weather
    for name, default in (("scoring", "midwest"), ("training", "Other"), ("summary", "Other"), ("map", "Other US")):
        out = features.with_region(out, region_table(b.spark, name), default, state="stusps", name=name)
    return out


@query("p25_region_from_tables", "state_fips:i county_fips:i year:i region:s",
       "SELECT c.*, coalesce(region, 'none') AS region FROM county c LEFT JOIN region_of_state r ON c.stusps = r.state_abbr")
def _(b):
    return features.with_region(b.county_weather, b.derived("region_of_state"), "none", state="stusps")


# ---- features

CORE = [c for c in features.CORE_FEATURES]


def feature_sql(flood: bool) -> dict[str, str]:
    ev = "(drought_flag + extreme_heat_flag)"
    return {
        "is_irrigated": "CASE WHEN trim(irrigation) = 'Irrigated' THEN 1 ELSE 0 END",
        "temp_range": "avg_temp_max_c - avg_temp_min_c", "temp_stress_index": "peak_temp_max_c * heat_stress_days",
        "optimal_temp_score": "-abs(avg_temp_mean_c - 22.5)", "precip_cv": "precip_std_mm / (avg_precip_mm + 1)",
        "heat_dry_combo": "heat_stress_days * dry_days",
        "extreme_events": "drought_flag + extreme_heat_flag" + (" + flood_flag" if flood else ""),
        "gdd_precip": "gdd * avg_precip_mm", "gdd_per_precip": "gdd / (avg_precip_mm + 1)", "year_trend": "year - 2010",
        "year_x_precip": "(year - 2010) * avg_precip_mm", "year_x_heat": "(year - 2010) * heat_stress_days",
        "peak_vs_mean_temp": "peak_temp_max_c - avg_temp_mean_c", "peak_temp_sq": "peak_temp_max_c * peak_temp_max_c",
        "log_heat_days": "ln(1 + heat_stress_days)", "temprange_x_heat": "(avg_temp_max_c - avg_temp_min_c) * heat_stress_days",
        "peak_x_heat": "peak_temp_max_c * heat_stress_days", "extreme_x_precip": "extreme_heat_flag * avg_precip_mm",
        "gdd_x_heat": "gdd * heat_stress_days", "gdd_x_precip": "gdd * avg_precip_mm", "precip_x_snow": "avg_precip_mm * snow_days",
        "extreme_x_dry": f"{ev} * dry_days", "gdd_x_extreme": f"gdd * {ev}",
        "stress_gdd_ratio": "heat_stress_days * peak_temp_max_c / (gdd + 1)", "cool_moist": "(50 - avg_temp_min_c) * avg_precip_mm",
        "gdd_precip_heat": "gdd * avg_precip_mm / (heat_stress_days + 1)", "year_x_extreme": f"(year - 2010) * {ev}",
        "is_corn": "CASE WHEN commodity = 'Corn' THEN 1 ELSE 0 END",
        "corn_x_gdd": "CASE WHEN commodity = 'Corn' THEN gdd ELSE gdd * 0 END",
        "corn_x_precip": "CASE WHEN commodity = 'Corn' THEN avg_precip_mm ELSE avg_precip_mm * 0 END",
        "corn_x_heat": "CASE WHEN commodity = 'Corn' THEN heat_stress_days ELSE 0 END",
        "corn_x_drought": "CASE WHEN commodity = 'Corn' THEN drought_flag ELSE 0 END",
        "corn_x_extreme": f"CASE WHEN commodity = 'Corn' THEN {ev} ELSE 0 END",
    }


_RAW = {"avg_temp_max_c", "avg_temp_mean_c", "peak_temp_max_c", "heat_stress_days", "frost_days", "avg_precip_mm", "dry_days",
        "heavy_rain_days", "winter_snowfall_mm", "snow_days", "drought_flag", "extreme_heat_flag", "flood_flag", "gdd"}


def _feature_query(names, flood):
    made = feature_sql(flood)
    return f"SELECT {KEYS}, {', '.join(n if n in _RAW else f'{made[n]} AS {n}' for n in names)} FROM merged"


def _spec(names):
    return KEY + " ".join(f"{n}:d" for n in names)


_CORE_SQL = _feature_query(CORE, True)


@query("p41_features_core", _spec(CORE), _CORE_SQL)
def _(b):
    return features.features_core(b.merged)


MID = CORE[:-1] + [
    "peak_vs_mean_temp", "peak_temp_sq", "log_heat_days", "temprange_x_heat", "peak_x_heat", "extreme_x_precip", "gdd_x_heat",
    "gdd_x_precip", "precip_x_snow", "extreme_x_dry", "gdd_x_extreme", "stress_gdd_ratio", "cool_moist", "gdd_precip_heat",
    "year_x_extreme", "is_irrigated",
]
WIDE = MID[:-1] + ["is_corn", "corn_x_gdd", "corn_x_precip", "corn_x_heat", "corn_x_drought", "corn_x_extreme"]


@query("p42_features_wide", _spec(WIDE), _feature_query(WIDE, False))
def _(b):
    return features.features_wide(b.merged)


@query("p43_features_mid", _spec(MID), _feature_query(MID, False))
def _(b):
    return features.features_mid(b.merged)


_PAIRS = [f"{a}_x_{c}" for a, c in features.STRESS_PAIRS]


@query("p44_stress_interactions", _spec(_PAIRS),
       f"SELECT {KEYS}, {', '.join(f'{a} * {c} AS {a}_x_{c}' for a, c in features.STRESS_PAIRS)} FROM merged")
def _(b):
    return features.interactions(b.merged)


@query("p45_season_ratios", "station:s year:i diurnal_range_c:d precip_per_day_mm:d pct_dry_days:d avg_temp_mean_f:d",
       """SELECT station, year, avg_temp_max_c - avg_temp_min_c AS diurnal_range_c, total_precip_mm / obs_count_growing AS precip_per_day_mm,
          dry_days * 1e2 / obs_count_growing AS pct_dry_days, avg_temp_mean_c * 1.8e0 + 32 AS avg_temp_mean_f FROM season""")
def _(b):
    return features.season_ratios(b.station_seasons, observed="obs_count_growing")


# ---- trends, baselines, imputation

check_table("yearly", "SELECT commodity, state_abbr, year, avg(yield_amount) AS y FROM merged GROUP BY ALL")
check_table("trend_lines", """SELECT commodity, state_abbr, count(*) AS n_years, CASE WHEN count(*) >= 3 THEN regr_intercept(y, year) END AS intercept,
  CASE WHEN count(*) >= 3 THEN regr_slope(y, year) END AS slope FROM yearly GROUP BY ALL""")
check_table("crop_lines", """SELECT commodity, regr_intercept(yield_amount, year) AS intercept, regr_slope(yield_amount, year) AS slope
  FROM merged GROUP BY commodity""")
check_table("train_rows", f"SELECT * FROM merged WHERE year < {TEST_FROM}")


@query("a18_state_trend", "commodity:s state_abbr:s n_years:i intercept:d3 slope:d", "SELECT * FROM trend_lines")
def _(b):
    return features.state_trend(b.merged)


_ROW_LINE = """SELECT commodity, state_abbr, CASE WHEN count(*) < 3 OR var_pop(year) = 0 THEN avg(yield_amount) ELSE regr_intercept(yield_amount, year) END AS intercept,
  CASE WHEN count(*) < 3 OR var_pop(year) = 0 THEN 0 ELSE regr_slope(yield_amount, year) END AS slope"""


@query("a18_state_trend_rows", "commodity:s state_abbr:s intercept:d3 slope:d", f"{_ROW_LINE} FROM train_rows GROUP BY ALL")
def _(b):
    return features.state_trend_rows(b.merged.filter(F.col("year") < TEST_FROM))


@query("a18_global_line", "commodity:s intercept:d3 slope:d", "SELECT * FROM crop_lines")
def _(b):
    return features.global_line(b.merged)


# lines of two thirds of the states, so that rows of the others take the crop's fixed line
_THIRD = "ascii(substr(state_abbr, 2, 1)) % 3"


@query("p46_j07_trend_value", KEY + "trend:d4", f"""SELECT m.*, coalesce(t.intercept + t.slope * year, CASE WHEN commodity = 'Corn' THEN 130e0 + 22e-1 * (year - 2010)
    ELSE 36e0 + 55e-2 * (year - 2010) END) AS trend
  FROM merged m LEFT JOIN (SELECT * FROM trend_lines WHERE {_THIRD} <> 0) t USING (commodity, state_abbr)""")
def _(b):
    trend = features.state_trend(b.merged).filter(f"{_THIRD} <> 0")
    return features.trend_value(b.merged, trend, features.fixed_lines(b.spark), origin=features.FIXED_ORIGIN)


@query("m05_detrend", KEY + "trend:d4 yield_anomaly:d4", f"""WITH t AS ({_ROW_LINE} FROM train_rows GROUP BY ALL),
  g AS (SELECT commodity, regr_intercept(yield_amount, year) AS gi, regr_slope(yield_amount, year) AS gs FROM train_rows GROUP BY commodity)
  SELECT *, yield_amount - trend AS yield_anomaly FROM (
    SELECT m.*, coalesce(t.intercept + t.slope * year, gi + gs * year) AS trend FROM merged m
    LEFT JOIN t USING (commodity, state_abbr) LEFT JOIN g USING (commodity)) q""")
def _(b):
    merged = b.merged
    return features.detrend(merged, merged.filter(F.col("year") < TEST_FROM))


@query("a19_state_baselines", "commodity:s state_abbr:s state_baseline:d",
       "SELECT commodity, state_abbr, quantile_cont(yield_amount, 0.5) AS state_baseline FROM merged GROUP BY ALL")
def _(b):
    return features.baselines(b.merged)[0]


@query("a19_county_baselines", "commodity:s state_fips:i county_fips:i county_baseline:d",
       "SELECT commodity, state_fips, county_fips, quantile_cont(yield_amount, 0.5) AS county_baseline FROM merged GROUP BY ALL")
def _(b):
    return features.baselines(b.merged)[1]


# training rows of most counties, so that the others fall back
_KEPT = "(state_fips * 5 + county_fips * 3) % 4 <> 0 AND state_fips % 6 <> 0"


@query("j06_baseline_lookup", KEY + "state_baseline:d county_baseline:d", f"""SELECT m.*, coalesce(s, g) AS state_baseline, coalesce(c, s, g) AS county_baseline FROM merged m
  LEFT JOIN (SELECT state_abbr, avg(yield_amount) AS s FROM train_rows WHERE {_KEPT} GROUP BY ALL) USING (state_abbr)
  LEFT JOIN (SELECT state_fips, county_fips, avg(yield_amount) AS c FROM train_rows WHERE {_KEPT} GROUP BY ALL) USING (state_fips, county_fips)
  , (SELECT avg(yield_amount) AS g FROM train_rows WHERE {_KEPT})""")
def _(b):
    merged = b.merged
    return features.with_baselines(merged, merged.filter(f"year < {TEST_FROM} AND {_KEPT}"))


@query("j06_anomaly_baselines", KEY + "state_baseline:d county_baseline:d", f"""WITH t AS (SELECT * FROM train_rows WHERE {_KEPT})
  SELECT m.*, coalesce(s, 0) AS state_baseline, coalesce(c, 0) AS county_baseline FROM merged m
  LEFT JOIN (SELECT commodity, state_abbr, avg(yield_amount) AS s FROM t GROUP BY ALL) USING (commodity, state_abbr)
  LEFT JOIN (SELECT commodity, state_fips, county_fips, avg(yield_amount) AS c FROM t GROUP BY ALL) USING (commodity, state_fips, county_fips)""")
def _(b):
    merged = b.merged
    return features.with_baselines(merged, merged.filter(f"year < {TEST_FROM} AND {_KEPT}"), by=["commodity"], fallback=0.0)


_GAPPY = {"avg_temp_mean_c": f"{SALT} % 7 = 0", "avg_precip_mm": f"{SALT} % 11 = 0", "snow_days": f"{SALT} % 5 = 0"}
check_table("gappy", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {w} THEN NULL ELSE {c} END AS {c}" for c, w in _GAPPY.items()) + ") FROM merged")


@query("a23_impute", KEY + "avg_temp_mean_c:d avg_precip_mm:d snow_days:d", """SELECT * REPLACE (
  coalesce(avg_temp_mean_c, quantile_cont(avg_temp_mean_c, 0.5) OVER (PARTITION BY commodity, state_abbr)) AS avg_temp_mean_c,
  coalesce(avg_precip_mm, (SELECT quantile_cont(avg_precip_mm, 0.5) FROM gappy)) AS avg_precip_mm, coalesce(snow_days, 0) AS snow_days) FROM gappy""")
def _(b):
    gappy = b.merged.withColumns({c: F.expr(f"CASE WHEN {w} THEN NULL ELSE {c} END") for c, w in _GAPPY.items()})
    return features.impute(gappy)


_EST = {c: features.ESTIMATE[c] for c in ("corn", "soybeans")}


def _by_crop(i):
    return f"CASE WHEN commodity = 'Corn' THEN {getattr(_EST['corn'], i)}::DOUBLE ELSE {getattr(_EST['soybeans'], i)}::DOUBLE END"


check_table("estimated", f"""SELECT *, greatest(1, round_even(base + 0.35::DOUBLE * (trend - base) - abs(gdd - {_by_crop('gdd_optimum')}) * {_by_crop('gdd')}
    + CASE WHEN trim(irrigation) = 'Irrigated' THEN {_by_crop('irrigation')} ELSE 0 END
    - greatest(0, heat_stress_days - 6) * {_by_crop('heat')} - greatest(0, 220 - avg_precip_mm) * {_by_crop('drought')}
    - greatest(0, heavy_rain_days - 5) * {_by_crop('flood')}, 1)) AS predicted_yield FROM (
  SELECT m.*, t.intercept + t.slope * year AS trend, CASE WHEN cb > 0 THEN cb WHEN sb > 0 THEN sb ELSE t.intercept + t.slope * year END AS base
  FROM merged m JOIN trend_lines t USING (commodity, state_abbr)
  JOIN (SELECT commodity, state_abbr, quantile_cont(yield_amount, 0.5) AS sb FROM merged GROUP BY ALL) USING (commodity, state_abbr)
  JOIN (SELECT commodity, state_fips, county_fips, quantile_cont(yield_amount, 0.5) AS cb FROM merged GROUP BY ALL) USING (commodity, state_fips, county_fips)) q""")


def estimate_inputs(b):
    """Merged rows with trend and median baselines, as the rule-based estimate needs them."""
    merged = b.merged
    trend = features.trend_value(merged, features.state_trend(merged), features.global_line(merged))
    state, county = features.baselines(merged)
    rows = trend.join(state, ["commodity", "state_abbr"], "left").join(county, ["commodity", "state_fips", "county_fips"], "left")
    return features.features_core(rows, include_flood=False)


@query("p47_rule_based_estimate", KEY + "predicted_yield:d1", "SELECT * FROM estimated")
def _(b):
    return features.heuristic_yield(estimate_inputs(b))


@query("p48_blend", KEY + "blended:d", f"SELECT {KEYS}, 0.6::DOUBLE * yield_amount + 0.4::DOUBLE * pred_yield AS blended FROM scored")
def _(b):
    return b.scored.withColumn("blended", numeric.blend(["yield_amount", "pred_yield"], [0.6, 0.4]))


_CENTRES = " ".join(f"WHEN '{s}' THEN {la}::DOUBLE" for s, (la, lo) in geo.STATE_CENTRES.items())
_CENTRES_LON = " ".join(f"WHEN '{s}' THEN {lo}::DOUBLE" for s, (la, lo) in geo.STATE_CENTRES.items())
_APPROX = f"""CASE state_abbr {_CENTRES} ELSE 39.8283::DOUBLE END + ((county_fips % 9) - 4) * 0.11::DOUBLE AS lat,
  CASE state_abbr {_CENTRES_LON} ELSE -98.5795::DOUBLE END + ((county_fips // 9 % 9) - 4) * 0.14::DOUBLE AS lon"""


@query("p49_approximate_coordinates", "c_custkey:i lat:d lon:d", f"""SELECT c_custkey, {_APPROX} FROM (
  SELECT c_custkey, substr('IAILINNEMNMOKSNDSDOHWIMIKYTNARALMSLATXOKNCSCVAGACO', c_nationkey * 2 + 1, 2) AS state_abbr, c_custkey % 200 AS county_fips FROM customer) q""")
def _(b):
    rows = b.table("customer").selectExpr(
        "c_custkey", "substr('IAILINNEMNMOKSNDSDOHWIMIKYTNARALMSLATXOKNCSCVAGACO', c_nationkey * 2 + 1, 2) AS state_abbr",
        "c_custkey % 200 AS county_fips")
    return geo.approx_coords(rows)


@query("j09_attach_centroids", "state_fips:i county_fips:i lat:d lon:d", """SELECT a.state_fips, a.county_fips, (south + north) / 2e0 AS lat, (west + east) / 2e0 AS lon
  FROM (SELECT DISTINCT state_fips, county_fips FROM merged) a JOIN county_box USING (state_fips, county_fips)""")
def _(b):
    boxes = b.derived("county_box").select(
        text.geoid("state_fips", "county_fips").alias("geoid"), ((F.col("south") + F.col("north")) / 2).alias("lat"),
        ((F.col("west") + F.col("east")) / 2).alias("lon"))
    return geo.attach_centroids(b.merged.select("state_fips", "county_fips", "state_abbr").distinct(), boxes)


@query("j09_centroids_below_match_rate", "state_fips:i county_fips:i lat:d lon:d",
       f"SELECT state_fips, county_fips, {_APPROX} FROM (SELECT DISTINCT state_fips, county_fips, state_abbr FROM merged) q")
def _(b):
    few = b.derived("county_box").filter("state_fips < 3").select(
        text.geoid("state_fips", "county_fips").alias("geoid"), F.col("south").alias("lat"), F.col("west").alias("lon"))
    return geo.attach_centroids(b.merged.select("state_fips", "county_fips", "state_abbr").distinct(), few, geo.MIN_MATCH)


@query("p50_delta_and_direction", KEY + "delta_gdd:d words:s", f"""SELECT {KEYS}, d AS delta_gdd,
  CASE WHEN d IS NULL THEN 'GDD was unavailable' WHEN round(d) > 0 THEN 'GDD was above the mean by ' || cast(abs(round(d)) AS bigint) || '.00'
    WHEN round(d) < 0 THEN 'GDD was below the mean by ' || cast(abs(round(d)) AS bigint) || '.00' ELSE 'GDD was close to the mean' END AS words
  FROM (SELECT *, gdd - avg(gdd) OVER (PARTITION BY year) AS d FROM merged) q""")
def _(b):
    rows = features.delta_vs_mean(b.merged, ["gdd"], ["year"])
    return rows.withColumn("words", features.direction_words(F.round("delta_gdd", 0), "GDD", "mean"))


@query("p52_residuals", KEY + "signed_residual:d abs_residual:d",
       f"SELECT {KEYS}, yield_amount - pred_yield AS signed_residual, abs(yield_amount - pred_yield) AS abs_residual FROM scored")
def _(b):
    return features.residuals(b.predicted)


# ---- z-scores and flags

@query("w01_w02_q04_signal_table", KEY + "yield_mean:d yield_std:d yield_zscore:d temp_clim_mean:d temp_clim_std:d temp_anomaly_z:d "
       "precip_clim_mean:d precip_clim_std:d precip_anomaly_z:d yield_category:s weather_yield_mismatch:s", "SELECT * FROM signal_labels")
def _(b):
    return b.signals


@query("w03_zscore_flag", KEY + "yield_zscore:d anomaly_flag_zscore:s", f"""SELECT {KEYS}, z AS yield_zscore,
  CASE WHEN z > 1.5 THEN 'high_z' WHEN z < -1.5 THEN 'low_z' ELSE '' END AS anomaly_flag_zscore FROM (
  SELECT *, CASE WHEN stddev_samp(yield_amount) OVER w > 0 THEN (yield_amount - avg(yield_amount) OVER w) / stddev_samp(yield_amount) OVER w END AS z
  FROM merged WINDOW w AS (PARTITION BY state_fips, county_fips, commodity)) q""")
def _(b):
    return anomalies.zscore_flag(b.merged, limit=1.5)


@query("w04_residual_z", KEY + "residual:d residual_zscore:d anomaly_flag:i",
       f"SELECT {KEYS}, residual, residual_zscore, anomaly_flag FROM scored")
def _(b):
    return anomalies.residual_z(b.predicted)


@query("w05_weather_extremity", KEY + "weather_extremity:d weather_anomaly_flag:i",
       f"SELECT {KEYS}, weather_extremity, weather_anomaly_flag FROM scored")
def _(b):
    return anomalies.weather_extremity(b.merged)


@query("w06_overall_residual_flags", KEY + "yield_residual_z:d anomaly_flag:s", f"SELECT {KEYS}, yield_residual_z, anomaly_flag FROM study")
def _(b):
    return b.study


@query("w07_group_mean_beside_row", KEY + "m:d delta:d", f"""SELECT {KEYS}, avg(gdd) OVER (PARTITION BY year, commodity) AS m,
  gdd - avg(gdd) OVER (PARTITION BY year, commodity) AS delta FROM merged""")
def _(b):
    return grouping.with_group_stats(b.merged, ["year", "commodity"], {"m": F.avg("gdd")}).withColumn("delta", F.col("gdd") - F.col("m"))


@query("m12_holdout_flags", KEY + "yield_residual_z:d anomaly_flag:s", f"""SELECT {KEYS}, CASE WHEN s > 0 THEN (yield_residual - m) / s END AS yield_residual_z,
  CASE WHEN split = 'train' THEN '' WHEN yield_residual > 2 * s THEN 'high_yield_vs_weather' WHEN yield_residual < -2 * s THEN 'low_yield_vs_weather' ELSE '' END AS anomaly_flag
  FROM (SELECT *, avg(yield_residual) FILTER (split = 'train') OVER () AS m, stddev_pop(yield_residual) FILTER (split = 'train') OVER () AS s
    FROM (SELECT *, CASE WHEN (state_fips * 10 + county_fips) * 37 % 1000 < 200 THEN 'test' ELSE 'train' END AS split FROM study) p) q""")
def _(b):
    number = (F.col("state_fips") * 10 + F.col("county_fips")) * 37
    return anomalies.holdout_flags(splits.entity_split(b.study, number=number))


# ---- driver reports

_DRY = "trim(irrigation) = 'Non-Irrigated'"
_SIGNS = "SELECT *, avg_temp_max_c - avg_temp_min_c AS diurnal_range_c FROM signal_labels"


def _report(name):
    return lambda b: studies.drivers_report(b.signals, drought_years=(1996, 1997, 1998), flood_years=(1998, 1999, 2000), only=[name])[name]


def _corr_sql(x: str, y: str = "yield_amount") -> str:
    return f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({y}, {x}) END"


query("a13_mismatch_summary", "weather_yield_mismatch:s commodity:s occurrences:i states:i counties:i avg_yield:d avg_temp:d avg_precip:d avg_heat_days:d",
      """SELECT weather_yield_mismatch, commodity, count(*) AS occurrences, count(DISTINCT state_abbr) AS states, count(DISTINCT county_name) AS counties,
         round(avg(yield_amount), 1) AS avg_yield, round(avg(avg_temp_mean_c), 1) AS avg_temp, round(avg(avg_precip_mm), 0) AS avg_precip,
         round(avg(heat_stress_days), 1) AS avg_heat_days FROM signal_labels GROUP BY ALL""")(_report("mismatch_summary"))
query("q05_mismatch_rows", "state_abbr:s county_name:s commodity:s year:i yield:d yield_category:s avg_temp_c:d precip_mm:d heat_days:d yield_z:d temp_z:d precip_z:d weather_yield_mismatch:s",
      """SELECT *, round(yield_amount, 1) AS yield, round(avg_temp_mean_c, 1) AS avg_temp_c, round(avg_precip_mm, 0) AS precip_mm,
         round(heat_stress_days, 0) AS heat_days, round(yield_zscore, 2) AS yield_z, round(temp_anomaly_z, 2) AS temp_z, round(precip_anomaly_z, 2) AS precip_z
         FROM signal_labels WHERE weather_yield_mismatch <> 'CONSISTENT'""")(_report("mismatches"))
query("a14_event_impact", "commodity:s weather_event:s n:i avg_yield:d avg_yield_zscore:d avg_precip_mm:d avg_heat_days:d avg_gdd:d",
      f"""SELECT commodity, {_EVENT} AS weather_event, count(*) AS n, round(avg(yield_amount), 1) AS avg_yield, round(avg(yield_zscore), 2) AS avg_yield_zscore,
         round(avg(s.avg_precip_mm), 0) AS avg_precip_mm, round(avg(heat_stress_days), 1) AS avg_heat_days, round(avg(gdd), 0) AS avg_gdd
         FROM signal_labels s GROUP BY commodity, {_EVENT}""")(_report("event_impact"))
query("a12_drought_check", "state_abbr:s year:i commodity:s counties:i avg_yield:d avg_yield_z:d avg_temp:d avg_precip:d heat_days:d drought_counties:i",
      """SELECT state_abbr, year, commodity, count(*) AS counties, round(avg(yield_amount), 1) AS avg_yield, round(avg(yield_zscore), 2) AS avg_yield_z,
         round(avg(avg_temp_mean_c), 1) AS avg_temp, round(avg(avg_precip_mm), 0) AS avg_precip, round(avg(heat_stress_days), 1) AS heat_days,
         sum(drought_flag) AS drought_counties FROM signal_labels WHERE state_abbr IN ('IA','IL','IN','NE','MN') AND year IN (1996, 1997, 1998)
         AND commodity = 'Corn' GROUP BY state_abbr, year, commodity""")(_report("drought_check"))
query("a12_flood_check", "state_abbr:s year:i commodity:s counties:i avg_yield:d avg_precip:d heavy_rain_days:d flood_counties:i",
      """SELECT state_abbr, year, commodity, count(*) AS counties, round(avg(yield_amount), 1) AS avg_yield, round(avg(avg_precip_mm), 0) AS avg_precip,
         round(avg(s.heavy_rain_days), 1) AS heavy_rain_days, sum(flood_flag) AS flood_counties FROM signal_labels s
         WHERE state_abbr IN ('IA','IL','IN','NE','MN') AND year IN (1998, 1999, 2000) AND commodity = 'Corn' GROUP BY state_abbr, year, commodity""")(_report("flood_check"))
query("a22_correlation_table", "commodity:s " + " ".join(f"{n}:d" for n in studies.CORR_NAMES),
      f"SELECT commodity, {', '.join(f'round({_corr_sql(f)}, 3) AS {n}' for n, f in studies.CORR_NAMES.items())} FROM ({_SIGNS}) q WHERE {_DRY} GROUP BY commodity")(_report("correlations"))
query("a22_correlation_rank", "commodity:s feature:s correlation:d abs_correlation:d",
      " UNION ALL ".join(f"SELECT commodity, '{f}' AS feature, round({_corr_sql(f)}, 4) AS correlation, abs({_corr_sql(f)}) AS abs_correlation FROM signal_labels GROUP BY commodity"
                         for f in studies.RANKED_FEATURES))(_report("correlation_rank"))
_CORN = f"SELECT * FROM signal_labels WHERE commodity = 'Corn' AND {_DRY}"


def _bins(col, edges, names, op="<"):
    return "CASE " + " ".join(f"WHEN {col} {op} {e} THEN '{n}'" for e, n in zip(edges, names)) + f" ELSE '{names[-1]}' END"


query("a15_response_by_temperature", "temp_bin:s n:i avg_yield:d yield_std:d avg_heat_days:d avg_precip:d",
      f"""SELECT {_bins('avg_temp_mean_c', *reports.TEMP_BINS)} AS temp_bin, count(*) AS n, round(avg(yield_amount), 1) AS avg_yield,
         round(stddev_samp(yield_amount), 1) AS yield_std, round(avg(heat_stress_days), 1) AS avg_heat_days, round(avg(avg_precip_mm), 0) AS avg_precip FROM ({_CORN}) q GROUP BY 1""")(_report("by_temperature"))
query("a15_response_by_rain", "precip_bin:s n:i avg_yield:d yield_std:d avg_heat_days:d",
      f"""SELECT {_bins('avg_precip_mm', *reports.RAIN_BINS)} AS precip_bin, count(*) AS n, round(avg(yield_amount), 1) AS avg_yield,
         round(stddev_samp(yield_amount), 1) AS yield_std, round(avg(heat_stress_days), 1) AS avg_heat_days FROM ({_CORN}) q GROUP BY 1""")(_report("by_rain"))
query("a15_j13_response_by_heat", "heat_stress_bin:s n:i avg_yield:d yield_vs_avg:d avg_precip:d",
      f"""SELECT {_bins('heat_stress_days', *reports.HEAT_BINS, op='<=')} AS heat_stress_bin, count(*) AS n, round(avg(yield_amount), 1) AS avg_yield,
         round(avg(yield_amount) - (SELECT avg(yield_amount) FROM ({_CORN}) o), 1) AS yield_vs_avg, round(avg(avg_precip_mm), 0) AS avg_precip FROM ({_CORN}) q GROUP BY 1""")(_report("by_heat"))
query("a16_state_year_heatmap", "state_abbr:s year:i commodity:s counties:i avg_yield:d avg_yield_z:d avg_temp_c:d avg_precip_mm:d heat_stress_days:d gdd:d drought_counties:i flood_counties:i",
      f"""SELECT state_abbr, year, commodity, count(DISTINCT county_name) AS counties, round(avg(yield_amount), 1) AS avg_yield, round(avg(yield_zscore), 2) AS avg_yield_z,
         round(avg(avg_temp_mean_c), 1) AS avg_temp_c, round(avg(q.avg_precip_mm), 0) AS avg_precip_mm, round(avg(q.heat_stress_days), 1) AS heat_stress_days, round(avg(q.gdd), 0) AS gdd,
         sum(drought_flag) AS drought_counties, sum(flood_flag) AS flood_counties FROM ({_CORN}) q WHERE state_abbr IN ('IA','IL','IN','NE','MN') GROUP BY state_abbr, year, commodity""")(_report("heatmap"))
_BELT = "state_abbr IN ('IA','IL','IN','NE','MN')"
query("a17_event_pivot", "year:i " + " ".join(f"{n}:d" for n in reports.EVENT_PIVOT),
      "SELECT year, " + ", ".join(f"round(avg({'avg_precip_mm' if c == 'total_precip_mm' else c}) FILTER ({_BELT} AND commodity = '{crop}'), {d}) AS {n}"
                                  for n, (crop, c, d) in reports.EVENT_PIVOT.items()) + f" FROM signal_labels WHERE {_DRY} GROUP BY year")(_report("event_pivot"))


@query("j13_group_versus_overall", "commodity:s state_abbr:s group_mean:d overall_mean:d difference:d",
       """SELECT commodity, state_abbr, avg(yield_amount) AS group_mean, (SELECT avg(yield_amount) FROM merged) AS overall_mean,
          avg(yield_amount) - (SELECT avg(yield_amount) FROM merged) AS difference FROM merged GROUP BY commodity, state_abbr""")
def _(b):
    return reports.vs_overall(b.merged, ["commodity", "state_abbr"], "yield_amount")


_PROFILED = ["yield_amount", "avg_temp_max_c", "avg_temp_min_c", "gdd", "snow_days", "pred_yield"]


@query("a20_null_profile", "column_name:s n_null:i",
       " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM scored" for c in _PROFILED))
def _(b):
    return correlations.null_profile(b.predicted, _PROFILED)


@query("a21_range_profile", "column_name:s min_value:d max_value:d",
       " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c}) AS min_value, max({c}) AS max_value FROM merged" for c in ("state_fips", "county_fips", "year", "gdd")))
def _(b):
    return correlations.range_profile(b.merged, ["state_fips", "county_fips", "year", "gdd"])


_GROUP_CASE = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in fs)}) THEN '{g}'" for g, fs in DRIVER_GROUPS.items()) + " ELSE 'Other' END"
_RANKS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round({_corr_sql(f)}, 4) AS correlation, round(abs({_corr_sql(f)}), 9) AS abs_correlation FROM merged" for f in features.WEATHER_FEATURES)


@query("p26_a22_driver_groups", "feature:s correlation:d abs_correlation:d driver_group:s", f"SELECT *, {_GROUP_CASE} AS driver_group FROM ({_RANKS}) q")
def _(b):
    ranks = correlations.corr_rank(b.merged, "yield_amount", features.WEATHER_FEATURES)
    return correlations.driver_group(ranks.withColumn("abs_correlation", F.round("abs_correlation", 9)), driver_table(b.spark))


@query("m15_driver_summary", "driver_group:s position:i feature:s", f"""SELECT * FROM (SELECT driver_group, feature,
  row_number() OVER (PARTITION BY driver_group ORDER BY abs_correlation DESC NULLS LAST, feature) AS position
  FROM (SELECT *, {_GROUP_CASE} AS driver_group FROM ({_RANKS}) q) r) s WHERE position <= 3""")
def _(b):
    ranks = correlations.corr_rank(b.merged, "yield_amount", features.WEATHER_FEATURES)
    grouped = correlations.driver_group(ranks.withColumn("abs_correlation", F.round("abs_correlation", 9)), driver_table(b.spark))
    return correlations.driver_summary(grouped, "abs_correlation")


# ---- splits

@query("m01_entity_split", KEY + "split:s", f"SELECT {KEYS}, CASE WHEN (state_fips * 10 + county_fips) * 37 % 1000 < 200 THEN 'test' ELSE 'train' END AS split FROM merged")
def _(b):
    return splits.entity_split(b.merged, number=(F.col("state_fips") * 10 + F.col("county_fips")) * 37)


@query("m02_time_split", KEY + "is_test:b", f"SELECT {KEYS}, year >= {TEST_FROM} AS is_test FROM merged")
def _(b):
    return splits.time_split(b.merged, TEST_FROM)


@query("m03_group_kfold", KEY + "fold:i", f"SELECT {KEYS}, (state_fips * 10 + county_fips) % 5 AS fold FROM merged")
def _(b):
    return splits.group_kfold(b.merged, number=F.col("state_fips") * 10 + F.col("county_fips"))


@query("m04_walk_forward_folds", "fold:i cutoff:i test_year:i", f"""WITH y AS (SELECT DISTINCT year FROM merged),
  t AS (SELECT year, row_number() OVER (ORDER BY year) AS k FROM y WHERE year < {PREDICT_FROM}),
  w AS (SELECT count(*) AS w FROM y WHERE year >= {PREDICT_FROM}), n AS (SELECT count(*) AS n FROM t)
  SELECT a.k - greatest(n - w + 1 - 3, 0) AS fold, a.year AS cutoff, z.year AS test_year FROM t a, w, n, t z
  WHERE a.k <= n - w + 1 AND a.k > n - w + 1 - 3 AND z.k >= a.k AND z.k < a.k + w""")
def _(b):
    return splits.walk_forward(b.merged, PREDICT_FROM, folds=3)


@query("j10_key_membership", KEY + "side:s", f"""SELECT {KEYS}, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = state_fips AND 1 + s_suppkey % 4 = county_fips AND s_acctbal < 0)
  THEN 'in' ELSE 'out' END AS side FROM merged""")
def _(b):
    keys = b.table("supplier").filter("s_acctbal < 0").selectExpr("s_nationkey AS state_fips", "cast(1 + s_suppkey % 4 AS int) AS county_fips")
    inside, outside = splits_side(b.merged, keys)
    return inside.withColumn("side", F.lit("in")).unionByName(outside.withColumn("side", F.lit("out")))


def splits_side(rows, keys):
    return grouping.split_by_keys(rows, keys, ["state_fips", "county_fips"])


