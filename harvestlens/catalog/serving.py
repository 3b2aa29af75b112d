"""Queries behind dashboards, lookups, the model page, comparisons, maps and case studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from harvestlens.catalog.base import PREDICT_FROM, TEST_FROM, check_table, region_sql
from harvestlens.catalog.counties import KEY, KEYS, _OUTCOME
from harvestlens.catalog.registry import query
from harvestlens.functions.regions import region_table
from harvestlens.operators import (
    anomalies, comparisons, correlations, features, geo, grouping, lookup, metrics, reports, sketches, splits,
)
from harvestlens.plans import dashboards, studies
from harvestlens.session import materialize

# ---- history and predictions

_HIST = ("state_fips:i county_fips:i county_name:s state_abbr:s year:i commodity:s irrigation:i yield_amount:d pred_yield:d "
         "signed_residual:d residual_zscore:d anomaly_flag:i weather_anomaly_flag:i outcome_category:s avg_precip_mm:d "
         "heat_stress_days:d gdd:d")
check_table("hist_rows", f"""SELECT state_fips, county_fips, trim(county_name) AS county_name, state_abbr, year, commodity,
  CASE WHEN trim(irrigation) = 'Irrigated' THEN 1 ELSE 0 END AS irrigation, yield_amount, pred_yield, signed_residual, residual_zscore,
  anomaly_flag, weather_anomaly_flag, {_OUTCOME} AS outcome_category, avg_precip_mm, heat_stress_days, gdd FROM hist""")


@query("q06_history_rows", _HIST, "SELECT * FROM hist_rows")
def _(b):
    return dashboards.historical(b.history)["rows"]


@query("q06_u03_filter_options", "option:s value:s", """SELECT 'year' AS option, cast(year AS string) AS value FROM hist_rows
  UNION SELECT 'commodity', commodity FROM hist_rows UNION SELECT 'state_abbr', state_abbr FROM hist_rows
  UNION SELECT 'outcome_category', outcome_category FROM hist_rows""")
def _(b):
    return dashboards.historical(b.history)["filter_options"]


@query("q07_prediction_rows", "state_fips:i county_fips:i county_name:s state_abbr:s year:i commodity:s irrigation:i pred_yield:d "
       "avg_precip_mm:d heat_stress_days:d gdd:d noaa_window_start:s noaa_window_end:s",
       """SELECT * REPLACE (trim(county_name) AS county_name, CASE WHEN trim(irrigation) = 'Irrigated' THEN 1 ELSE 0 END AS irrigation) FROM pred""")
def _(b):
    return dashboards.predictions(b.predictions, only=["rows"])["rows"]


def _summary_sql() -> str:
    dims = sorted({c for cols in reports.SUMMARY_SETS.values() for c in cols})
    parts = []
    for level, cols in reports.SUMMARY_SETS.items():
        shown = ", ".join(f"{d} AS {d}" if d in cols else f"CAST(NULL AS string) AS {d}" for d in dims)
        parts.append(f"""SELECT '{level}' AS group_type, {shown}, count(DISTINCT state_abbr0 || '-' || county_fips) AS n_counties, count(*) AS n_rows,
          avg(pred_yield) AS pred_mean, quantile_cont(pred_yield, 0.5) AS pred_median, stddev_samp(pred_yield) AS pred_std, min(pred_yield) AS pred_min,
          max(pred_yield) AS pred_max, quantile_cont(pred_yield, 0.25) AS pred_p25, quantile_cont(pred_yield, 0.75) AS pred_p75,
          avg(avg_precip_mm) AS avg_precip_mm_mean, avg(heat_stress_days) AS heat_stress_days_mean, avg(gdd) AS gdd_mean, max(year) AS year,
          min(noaa_window_start) AS noaa_window_start, max(noaa_window_end) AS noaa_window_end
          FROM (SELECT *, state_abbr AS state_abbr0, {region_sql('summary')} AS region FROM pred) q {'GROUP BY ' + ', '.join(cols) if cols else ''}""")
    return " UNION ALL ".join(parts)


@query("a46_q07_summary_levels", "group_type:s commodity:s region:s state_abbr:s n_counties:i n_rows:i pred_mean:d pred_median:d pred_std:d "
       "pred_min:d pred_max:d pred_p25:d pred_p75:d avg_precip_mm_mean:d heat_stress_days_mean:d gdd_mean:d year:i noaa_window_start:s noaa_window_end:s",
       _summary_sql())
def _(b):
    return reports.summary_levels(features.with_region(b.predictions, region_table(b.spark, "summary"), "Other"))


# ---- executive report

def _report(name):
    return lambda b: dashboards.report(b.history, b.predictions, only=[name])[name]


query("a28_q08_hero", "total_records:i year_min:i year_max:i n_states:i n_counties:i n_commodities:i anomaly_count:i weather_anomaly_count:i anomaly_rate:d",
      """SELECT count(*) AS total_records, min(year) AS year_min, max(year) AS year_max, count(DISTINCT state_abbr) AS n_states,
         count(DISTINCT state_abbr || '/' || county_fips) AS n_counties, count(DISTINCT commodity) AS n_commodities, sum(anomaly_flag) AS anomaly_count,
         sum(weather_anomaly_flag) AS weather_anomaly_count, sum(anomaly_flag) * 1e0 / count(*) AS anomaly_rate FROM hist_rows""")(_report("hero"))
query("t02_q08_top_anomalies", " ".join(w for w in _HIST.split() if w.split(":")[0] in dashboards.TOP_COLUMNS),
      """SELECT * FROM hist_rows WHERE anomaly_flag = 1 AND signed_residual IS NOT NULL
         ORDER BY abs(signed_residual) DESC, year, state_abbr, county_name, commodity, irrigation LIMIT 10""")(_report("top_anomalies"))
query("t03_q08_lowest_predictions", "year:i state_abbr:s county_name:s commodity:s pred_yield:d irrigation:i avg_precip_mm:d heat_stress_days:d gdd:d",
      """SELECT * REPLACE (trim(county_name) AS county_name, CASE WHEN trim(irrigation) = 'Irrigated' THEN 1 ELSE 0 END AS irrigation) FROM pred
         WHERE pred_yield IS NOT NULL ORDER BY pred_yield, year, state_abbr, trim(county_name), commodity LIMIT 10""")(_report("worst_predicted"))
query("a30_t04_q08_anomalies_by_state", "state_abbr:s anomalies:i",
      """SELECT state_abbr, count(*) AS anomalies FROM hist_rows WHERE anomaly_flag = 1 GROUP BY state_abbr
         ORDER BY anomalies DESC, state_abbr LIMIT 12""")(_report("anomaly_by_state"))
query("a31_q08_anomaly_trend", "year:i total:i anomalies:i anomaly_pct:d",
      """SELECT year, count(*) AS total, sum(anomaly_flag) AS anomalies, round(sum(anomaly_flag) * 1e2 / count(*), 2) AS anomaly_pct
         FROM hist_rows GROUP BY year""")(_report("anomaly_trend"))
query("q08_weather_window", "window_start:s window_end:s n_rows:i",
      "SELECT min(noaa_window_start) AS window_start, max(noaa_window_end) AS window_end, count(*) AS n_rows FROM pred")(_report("noaa_window"))


@query("a29_year_extremes", "worst_year:i worst_mean:d worst_n:i best_year:i best_mean:d", """WITH y AS (
  SELECT year, avg(signed_residual) AS m, count(signed_residual) AS n FROM hist_rows WHERE signed_residual IS NOT NULL GROUP BY year)
  SELECT (SELECT year FROM y ORDER BY m, year LIMIT 1) AS worst_year, (SELECT m FROM y ORDER BY m, year LIMIT 1) AS worst_mean,
    (SELECT n FROM y ORDER BY m, year LIMIT 1) AS worst_n, (SELECT year FROM y ORDER BY m DESC, year LIMIT 1) AS best_year,
    (SELECT m FROM y ORDER BY m DESC, year LIMIT 1) AS best_mean""")
def _(b):
    return reports.year_extremes(b.history)


@query("q08_insight_sentences", "position:i sentence:s", """WITH y AS (SELECT year, avg(signed_residual) AS m, count(*) AS n FROM hist_rows
    WHERE signed_residual IS NOT NULL GROUP BY year), s AS (SELECT state_abbr, count(*) AS k FROM hist_rows WHERE anomaly_flag = 1 GROUP BY state_abbr)
  SELECT 1 AS position, printf('Weakest year: %d, with yields %.1f bu/ac under prediction on average over %d county records.', year, abs(m), n) AS sentence
    FROM (SELECT * FROM y ORDER BY m, year LIMIT 1)
  UNION ALL SELECT 2, printf('Best year: %d, with yields %+.1f bu/ac against prediction on average.', year, m) FROM (SELECT * FROM y ORDER BY m DESC, year LIMIT 1)
  UNION ALL SELECT 3, printf('Most flagged records: %s with %d.', state_abbr, k) FROM (SELECT * FROM s ORDER BY k DESC, state_abbr LIMIT 1)
  UNION ALL SELECT 4, format('Flagged records: {:,} of {:,} ({:.1f}%).', CAST(sum(anomaly_flag) AS bigint), count(*), sum(anomaly_flag) * 1e2 / count(*)) FROM hist_rows
  UNION ALL SELECT 5, format('Prediction-only records: {:,}, from weather between {} and {}.', count(*), min(noaa_window_start), max(noaa_window_end)) FROM pred""")
def _(b):
    return _report("insights")(b)


# ---- predictor

@query("u01_q09_year_options", "year:i", f"SELECT DISTINCT year FROM scored0 WHERE year < {PREDICT_FROM} UNION SELECT year FROM pred")
def _(b):
    return dashboards.predictor_options(b.history, b.predictions, only=["years"])["years"]


@query("u01_q09_commodity_options", "commodity:s", "SELECT commodity FROM hist UNION SELECT commodity FROM pred")
def _(b):
    return lookup.option_values("commodity", b.history, b.predictions)


@query("u02_q09_county_options", "state_abbr:s county_name:s",
       "SELECT state_abbr, trim(county_name) AS county_name FROM hist UNION SELECT state_abbr, trim(county_name) FROM pred")
def _(b):
    return dashboards.predictor_options(b.history, b.predictions, only=["counties"])["counties"]


def _lookup(name, **kw):
    return lambda b: dashboards.predictor_lookup(b.history, b.predictions, first=PREDICT_FROM, only=[name], **kw)[name]


_MATCH = "pred_yield IS NOT NULL AND upper(commodity) = 'CORN'"
_STATS = """SELECT count(*) AS count, round(avg(pred_yield), 2) AS mean, round(quantile_cont(pred_yield, 0.5), 2) AS median, round(min(pred_yield), 2) AS min,
  round(max(pred_yield), 2) AS max, round(stddev_pop(pred_yield), 2) AS std, round(quantile_cont(pred_yield, 0.25), 2) AS p25,
  round(quantile_cont(pred_yield, 0.75), 2) AS p75 FROM {}"""
_DIST = "count:i mean:d median:d min:d max:d std:d p25:d p75:d"
query("a24_q10_lookup_distribution", _DIST, _STATS.format(f"hist WHERE year = 1998 AND {_MATCH}"))(_lookup("stats", year=1998, crop="corn"))
query("p11_q10_lookup_prediction_year", _DIST,
      _STATS.format(f"pred WHERE year = 2001 AND {_MATCH} AND state_abbr = 'IA' AND trim(irrigation) = 'Non-Irrigated'"))(
    _lookup("stats", year=2001, crop="CORN", state="IA", irrigation=0))
query("a25_q10_by_county", "state:s county:s count:i avg_pred_yield:d min_pred_yield:d max_pred_yield:d",
      f"""SELECT state_abbr AS state, trim(county_name) AS county, count(*) AS count, round(avg(pred_yield), 2) AS avg_pred_yield,
         round(min(pred_yield), 2) AS min_pred_yield, round(max(pred_yield), 2) AS max_pred_yield FROM hist WHERE year = 1998 AND {_MATCH} GROUP BY 1, 2""")(
    _lookup("by_county", year=1998, crop="Corn"))
query("a26_q10_weather_context", " ".join(f"{n}:d" for n in reports.WEATHER_CONTEXT),
      f"SELECT {', '.join(f'round(avg(q.{c}), 2) AS {n}' for n, c in reports.WEATHER_CONTEXT.items())} FROM hist q WHERE year = 1998 AND {_MATCH}")(
    _lookup("weather_summary", year=1998, crop="Corn"))
query("t05_q10_sample_rows", "state_abbr:s county_name:s irrigation:s pred_yield:d",
      f"SELECT * FROM hist WHERE year = 1998 AND {_MATCH} ORDER BY pred_yield DESC, state_abbr, trim(county_name), irrigation LIMIT 50")(
    _lookup("sample_rows", year=1998, crop="Corn"))


@query("a24_distribution_by_group", "commodity:s state_abbr:s " + _DIST, """SELECT commodity, state_abbr, count(pred_yield) AS count, round(avg(pred_yield), 2) AS mean,
  round(quantile_cont(pred_yield, 0.5), 2) AS median, round(min(pred_yield), 2) AS min, round(max(pred_yield), 2) AS max, round(stddev_pop(pred_yield), 2) AS std,
  round(quantile_cont(pred_yield, 0.25), 2) AS p25, round(quantile_cont(pred_yield, 0.75), 2) AS p75 FROM hist WHERE pred_yield IS NOT NULL GROUP BY 1, 2""")
def _(b):
    return reports.distribution(b.history, "pred_yield", ["commodity", "state_abbr"])


@query("a24_event_value_distribution", "event_type:s " + _DIST, """SELECT event_type, count(value) AS count, round(avg(value), 2) AS mean, round(quantile_cont(value, 0.5), 2) AS median,
  round(min(value), 2) AS min, round(max(value), 2) AS max, round(stddev_pop(value), 2) AS std, round(quantile_cont(value, 0.25), 2) AS p25,
  round(quantile_cont(value, 0.75), 2) AS p75 FROM events GROUP BY event_type""")
def _(b):
    return reports.distribution(b.table("events"), "value", ["event_type"])


_FEATS = " ".join(f"{c}:d" for c in lookup.FEATURE_COLUMNS)


@query("t06_q12_county_features", f"state_fips:i county_fips:i state_abbr:s year:i commodity:s {_FEATS} actual_yield:d",
       """SELECT *, yield_amount AS actual_yield FROM merged WHERE state_abbr = 'AL' AND county_fips = 1 AND year = 1998 AND commodity = 'Corn'
          AND trim(irrigation) = 'Non-Irrigated' LIMIT 1""")
def _(b):
    return lookup.feature_lookup(b.merged, "al", 1, 1998, "corn", 0)


_STATE_AVG = ", ".join(f"avg({c}) AS {c}" for c in lookup.FEATURE_COLUMNS)


@query("a27_q12_state_features", f"state_fips:i county_fips:i commodity:s {_FEATS} actual_yield:d",
       f"""SELECT max(state_fips) AS state_fips, 0 AS county_fips, max(commodity) AS commodity, {_STATE_AVG}, avg(yield_amount) AS actual_yield FROM merged
          WHERE state_abbr = 'IA' AND year = 1998 AND commodity = 'Soybeans' AND trim(irrigation) = 'Irrigated' HAVING count(*) > 0""")
def _(b):
    return lookup.feature_lookup(b.merged, "IA", 0, 1998, "soy", 1)


@query("u04_p39_unified_predictions", KEY + "pred_yield:d yield_amount:d anomaly_flag:i noaa_window_start:s", f"""SELECT {KEYS}, pred_yield, yield_amount, anomaly_flag,
  CAST(NULL AS string) AS noaa_window_start FROM hist UNION ALL SELECT {KEYS}, pred_yield, NULL, NULL, noaa_window_start FROM pred""")
def _(b):
    return lookup.unified_predictions(b.history, b.predictions)


@query("p39_align", "state_fips:i year:i extreme_events:i noaa_window_end:s yield_amount:d",
       "SELECT state_fips, year, NULL AS extreme_events, NULL AS noaa_window_end, yield_amount FROM hist")
def _(b):
    like = lookup.unified_predictions(b.history.limit(0), b.predictions.limit(0))
    return lookup.align(b.history, like.select("state_fips", "year", "extreme_events", "noaa_window_end", "yield_amount"))


# ---- model page

_R2 = "CASE WHEN count({a}) >= 2 AND min({a}) < max({a}) THEN 1 - avg(power({a} - {p}, 2)) / var_pop({a}) END"
_M = f"""count(yield_amount) AS n, {_R2.format(a='yield_amount', p='pred_yield')} AS r2, avg(abs(yield_amount - pred_yield)) AS mae,
  sqrt(avg(power(yield_amount - pred_yield, 2))) AS rmse"""
check_table("modelled", f"""SELECT *, CASE WHEN region0 = '' THEN NULL ELSE region0 END AS region FROM (
  SELECT *, {region_sql('dashboard')} AS region0 FROM scored WHERE pred_yield IS NOT NULL) q WHERE region0 <> ''""")
check_table("tested", f"SELECT * FROM modelled WHERE year >= {TEST_FROM}")


def _page(name):
    return lambda b: dashboards.model_dashboard_history(b.scored, region_table(b.spark, "dashboard"), TEST_FROM, only=[name])[name]


query("a32_q11_model_metrics", "n:i r2:d mae:d rmse:d test_year_max:i", f"SELECT {_M}, max(year) AS test_year_max FROM tested")(_page("hero"))
_GRID = f"""SELECT g.*, r2, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES ('Midwest'), ('Plains'), ('South')) a(region), (VALUES ('Corn'), ('Soybeans')) c(commodity)) g
  LEFT JOIN (SELECT region, commodity, {_M} FROM tested GROUP BY region, commodity) m USING (region, commodity)"""
query("a33_q11_r2_grid", "region:s commodity:s r2:d n:i", _GRID)(_page("r2_by_crop_region"))
query("a33_q11_r2_by_crop", "commodity:s r2:d n:i", f"SELECT commodity, {_M} FROM tested GROUP BY commodity")(_page("r2_by_crop"))
query("a34_q11_residual_by_year", "year:i avg_abs_residual:d n:i",
      "SELECT year, avg(abs(yield_amount - pred_yield)) AS avg_abs_residual, count(*) AS n FROM tested GROUP BY year")(_page("residual_by_year"))
query("q11_train_rows", "train_rows:i", f"SELECT count(*) AS train_rows FROM modelled WHERE year < {TEST_FROM}")(_page("train_rows"))
query("q11_flagged_test_rows", "anomaly_count:i n:i", "SELECT sum(anomaly_flag) AS anomaly_count, count(*) AS n FROM tested")(_page("anomalies"))


def _stored(b):
    rows = features.with_region(b.scored, region_table(b.spark, "dashboard"), "").filter(
        (F.col("region") != "") & F.col("pred_yield").isNotNull() & (F.col("year") >= TEST_FROM))
    stats = b.table("nation").filter("n_nationkey = 3").selectExpr(
        "CAST(NULL AS double) AS test_r2", "n_nationkey * 2.5e0 AS test_mae", "CAST(NULL AS double) AS test_rmse", "1999 AS test_year_min",
        "CAST(NULL AS int) AS test_year_max", "1000 + n_nationkey AS train_rows")
    return rows, stats


@query("j14_q11_stored_stats_preferred", "n:i r2:d mae:d rmse:d test_year_min:i test_year_max:i train_rows:i",
       f"SELECT {_M.replace('AS mae', 'AS mae0')}, 7.5 AS mae, 1999 AS test_year_min, max(year) AS test_year_max, 1003 AS train_rows FROM tested")
def _(b):
    return dashboards.model_dashboard_stored(*_stored(b), only=["hero"])["hero"]


@query("a35_z_outlier_count", "anomaly_count:i n:i", """SELECT count(*) FILTER (abs((signed_residual - m) / s) >= 2) AS anomaly_count, count(*) AS n FROM (
  SELECT *, avg(signed_residual) OVER () AS m, stddev_samp(signed_residual) OVER () AS s FROM tested) q""")
def _(b):
    return dashboards.model_dashboard_stored(*_stored(b), only=["anomalies"])["anomalies"]


@query("a32_metrics_by_state", "state_abbr:s n:i r2:d mae:d rmse:d", f"SELECT state_abbr, {_M} FROM scored WHERE pred_yield IS NOT NULL GROUP BY state_abbr")
def _(b):
    return metrics.regression_metrics(b.predicted, ["state_abbr"])


_SPLIT = "CASE WHEN (state_fips * 10 + county_fips) * 37 % 1000 < 200 THEN 'test' ELSE 'train' END"


def _split_metrics(group, label):
    def r2(where):
        c = {"a": f"CASE WHEN {where} THEN yield_amount END", "p": "pred_yield"}
        return _R2.format(**c)
    return f"""SELECT {label} AS commodity, {r2('true')} AS r2_all, {r2("split = 'train'")} AS r2_train, {r2("split = 'test'")} AS r2_test, count(*) AS n
      FROM (SELECT *, {_SPLIT} AS split FROM scored WHERE pred_yield IS NOT NULL) q {group}"""


@query("a32_metrics_by_split", "commodity:s r2_all:d r2_train:d r2_test:d n:i",
       _split_metrics("GROUP BY commodity", "commodity") + " UNION ALL " + _split_metrics("", "'Overall'"))
def _(b):
    return metrics.metrics_by_split(splits.entity_split(b.predicted, number=(F.col("state_fips") * 10 + F.col("county_fips")) * 37))


@query("a33_weighted_r2", "weighted_r2:d n:i", f"SELECT sum(r2 * n) / sum(n) AS weighted_r2, sum(n) AS n FROM (SELECT commodity, {_M} FROM tested GROUP BY commodity) q")
def _(b):
    return metrics.weighted_r2(_stored(b)[0])


# ---- anomaly summaries

@query("a36_q15_county_map", "fips:s n_rows:i n_anomalies:i avg_yield:d avg_residual:d lat:d lon:d",
       """SELECT * REPLACE (lpad(cast(state_fips AS string), 2, '0') || lpad(cast(county_fips AS string), 3, '0') AS fips) FROM (
         SELECT state_fips, county_fips, '' AS fips, county_name, count(yield_amount) AS n_rows, count(*) FILTER (anomaly_flag <> '') AS n_anomalies, avg(yield_amount) AS avg_yield,
         avg(yield_residual) AS avg_residual FROM study GROUP BY state_fips, county_fips, state_abbr, county_name) a
         JOIN (SELECT state_fips, county_fips, (south + north) / 2e0 AS lat, (west + east) / 2e0 AS lon FROM county_box) c USING (state_fips, county_fips)""")
def _(b):
    return studies.map_layers(b.study, centroids=_centroids(b))["county"]


def _centroids(b):
    from harvestlens.functions.text import geoid

    return b.derived("county_box").select(geoid("state_fips", "county_fips").alias("geoid"), ((F.col("south") + F.col("north")) / 2).alias("lat"),
                                          ((F.col("west") + F.col("east")) / 2).alias("lon"))


@query("t02_w09_q15_top_residuals", "rank:i fips:s year:i commodity:s irrigation:s abs_residual:d lat:d lon:d",
       """SELECT *, lpad(cast(state_fips AS string), 2, '0') || lpad(cast(county_fips AS string), 3, '0') AS fips FROM (
         SELECT *, abs(yield_residual) AS abs_residual, row_number() OVER (ORDER BY abs(yield_residual) DESC, state_fips, county_fips, year, commodity, irrigation) AS rank
         FROM study WHERE yield_residual IS NOT NULL) a JOIN (SELECT state_fips, county_fips, (south + north) / 2e0 AS lat, (west + east) / 2e0 AS lon FROM county_box) c
         USING (state_fips, county_fips) WHERE rank <= 30""")
def _(b):
    return studies.map_layers(b.study, centroids=_centroids(b))["top"]


_CENTRE = " ".join(f"WHEN '{s}' THEN {la}::DOUBLE" for s, (la, _) in geo.STATE_CENTRES.items())
_CENTRE_LON = " ".join(f"WHEN '{s}' THEN {lo}::DOUBLE" for s, (_, lo) in geo.STATE_CENTRES.items())


@query("a36_q15_state_map", "state_abbr:s n_rows:i n_anomalies:i avg_yield:d avg_residual:d lat:d lon:d",
       f"""SELECT state_abbr, count(yield_amount) AS n_rows, count(*) FILTER (anomaly_flag <> '') AS n_anomalies, avg(yield_amount) AS avg_yield,
          avg(yield_residual) AS avg_residual, CASE state_abbr {_CENTRE} END AS lat, CASE state_abbr {_CENTRE_LON} END AS lon FROM study GROUP BY state_abbr""")
def _(b):
    return studies.map_layers(b.study)["state"]


@query("a36_anomaly_rates", "state_fips:i county_fips:i anomaly_rate:d weather_anomaly_rate:d avg_residual_zscore:d",
       """SELECT state_fips, county_fips, avg(anomaly_flag) AS anomaly_rate, avg(weather_anomaly_flag) AS weather_anomaly_rate,
          avg(residual_zscore) AS avg_residual_zscore FROM scored WHERE pred_yield IS NOT NULL GROUP BY 1, 2""")
def _(b):
    return reports.anomaly_rates(b.scored)


check_table("study_region", f"SELECT *, {region_sql('summary')} AS region FROM study")


@query("a37_regional_summary", "region:s n_rows:i mean_residual:d median_residual:d positive_residual_rate:d high_anomaly_count:i low_anomaly_count:i",
       """SELECT region, count(*) AS n_rows, avg(yield_residual) AS mean_residual, quantile_cont(yield_residual, 0.5) AS median_residual,
          avg(CASE WHEN yield_residual > 0 THEN 1e0 ELSE 0e0 END) AS positive_residual_rate, count(*) FILTER (anomaly_flag = 'high_yield_vs_weather') AS high_anomaly_count,
          count(*) FILTER (anomaly_flag = 'low_yield_vs_weather') AS low_anomaly_count FROM study_region WHERE yield_residual IS NOT NULL GROUP BY region""")
def _(b):
    return reports.regional_summary(features.with_region(b.study, region_table(b.spark, "summary"), "Other"))


@query("a37_region_insights", "region:s mean_residual:d n_counties:i reading:s", f"""SELECT *, CASE WHEN mean_residual > 1 THEN 'underestimation' WHEN mean_residual < -1 THEN 'negative'
  ELSE 'mixed' END AS reading FROM (SELECT {region_sql('map')} AS region, avg(r) AS mean_residual, count(*) AS n_counties FROM (
  SELECT state_fips, county_fips, state_abbr, avg(yield_residual) AS r FROM study GROUP BY 1, 2, 3) c WHERE r IS NOT NULL GROUP BY 1) q""")
def _(b):
    county = reports.map_agg(b.study, ["state_fips", "county_fips", "state_abbr"])
    return reports.region_insights(features.with_region(county, region_table(b.spark, "map"), "Other US"))


def _case(name):
    return lambda b: studies.case_study(b.study, 1998, only=[name])[name]


_98 = "study WHERE year = 1998"
query("a38_q16_stress_rates", "indicator:s value:d", " UNION ALL ".join(
    f"SELECT '{f}' AS indicator, avg({f}) AS value FROM {_98}" for f in ("drought_flag", "flood_flag", "extreme_heat_flag")))(_case("stress"))
query("a38_q16_case_by_crop", "commodity:s n:i mean_yield:d mean_residual:d n_high:i n_low:i",
      f"""SELECT commodity, count(yield_amount) AS n, avg(yield_amount) AS mean_yield, avg(yield_residual) AS mean_residual,
         count(*) FILTER (anomaly_flag = 'high_yield_vs_weather') AS n_high, count(*) FILTER (anomaly_flag = 'low_yield_vs_weather') AS n_low FROM {_98} GROUP BY commodity""")(_case("by_crop"))
query("a38_q16_case_by_state", "state_abbr:s n:i mean_yield:d mean_residual:d mean_heat_days:d mean_dry_days:d",
      f"""SELECT state_abbr, count(yield_amount) AS n, avg(yield_amount) AS mean_yield, avg(yield_residual) AS mean_residual, avg(heat_stress_days) AS mean_heat_days,
         avg(dry_days) AS mean_dry_days FROM {_98} GROUP BY state_abbr""")(_case("by_state"))
_TOP = "ORDER BY abs(yield_residual) DESC, state_fips, county_fips, commodity, irrigation LIMIT"
query("t02_q16_case_top", KEY + "yield_residual:d abs_residual:d", f"SELECT *, abs(yield_residual) AS abs_residual FROM {_98} AND yield_residual IS NOT NULL {_TOP} 15")(_case("top"))
query("w07_q16_case_profile", KEY + "delta_heat_stress_days:d delta_gdd:d delta_avg_precip_mm:d",
      f"""SELECT * FROM (SELECT *, heat_stress_days - avg(heat_stress_days) OVER () AS delta_heat_stress_days, gdd - avg(gdd) OVER () AS delta_gdd,
         avg_precip_mm - avg(avg_precip_mm) OVER () AS delta_avg_precip_mm FROM {_98}) q WHERE yield_residual IS NOT NULL {_TOP} 10""")(_case("profile"))


def _words(col, label):
    return f"""CASE WHEN {col} > 0 THEN printf('{label} was above the 1998 mean by %.2f', {col}) WHEN {col} < 0 THEN printf('{label} was below the 1998 mean by %.2f', abs({col}))
      ELSE '{label} was close to the 1998 mean' END"""


query("p50_q16_explanations", "state_fips:i county_fips:i sentence:s", f"""SELECT *, printf('%s, %s (%d) showed a residual of %.2f', county_name, state_abbr, year, yield_residual)
  || ' | ' || {_words('dh', 'heat stress days')} || ' | ' || {_words('dp', 'average precipitation')} || ' | ' || {_words('dg', 'GDD')} AS sentence FROM (
  SELECT *, round(heat_stress_days - avg(heat_stress_days) OVER (), 2) AS dh, round(avg_precip_mm - avg(avg_precip_mm) OVER (), 2) AS dp,
    round(gdd - avg(gdd) OVER (), 2) AS dg FROM {_98} AND yield_residual IS NOT NULL) q {_TOP} 3""")(_case("explained"))
query("a47_q16_year_versus_rest", "case_mean:d other_mean:d difference:d", """SELECT a AS case_mean, o AS other_mean, a - o AS difference FROM (
  SELECT avg(heat_stress_days) FILTER (year = 1998) AS a, avg(heat_stress_days) FILTER (year <> 1998) AS o FROM study WHERE yield_residual IS NOT NULL) q""")(_case("heat_versus_rest"))


@query("a39_extreme_years", "year:i n_counties:i avg_yield:d drought_pct:d flood_pct:d extreme_heat_pct:d", """SELECT year, count(*) AS n_counties,
  round(avg(yield_amount), 2) AS avg_yield, round(100 * avg(drought_flag), 1) AS drought_pct, round(100 * avg(flood_flag), 1) AS flood_pct,
  round(100 * avg(extreme_heat_flag), 1) AS extreme_heat_pct FROM merged WHERE year IN (1996, 1998, 2000) GROUP BY year""")
def _(b):
    return reports.extreme_years(b.merged, [1996, 1998, 2000])


@query("a40_residual_diagnostics", "variable:s n:i mean:d std:d min:d max:d share_positive:d", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
       avg(CASE WHEN {c} > 0 THEN 1e0 WHEN {c} <= 0 THEN 0e0 END) AS share_positive FROM study""" for c in ("yield_residual", "yield_residual_z")))
def _(b):
    return reports.residual_diag(b.study)


@query("a42_w10_anomaly_type_shares", "anomaly_type:s n:i pct:d", """SELECT anomaly_type, n, n * 1e2 / sum(n) OVER () AS pct FROM (SELECT CASE
  WHEN anomaly_flag = 1 AND weather_anomaly_flag = 1 THEN 'Extreme Weather → Yield Impact' WHEN anomaly_flag = 1 THEN 'Yield Mismatch (unexplained)'
  WHEN weather_anomaly_flag = 1 THEN 'Extreme Weather (model handled)' ELSE 'Normal' END AS anomaly_type, count(*) AS n FROM scored GROUP BY 1) q""")
def _(b):
    return grouping.share_of_total(grouping.value_counts(b.scored, "anomaly_type"), "n", "pct", 100.0)


@query("a43_flag_rates", "commodity:s sum:i mean:d count:i", "SELECT commodity, sum(anomaly_flag) AS sum, avg(anomaly_flag) AS mean, count(*) AS count FROM scored GROUP BY commodity")
def _(b):
    return reports.flag_rates(b.scored, ["commodity"])


@query("a44_most_extreme_weather", "state_abbr:s county_fips:i year:i weather_extremity:d commodity:s", """SELECT state_abbr, county_fips, year, max(weather_extremity) AS weather_extremity,
  arg_max(commodity, (weather_extremity, commodity)) AS commodity FROM scored WHERE weather_anomaly_flag = 1 GROUP BY 1, 2, 3
  ORDER BY 4 DESC, 1, 2, 3 LIMIT 15""")
def _(b):
    return anomalies.top_extreme(b.scored)


@query("a41_extreme_events_by_year", "year:i Corn:i Soybeans:i", """SELECT year, count(*) FILTER (commodity = 'Corn') AS Corn, count(*) FILTER (commodity = 'Soybeans') AS Soybeans
  FROM scored WHERE weather_anomaly_flag = 1 GROUP BY year""")
def _(b):
    flagged = b.scored.filter(F.col("weather_anomaly_flag") == 1)
    wide = comparisons.crosstab(flagged, "year", "commodity", ["Corn", "Soybeans"])
    return wide.select("year", F.col("n_Corn").alias("Corn"), F.col("n_Soybeans").alias("Soybeans"))


@query("a24_a46_merged_quantiles", "level:s event_type:s n:i least:d most:d mean:d in_bounds:b", """SELECT 'event_type' AS level, event_type, count(value) AS n, min(value) AS least, max(value) AS most, avg(value) AS mean, true AS in_bounds
  FROM events GROUP BY event_type UNION ALL SELECT 'all', NULL, count(value), min(value), max(value), avg(value), true FROM events""")
def _(b):
    """Sketches of each type and day, stored, and two levels of them merged; in_bounds compares the quantiles' true ranks with the stated error."""
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    rows = b.table("events")
    finest = materialize(sketches.value_sketches(rows.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value"))
    levels = materialize(sketches.value_levels(finest, [["event_type"], []], probs))
    each = F.array(F.struct(F.lit("event_type").alias("level"), "event_type"), F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("event_type")))
    long = rows.filter("value IS NOT NULL").select("value", F.explode(each).alias("g")).select("value", F.col("g.level").alias("l"), F.col("g.event_type").alias("t"))
    met = long.join(levels, (F.col("l") == F.col("level")) & F.col("t").eqNullSafe(F.col("event_type")))
    ranks = met.groupBy("l", "t").agg(*[F.avg((F.col("value") < F.col(p)).cast("int")).alias(f"lt_{p}") for p in probs], *[F.avg((F.col("value") <= F.col(p)).cast("int")).alias(f"le_{p}") for p in probs])
    error = sketches.rank_error()
    held = reduce(lambda x, y: x & y, [(F.col(f"lt_{p}") - error <= share) & (F.col(f"le_{p}") + error >= share) for p, share in probs.items()])
    return levels.join(ranks.select("l", "t", held.alias("in_bounds")), (F.col("l") == F.col("level")) & F.col("t").eqNullSafe(F.col("event_type")))


@query("a48_merged_distinct", "year:i n_stations:i near:b", "SELECT year(date) AS year, count(DISTINCT station) AS n_stations, true AS near FROM wx GROUP BY year(date)")
def _(b):
    """Sketches of each month, stored and united by year, beside the exact count."""
    rows = b.weather.select("station", F.year("date").alias("year"), F.month("date").alias("month"))
    monthly = materialize(sketches.distinct_sketches(rows, ["year", "month"], ["station"]))
    about = sketches.merged_distinct(monthly, ["year"]).withColumnRenamed("n_distinct", "about")
    exact = grouping.distinct_count(rows, ["station"], ["year"]).withColumnRenamed("n_distinct", "n_stations")
    return exact.join(about, "year").withColumn("near", F.abs(F.col("about") - F.col("n_stations")) <= 4 * sketches.distinct_error() * F.col("n_stations") + 0.5)


@query("a48_distinct_by_group", "state_abbr:s n_distinct:i", "SELECT state_abbr, count(DISTINCT county_name) AS n_distinct FROM merged GROUP BY state_abbr")
def _(b):
    return grouping.distinct_count(b.merged, ["county_name"], ["state_abbr"])


@query("u03_distinct_rows", "state_abbr:s county_fips:i", "SELECT DISTINCT state_abbr, county_fips FROM merged")
def _(b):
    return grouping.distinct_rows(b.merged, ["state_abbr", "county_fips"])


@query("t01_t07_sorted_correlations", "feature:s correlation:d", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(CASE WHEN min({f}) < max({f}) THEN corr(yield_amount, {f}) END, 4) AS correlation FROM merged" for f in ("gdd", "dry_days", "snow_days", "frost_days")))
def _(b):
    return correlations.ranked(correlations.corr_rank(b.merged, "yield_amount", ["gdd", "dry_days", "snow_days", "frost_days"]))


@query("t01_sorted_rows", KEY + "yield_zscore:d", f"SELECT {KEYS}, yield_zscore FROM signals ORDER BY year, yield_zscore")
def _(b):
    return grouping.sort_by(b.signals, "year", "yield_zscore")


# ---- two-group comparison

_COLS = ("yield_amount", "pred_yield", "residual", "residual_zscore")


def _compare(name):
    return lambda b: studies.compare_flagged(b.scored, only=[name])[name]


def _g(c, f):
    return f"CASE WHEN anomaly_flag = {f} THEN {c} END"


query("a45_q17_group_statistics", "variable:s n_0:i n_1:i mean_0:d mean_1:d std_0:d std_1:d median_0:d median_1:d mean_diff:d", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, count({_g(c, 0)}) AS n_0, count({_g(c, 1)}) AS n_1, avg({_g(c, 0)}) AS mean_0, avg({_g(c, 1)}) AS mean_1, stddev_samp({_g(c, 0)}) AS std_0,
      stddev_samp({_g(c, 1)}) AS std_1, quantile_cont({_g(c, 0)}, 0.5) AS median_0, quantile_cont({_g(c, 1)}, 0.5) AS median_1, avg({_g(c, 1)}) - avg({_g(c, 0)}) AS mean_diff FROM scored""" for c in _COLS))(_compare("groups"))
def _area(density: str, top: str, steps: int = 4000) -> str:
    """The integral of a density of u from 0 to `top` by Simpson's rule."""
    return f"""list_sum(list_transform(range({steps} + 1), lambda i: CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * list_transform([i * ({top}) / {steps}], lambda u: {density})[1])) * ({top}) / {3 * steps}"""


# the angle whose tangent is t over the root of the degrees of freedom runs over a finite range
_T_P = f"1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * {_area('power(cos(u), df - 1)', 'atan(abs(t_stat) / sqrt(df))')}"
_Z_P = f"CASE WHEN z < 0 THEN 1 ELSE 1 - sqrt(2 / pi()) * {_area('exp(-u * u / 2)', 'least(abs(z), 40)')} END"
_CHI_P = f"1 - exp((1 - dof / 2e0) * ln(2) - lgamma(dof / 2e0)) * {_area('power(u, dof - 1) * exp(-u * u / 2)', 'sqrt(least(chi2, 1500))')}"


query("m16_q17_welch_t", "variable:s t_stat:d df:d p_value:d", f"SELECT *, {_T_P} AS p_value FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, (m0 - m1) / sqrt(v0 / n0 + v1 / n1) AS t_stat, power(v0 / n0 + v1 / n1, 2) / (power(v0 / n0, 2) / (n0 - 1) + power(v1 / n1, 2) / (n1 - 1)) AS df
      FROM (SELECT avg({_g(c, 0)}) AS m0, avg({_g(c, 1)}) AS m1, var_samp({_g(c, 0)}) AS v0, var_samp({_g(c, 1)}) AS v1, count({_g(c, 0)}) AS n0, count({_g(c, 1)}) AS n1 FROM scored) q""" for c in _COLS) + ") w")(_compare("welch"))
query("m17_q17_mann_whitney", "variable:s u_stat:d z:d p_value:d", f"SELECT *, {_Z_P} AS p_value FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, u AS u_stat, (greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM (
      SELECT sum(r) FILTER (anomaly_flag = 0) - n0 * (n0 + 1) / 2 AS u, n0, n1, n0 + n1 AS n, (SELECT sum(k * k * k - k) FROM (SELECT count(*)::DOUBLE AS k FROM scored WHERE {c} IS NOT NULL GROUP BY {c}) t) AS ties
      FROM (SELECT anomaly_flag, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r, (SELECT count({_g(c, 0)})::DOUBLE FROM scored) AS n0, (SELECT count({_g(c, 1)})::DOUBLE FROM scored) AS n1
        FROM scored WHERE {c} IS NOT NULL) p GROUP BY n0, n1) q""" for c in _COLS) + ") w")(_compare("mann_whitney"))
query("a41_j11_q17_crosstab", "state_abbr:s n_0:i n_1:i n_total:i pct_0:d pct_1:d",
      """SELECT coalesce(state_abbr, 'All') AS state_abbr, n_0, n_1, n_0 + n_1 AS n_total, n_0 * 1e2 / (n_0 + n_1) AS pct_0, n_1 * 1e2 / (n_0 + n_1) AS pct_1 FROM (
        SELECT state_abbr, count(*) FILTER (anomaly_flag = 0) AS n_0, count(*) FILTER (anomaly_flag = 1) AS n_1 FROM scored GROUP BY ROLLUP (state_abbr)) q""")(_compare("crosstab_state_abbr"))


def _chi_sql(c, square):
    gap = "abs(o - e) - least(0.5, abs(o - e))" if square else "(o - e)"
    return f"""SELECT *, {_CHI_P} AS p_value FROM (SELECT sum(power({gap}, 2) / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT f) - 1) AS dof FROM (
      SELECT r.a, c.f, coalesce(o, 0)::DOUBLE AS o, r.n * c.n * 1e0 / (SELECT count(*) FROM scored) AS e FROM (SELECT {c} AS a, count(*) AS n FROM scored GROUP BY 1) r
      CROSS JOIN (SELECT anomaly_flag AS f, count(*) AS n FROM scored GROUP BY 1) c
      LEFT JOIN (SELECT {c} AS a, anomaly_flag AS f, count(*) AS o FROM scored GROUP BY 1, 2) k ON k.a = r.a AND k.f = c.f) q) w"""


query("m18_q17_chi_square_states", "chi2:d dof:i p_value:d", _chi_sql("state_abbr", False))(_compare("chi2_state_abbr"))
query("m18_q17_chi_square_two_by_two", "chi2:d dof:i p_value:d", _chi_sql("commodity", True))(_compare("chi2_commodity"))
query("a31_q17_anomaly_share_by_year", "year:i total:i anomalies:i anomaly_pct:d",
      "SELECT year, count(*) AS total, sum(anomaly_flag) AS anomalies, round(sum(anomaly_flag) * 1e2 / count(*), 2) AS anomaly_pct FROM scored GROUP BY year")(_compare("by_year"))
