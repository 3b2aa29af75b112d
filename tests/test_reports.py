"""Metrics, reports, lookups, features and flags on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestlens.functions.regions import region_table
from harvestlens.operators import anomalies, correlations, features, grouping, lookup, metrics, reports, splits
from harvestlens.plans import dashboards, studies

SCORED = "commodity string, region string, yield_amount double, pred_yield double"


def test_r2_needs_two_rows_and_variance(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0, 1.0), ("b", "x", 2.0, 1.0), ("b", "x", 2.0, 3.0), ("c", "x", 1.0, 1.5), ("c", "x", 3.0, 2.0), ("c", "x", None, 2.0), ("d", "x", 1.0, None)], SCORED)
    got = {r["commodity"]: (r["n"], r["r2"], r["mae"]) for r in metrics.regression_metrics(df, ["commodity"]).collect()}
    assert got["a"] == (1, None, 0.0) and got["b"] == (2, None, 1.0) and got["d"] == (0, None, None)
    assert got["c"][0] == 2 and math.isclose(got["c"][1], 1 - 1.25 / 2)


def test_grid_keeps_empty_cells(spark):
    df = spark.createDataFrame([("Corn", "South", 1.0, 1.0), ("Corn", "South", 3.0, 2.0)], SCORED)
    got = {(r["commodity"], r["region"]): (r["n"], r["r2"]) for r in metrics.r2_grid(df, commodity=["Corn", "Soybeans"], region=["South", "Plains"]).collect()}
    assert got == {("Corn", "South"): (2, 0.5), ("Corn", "Plains"): (0, None), ("Soybeans", "South"): (0, None), ("Soybeans", "Plains"): (0, None)}


def test_weighted_r2(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 1.0), ("a", "x", 2.0, 2.0), ("b", "x", 1.0, 1.0), ("b", "x", 3.0, 2.0), ("b", "x", 5.0, 5.0), ("c", "x", 1.0, 0.0)], SCORED)
    assert math.isclose(metrics.weighted_r2(df).first()["weighted_r2"], (2 * 1 + 3 * (1 - 1 / 8)) / 5)


def test_empty_sidecar_leaves_computed_values(spark):
    computed = spark.createDataFrame([(1.0, 2.0)], "r2 double, mae double")
    stored = spark.createDataFrame([(None, 9.0)], "test_r2 double, test_mae double")
    names = {"r2": "test_r2", "mae": "test_mae"}
    assert metrics.coalesce_stats(computed, stored, names).first()[:] == (1.0, 9.0)
    assert metrics.coalesce_stats(computed, stored.limit(0), names).first()[:] == (1.0, 2.0)


def test_zscore_without_spread(spark):
    df = spark.createDataFrame([(1, 1, "Corn", 5.0), (1, 2, "Corn", 5.0), (1, 2, "Corn", 5.0), (1, 3, "Corn", 1.0), (1, 3, "Corn", 3.0)],
                               "state_fips int, county_fips int, commodity string, yield_amount double")
    zero = {(r["county_fips"], r["yield_amount"]): r["z"] for r in anomalies.zscore(df, {"yield_amount": "z"}, ["state_fips", "county_fips"]).collect()}
    assert zero[(1, 5.0)] == 0.0 and zero[(2, 5.0)] == 0.0 and math.isclose(zero[(3, 3.0)], math.sqrt(0.5))
    none = {(r["county_fips"], r["yield_amount"]): r["yield_zscore"] for r in anomalies.zscore_flag(df).collect()}
    assert none[(1, 5.0)] is None and none[(2, 5.0)] is None


def test_residual_flag_is_one_sided_on_absolute_values(spark):
    df = spark.createDataFrame([("Corn", "x", 0.0, p) for p in [1.0] * 20 + [-50.0, None]], SCORED)
    got = anomalies.residual_z(df)
    assert [r["pred_yield"] for r in got.filter("anomaly_flag = 1").collect()] == [-50.0]
    assert got.filter("pred_yield IS NULL").first()["anomaly_flag"] == 0
    signed = anomalies.residual_z(df, signed=True, two_sided=True)
    assert signed.filter("anomaly_flag = 1").first()["residual"] == 50.0


def test_overall_flags(spark):
    df = spark.createDataFrame([(v,) for v in [0.0] * 30 + [10.0, -10.0, None]], "yield_residual double")
    got = {r["yield_residual"]: r["anomaly_flag"] for r in anomalies.oof_flags(df).collect()}
    assert got == {0.0: "", 10.0: "high_yield_vs_weather", -10.0: "low_yield_vs_weather", None: ""}
    flat = anomalies.oof_flags(spark.createDataFrame([(1.0,), (1.0,)], "yield_residual double")).collect()
    assert [r["yield_residual_z"] for r in flat] == [0.0, 0.0]


def test_holdout_flags_only_touch_test_rows(spark):
    df = spark.createDataFrame([("train", v) for v in (-1.0, 1.0, 9.0)] + [("test", 20.0), ("test", -20.0), ("test", 0.0)], "split string, yield_residual double")
    got = {(r["split"], r["yield_residual"]): r["anomaly_flag"] for r in anomalies.holdout_flags(df).collect()}
    assert got[("test", 20.0)] == "high_yield_vs_weather" and got[("test", -20.0)] == "low_yield_vs_weather"
    assert got[("train", 9.0)] == "" and got[("test", 0.0)] == ""


def test_weather_extremity_skips_unknown_columns(spark):
    df = spark.createDataFrame([("Corn", 0.0, None)] * 20 + [("Corn", 9.0, 1.0)], "commodity string, gdd double, dry_days double")
    got = anomalies.weather_extremity(df)
    assert got.filter("weather_anomaly_flag = 1").count() == 1
    assert anomalies.top_extreme(got.withColumns({"state_abbr": F.lit("IA"), "county_fips": F.lit(1), "year": F.lit(2012)})).count() == 1


def test_correlation_of_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, 7.0, "x"), (2.0, 3.0, 7.0, "2"), (3.0, 4.0, 7.0, None)], "y double, a double, c double, t string")
    got = {r["feature"]: r["correlation"] for r in correlations.corr_rank(df, "y", ["a", "c", "t"], digits=None).collect()}
    assert math.isclose(got["a"], np.corrcoef([1, 2, 3], [1, 3, 4])[0, 1]) and got["c"] is None and got["t"] is None


def test_impute_uses_group_then_overall_values(spark):
    cols = ["commodity", "state_abbr", *features.TEMPERATURES, *features.RAIN, *features.SNOW]
    kinds = "commodity string, state_abbr string, " + ", ".join(f"{c} double" for c in cols[2:])
    df = spark.createDataFrame([("Corn", "IA", *[v] * 10) for v in (1.0, 3.0, None)] + [("Corn", "IL", *[None] * 10)], kinds)
    got = features.impute(df).collect()
    filled = [r for r in got if r["state_abbr"] == "IA" and r["snow_days"] == 0.0]
    assert filled[0]["avg_temp_max_c"] == 2.0 and filled[0]["avg_precip_mm"] == 2.0
    lone = [r for r in got if r["state_abbr"] == "IL"][0]
    assert lone["avg_temp_max_c"] is None and lone["avg_precip_mm"] == 2.0


def test_trend_needs_three_years(spark):
    df = spark.createDataFrame([("Corn", s, y, v) for s, y, v in [("IA", 2010, 1.0), ("IA", 2011, 2.0), ("IA", 2012, 3.0), ("IL", 2010, 1.0), ("IL", 2011, 9.0)]],
                               "commodity string, state_abbr string, year int, yield_amount double")
    assert {r["state_abbr"]: r["slope"] and round(r["slope"], 9) for r in features.state_trend(df).collect()} == {"IA": 1.0, "IL": None}
    flat = {r["state_abbr"]: (r["intercept"], r["slope"]) for r in features.state_trend_rows(df).collect()}
    assert flat["IL"] == (5.0, 0.0)


def test_baselines_fall_back_county_state_overall(spark):
    schema = "state_abbr string, state_fips int, county_fips int, yield_amount double"
    train = spark.createDataFrame([("IA", 19, 1, 10.0), ("IA", 19, 2, 20.0), ("IL", 17, 1, 60.0)], schema)
    rows = spark.createDataFrame([("IA", 19, 1, 0.0), ("IA", 19, 9, 0.0), ("ZZ", 99, 9, 0.0)], schema)
    got = {r["state_abbr"] + str(r["county_fips"]): (r["state_baseline"], r["county_baseline"]) for r in features.with_baselines(rows, train).collect()}
    assert got == {"IA1": (15.0, 10.0), "IA9": (15.0, 15.0), "ZZ9": (30.0, 30.0)}


@pytest.mark.parametrize("crop,irrigated", [("corn", 1), ("soybeans", 0)])
def test_rule_based_estimate(spark, crop, irrigated):
    schema = ("commodity string, county_fips int, county_baseline double, state_baseline double, trend double, heat_stress_days double, avg_precip_mm double, "
              "heavy_rain_days double, gdd double, is_irrigated int")
    df = spark.createDataFrame([(crop, 0, 999.0, 150.0, 100.0, 8.0, 200.0, 6.0, 2300.0, irrigated)], schema)
    weights = features.ESTIMATE[crop]
    value = 150 + 0.35 * (100 - 150) - 2 * weights.heat - 20 * weights.drought - weights.flood - abs(2300 - weights.gdd_optimum) * weights.gdd
    value += weights.irrigation if irrigated else 0
    assert features.heuristic_yield(df).first()["predicted_yield"] == round(value, 1)


def test_estimate_is_at_least_one_and_rounds_half_to_even(spark):
    assert [r[0] for r in spark.createDataFrame([(0.25,), (0.35,)], "v double").select(F.bround("v", 1)).collect()] == [0.2, 0.4]


def test_interactions_skip_absent_columns(spark):
    df = spark.createDataFrame([(1.0, None, 2.0)] * 3, "a double, b double, c double")
    out = features.interactions(df, [("a", "b"), ("a", "c"), ("a", "zz")])
    assert out.columns == ["a", "b", "c", "a_x_b", "a_x_c"] and out.first()["a_x_b"] is None


def test_regions_default(spark):
    df = spark.createDataFrame([(" ia",), ("ZZ",), (None,)], "state_abbr string")
    got = features.with_region(df, region_table(spark, "scoring"), "midwest")
    assert {r["region"] for r in got.collect()} == {"midwest"}
    assert {r["region"] for r in features.with_region(df, region_table(spark, "training"), "Other").collect()} == {"Midwest", "Other"}


HIST = ("state_fips int, county_fips int, county_name string, state_abbr string, commodity string, irrigation string, year int, yield_amount double, pred_yield double, "
        "signed_residual double, residual_zscore double, anomaly_flag int, weather_anomaly_flag int, avg_precip_mm double, heat_stress_days double, gdd double, "
        "drought_flag int, flood_flag int, extreme_heat_flag int")
PRED = "state_fips int, county_fips int, county_name string, state_abbr string, commodity string, irrigation string, year int, pred_yield double, avg_precip_mm double, heat_stress_days double, gdd double, drought_flag int, flood_flag int, extreme_heat_flag int, noaa_window_start string, noaa_window_end string"


def history(spark, n=30):
    return spark.createDataFrame([
        (19, i, f"C{i} ", "IA", "Corn", "0" if i % 2 else " Irrigated", 2020, 100.0 + i, 100.0, float(i), i / 10, i % 2, 0, 1.0, 2.0, 3.0, 0, 0, 1) for i in range(n)], HIST)


def predictions(spark):
    return spark.createDataFrame([(19, 1, "C1", "IA", "Corn", "1", 2024, None if i == 0 else 5.0 * i, 1.0, 1.0, 1.0, 0, 1, 0, "2024-04-01", "2024-07-01") for i in range(5)], PRED)


def test_lookup_statistics_ignore_the_row_limit(spark):
    got = dashboards.predictor_lookup(history(spark), predictions(spark), 2020, "corn", limit=3)
    assert got["stats"].first()["count"] == 30 and got["rows"].count() == 3
    assert got["by_county"].count() == 30


def test_lookup_filters(spark):
    hist, pred = history(spark), predictions(spark)
    assert dashboards.predictor_lookup(hist, pred, 2020, "CORN", "IA", " C3 ")["stats"].first()["count"] == 1
    assert dashboards.predictor_lookup(hist, pred, 2020, "corn", irrigation=1)["stats"].first()["count"] == 15
    assert dashboards.predictor_lookup(hist, pred, 2020, "corn", "IL")["stats"].first()["count"] == 0
    late = dashboards.predictor_lookup(hist, pred, 2024, "corn")
    assert late["stats"].first()["count"] == 4 and late["noaa_window"].first()["window_end"] == "2024-07-01"


def test_distribution_of_one_value(spark):
    df = spark.createDataFrame([(2.345,)], "v double")
    row = reports.distribution(df, "v", digits=3).first()
    assert row["count"] == 1 and row["std"] == 0.0 and {row[c] for c in ("mean", "median", "min", "max", "p25", "p75")} == {2.345}


def test_state_lookup_without_matches_gives_no_row(spark):
    schema = "state_fips int, county_fips int, state_abbr string, year int, commodity string, irrigation string, yield_amount double, " + ", ".join(
        f"{c} double" for c in lookup.FEATURE_COLUMNS)
    df = spark.createDataFrame([(19, 1, "IA", 2012, "Corn", " Irrigated", 1.0, *[2.0] * len(lookup.FEATURE_COLUMNS))], schema)
    assert lookup.feature_lookup(df, "IA", 0, 2012, "corn", 1).first()["gdd"] == 2.0
    assert lookup.feature_lookup(df, "IL", 0, 2012, "corn", 1).count() == 0
    assert lookup.feature_lookup(df, "IA", 1, 2012, "corn", 0).count() == 0


def test_report_tables(spark):
    got = dashboards.report(history(spark), predictions(spark))
    hero = got["hero"].first()
    assert (hero["total_records"], hero["anomaly_count"], hero["anomaly_rate"]) == (30, 15, 0.5)
    assert [r["signed_residual"] for r in got["top_anomalies"].collect()] == [float(i) for i in range(29, 9, -2)]
    assert got["worst_predicted"].first()["pred_yield"] == 5.0
    assert [r["position"] for r in got["insights"].orderBy("position").collect()] == [1, 2, 3, 4, 5]


def test_report_of_empty_history(spark):
    got = dashboards.report(history(spark).limit(0), predictions(spark).limit(0))
    assert got["hero"].first()["anomaly_rate"] == 0.0 and got["insights"].count() == 0


def test_options_span_both_tables(spark):
    got = dashboards.predictor_options(history(spark, 2), predictions(spark))
    assert {r["year"] for r in got["years"].collect()} == {2020, 2024}
    assert sorted(r["county_name"] for r in got["counties"].collect()) == ["C0", "C1"]


def test_model_page_prefers_stored_predictions(spark):
    hist, regions = history(spark), region_table(spark, "dashboard")
    test = hist.withColumns({"region": F.lit("Midwest"), "year": F.lit(2022)})
    stats = spark.createDataFrame([(0.5, 1.5, None, 2021, 2023, 77)], "test_r2 double, test_mae double, test_rmse double, test_year_min int, test_year_max int, train_rows int")
    assert dashboards.model_dashboard(test, stats, hist, regions)["hero"].first()["r2"] == 0.5
    assert dashboards.model_dashboard(None, None, hist, regions, 2020)["hero"].first()["n"] == 30


def test_ties_at_the_cut_follow_the_key(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "k int, v double")
    assert [r["k"] for r in grouping.top_abs(df, "v", 3, ["k"]).collect()] == [0, 1, 2]


def test_value_shares_and_membership(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "g string")
    got = {r["g"]: r["pct"] for r in grouping.share_of_total(grouping.value_counts(df, "g"), "n", "pct", 100.0).collect()}
    assert math.isclose(got["a"], 200 / 3)
    inside, outside = grouping.split_by_keys(df, spark.createDataFrame([("a",), ("a",)], "g string"), ["g"])
    assert inside.count() == 2 and outside.count() == 1


def test_entity_split_and_folds_keep_counties_whole(spark):
    df = spark.range(2000).selectExpr("cast(id % 40 as int) state_fips", "cast(id % 13 as int) county_fips", "id")
    sides = splits.entity_split(df).groupBy("state_fips", "county_fips").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s"))
    assert sides.filter("n > 1").count() == 0
    assert 0.1 < sides.filter("s = 'test'").count() / sides.count() < 0.3
    folds = splits.group_kfold(df, k=5).groupBy("state_fips", "county_fips").agg(F.count_distinct("fold").alias("n"))
    assert folds.filter("n > 1").count() == 0


def test_walk_forward_windows(spark):
    df = spark.createDataFrame([(y,) for y in [2010, 2011, 2012, 2013, 2014, 2015, 2016, 2017, 2018, 2019, 2020, 2021, 2022, 2023] * 2], "year int")
    got = splits.walk_forward(df, 2021, 5).collect()
    plan = {}
    for r in got:
        plan.setdefault((r["fold"], r["cutoff"]), []).append(r["test_year"])
    assert plan == {(i + 1, 2014 + i): [2014 + i, 2015 + i, 2016 + i] for i in range(5)}
    assert splits.walk_forward(df.filter("year < 2012"), 2021, 5).count() == 0


def test_explanations(spark):
    df = history(spark, 3).withColumn("yield_residual", F.col("signed_residual"))
    text = [r["sentence"] for r in studies.explain_top(df, 2020).collect()]
    assert text[0] == "C2 , IA (2020) showed a residual of 2.00 | heat stress days was close to the 2020 mean | average precipitation was close to the 2020 mean | GDD was close to the 2020 mean"


def test_summary_levels(spark):
    got = reports.summary_levels(predictions(spark).withColumn("region", F.lit("Midwest")))
    rows = {r["group_type"]: r for r in got.collect()}
    assert set(rows) == {"overall", "commodity", "region", "state"}
    assert rows["overall"]["pred_median"] == 12.5 and rows["overall"]["n_rows"] == 5 and rows["state"]["state_abbr"] == "IA"
