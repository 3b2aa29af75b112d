"""Model flows on a small table where weather explains the yield."""

import random

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import features, metrics, models
from harvestlens.plans import studies
from harvestlens.sources import artifacts

FOREST = models.ForestSettings(trees=5, depth=4)
BOOST = models.BoostSettings(rounds=5, depth=3, step=0.3, min_rows=1)
ROW = ["state_fips", "county_fips", "year", "commodity", "irrigation"]


@pytest.fixture(scope="module")
def merged(spark):
    rnd = random.Random(11)
    rows = []
    for county in range(24):
        for year in range(2010, 2020):
            for crop in ("Corn", "Soybeans"):
                heat, rain = rnd.uniform(0, 30), rnd.uniform(100, 900)
                y = (150 if crop == "Corn" else 45) + 0.02 * rain - heat + rnd.gauss(0, 1)
                state = ("IA", 19) if county < 12 else ("KS", 20)
                rows.append((state[1], county, year, crop, " Non-Irrigated", f"C{county}", state[0], y, rain, heat, heat * 30, 20.0, 25.0, 10.0, 38.0))
    schema = ("state_fips int, county_fips int, year int, commodity string, irrigation string, county_name string, state_abbr string, yield_amount double, "
              "avg_precip_mm double, heat_stress_days double, gdd double, avg_temp_mean_c double, avg_temp_max_c double, avg_temp_min_c double, peak_temp_max_c double")
    extra = ["precip_std_mm", "dry_days", "heavy_rain_days", "frost_days", "winter_snowfall_mm", "avg_snow_depth_mm", "max_snow_depth_mm", "snow_days"]
    flags = ["drought_flag", "flood_flag", "extreme_heat_flag"]
    return spark.createDataFrame(rows, schema).withColumns({**{c: F.lit(1.0) for c in extra}, **{f: F.lit(0) for f in flags}}).cache()


USED = ["avg_precip_mm", "heat_stress_days", "gdd"]


def test_forest_explains_yield(spark, merged):
    corn = merged.filter("commodity = 'Corn'")
    model = models.fit_rf(corn, USED, s=FOREST)
    scored = models.predict(model, corn.withColumn("gdd", F.col("gdd").cast("string")), USED, "pred_yield")
    assert metrics.regression_metrics(scored).first()["r2"] > 0.7
    assert scored.schema["gdd"].dataType.simpleString() == "string"
    ranks = {r["feature"]: r["importance"] for r in models.importances(model, USED, spark).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6


def test_boosted_trees_with_early_stop(merged):
    corn = merged.filter("commodity = 'Corn'")
    scored = models.predict(models.fit_gbt(corn, USED, s=BOOST), corn, USED, "pred_yield")
    assert metrics.regression_metrics(scored).first()["r2"] > 0.5


def test_train_and_export_skips_small_cells(spark, merged, folder):
    few = merged.filter("NOT (commodity = 'Soybeans' AND state_abbr = 'KS' AND year > 2010 AND year < 2018)")
    out = studies.train_and_export(few, 2018, min_rows=50, forest=FOREST, boost=BOOST)
    assert set(out["models"].models) == {("Corn", "Midwest"), ("Corn", "Plains"), ("Soybeans", "Midwest")}
    stats = out["stats"].first()
    assert stats["train_rows"] == 3 * 12 * 8 and stats["test_rows"] == 4 * 12 * 2 and stats["test_year_max"] == 2019
    importance = out["models"].importance(spark).agg(F.sum("importance")).first()[0]
    assert abs(importance - 1) < 1e-6
    artifacts.save_models(spark, out["models"].models, folder("models"), out["features"], models.BLEND)
    loaded, used, weights = artifacts.load_models(spark, folder("models"))
    cells = set(out["models"].models)
    assert set(loaded) == cells and used == {c: out["features"] for c in cells} and weights == {c: models.BLEND for c in cells}
    assert {r["model"]: r["n"] for r in out["predictions"].groupBy("model").agg(F.count("pred_yield").alias("n")).collect()} == {"cell": 72, "pooled": 24}


def test_two_manifests_stay_apart(spark, merged, folder):
    corn, beans = merged.filter("commodity = 'Corn'"), merged.filter("commodity = 'Soybeans'")
    few = {("Corn", "Midwest"): ["heat_stress_days"], ("Soybeans", "Midwest"): ["gdd", "avg_precip_mm"]}
    fitted = {k: {"rf": models.fit_rf(corn if k[0] == "Corn" else beans, f, s=FOREST)} for k, f in few.items()}
    shares = {("Corn", "Midwest"): {"rf": 1.0}, ("Soybeans", "Midwest"): {"rf": 0.5}}
    artifacts.save_models(spark, fitted, folder("two"), few, shares)
    loaded, used, weights = artifacts.load_models(spark, folder("two"))
    assert used == few and weights == shares
    rows = features.features_core(merged, include_flood=False).withColumns(
        {"region": F.lit("Midwest"), "trend": F.lit(100.0), "state_baseline": F.lit(90.0), "county_baseline": F.lit(90.0)}).drop("gdd")
    got = models.score(rows.withColumn("gdd", F.lit(1.0)), loaded, used, weights)
    assert got.filter("source = 'model'").count() == merged.count()
    assert models.score(rows.drop("avg_precip_mm").withColumns({"gdd": F.lit(1.0), "avg_precip_mm": F.lit(0.0)}), loaded, used, weights).count() == merged.count()


def test_scoring_falls_back_to_the_estimate(spark, merged):
    rows = features.features_core(merged, include_flood=False).withColumns(
        {"region": F.when(F.col("state_abbr") == "IA", "Midwest").otherwise("Plains"), "trend": F.lit(100.0)})
    based = features.with_baselines(rows, rows)
    found, _ = models.fit_by_group(rows, rows, ["Corn"], ["Midwest"], min_rows=10, forest=FOREST, boost=BOOST)
    got = models.score(based, found.models, found.features)
    sources = {(r["commodity"], r["region"], r["source"]) for r in got.select("commodity", "region", "source").distinct().collect()}
    assert sources == {("Corn", "Midwest", "model"), ("Corn", "Plains", "estimate"), ("Soybeans", "Midwest", "estimate"), ("Soybeans", "Plains", "estimate")}
    assert got.count() == merged.count() and got.filter("yield_category IS NULL").count() == 0


def test_out_of_fold_rows_are_never_seen(merged):
    out = models.oof_anomalies(merged, USED, 3, forest=FOREST)
    assert out.count() == merged.count() and out.filter("yield_predicted IS NULL").count() == 0
    joined = models.attach_predictions(merged, out, ROW, "yield_predicted")
    assert joined.count() == merged.count()


def test_walk_forward(merged):
    rows = features.features_core(merged).withColumn("region", F.lit("Midwest"))
    preds, scores = models.walk_forward_cv(rows, 2018, ["Corn"], ["Midwest"], folds=2, min_rows=10, forest=FOREST, boost=BOOST)
    # rows of the crop that no cell model covers are predicted by the pooled one
    assert [r["n"] for r in scores.orderBy("fold").collect()] == [96, 96]
    assert preds.groupBy("fold").agg(F.min("year")).count() == 2
    assert models.last_fold_prediction(preds, ROW).count() == 24 * 3 * 2


def test_permutation_keeps_the_values(merged):
    mixed = models.permute(merged, "gdd", ROW, buckets=4)
    assert mixed.count() == merged.count()
    assert sorted(r["gdd"] for r in mixed.select("gdd").collect()) == sorted(r["gdd"] for r in merged.select("gdd").collect())
    moved = mixed.join(merged.select(*ROW, F.col("gdd").alias("old")), ROW).filter("gdd <> old").count()
    assert moved > merged.count() * 0.8


def test_permutation_importance_finds_the_driver(merged):
    corn = merged.filter("commodity = 'Corn'")
    model = models.fit_rf(corn, ["avg_precip_mm", "heat_stress_days", "frost_days"], s=FOREST)
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(
        model, corn, ["avg_precip_mm", "heat_stress_days", "frost_days"], ROW, buckets=4).collect()}
    assert got["heat_stress_days"] > got["avg_precip_mm"] > got["frost_days"] - 1e-9


def test_stratified_models_use_the_pooled_model_for_small_groups(merged):
    train = merged.filter("commodity = 'Corn' OR (commodity = 'Soybeans' AND county_fips = 0 AND year = 2010)")
    out = models.fit_stratified(train, merged, USED, ["Corn", "Soybeans"], forest=FOREST, boost=BOOST)
    assert out.count() == merged.count() and out.filter("yield_predicted IS NULL").count() == 0


def test_importance_of_too_few_rows_is_zero(merged):
    assert {(r["importance"], r["fitted"]) for r in models.importance_rank(merged.limit(10), USED).collect()} == {(0.0, False)}
