"""Drivers report, anomaly study, case study, comparison, training and table-version walks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestlens.functions.numeric import as_num
from harvestlens.functions.regions import driver_table, region_table
from harvestlens.operators import (
    anomalies, changes, comparisons, correlations, features, geo, grouping, metrics, models, reports, splits,
)
from harvestlens.operators.features import delta_vs_mean, direction_words
from harvestlens.functions.text import geoid
from harvestlens.plans import chosen
from harvestlens.session import materialize
from harvestlens.sources import artifacts, snapshots, tables

# Report columns and the features they are about.
CORR_NAMES = {
    "corr_heat_stress": "heat_stress_days", "corr_gdd": "gdd", "corr_precip": "total_precip_mm",
    "corr_dry_days": "dry_days", "corr_frost": "frost_days", "corr_avg_temp": "avg_temp_mean_c",
    "corr_peak_temp": "peak_temp_max_c", "corr_diurnal": "diurnal_range_c", "corr_heavy_rain": "heavy_rain_days",
}
RANKED_FEATURES = [
    "total_precip_mm", "precip_std_mm", "dry_days", "heavy_rain_days", "avg_temp_max_c", "avg_temp_min_c",
    "avg_temp_mean_c", "peak_temp_max_c", "heat_stress_days", "gdd", "frost_days", "winter_snowfall_mm", "snow_days",
]


# Features of the forest importance table.
FOREST_FEATURES = [
    "total_precip_mm", "dry_days", "heavy_rain_days", "avg_temp_max_c", "avg_temp_min_c", "avg_temp_mean_c", "peak_temp_max_c",
    "heat_stress_days", "gdd", "frost_days", "diurnal_range_c", "pct_dry_days",
]


def drivers_report(
    signals: DataFrame, dry="Non-Irrigated", crop="Corn", states=reports.CORN_BELT, drought_years=(2011, 2012, 2013),
    flood_years=(2018, 2019, 2020), only=None, crops=("Corn", "Soybeans"), forest=models.ForestSettings(),
) -> dict[str, DataFrame]:
    """All tables of the "what drives yield" report from one signal table."""
    rainfed = signals.filter(F.trim("irrigation") == dry)
    if "diurnal_range_c" not in rainfed.columns:
        rainfed = rainfed.withColumn("diurnal_range_c", F.col("avg_temp_max_c") - F.col("avg_temp_min_c"))
    if "pct_dry_days" not in rainfed.columns:
        # without observed days the share is taken of the season's 183 days
        days = F.col("obs_count") if "obs_count" in rainfed.columns else F.lit(183.0)
        rainfed = rainfed.withColumn("pct_dry_days", F.try_divide(F.col("dry_days") * 100.0, days))
    corn = rainfed.filter(F.col("commodity") == crop)
    heat_mean = {"avg_heat_days": ("heat_stress_days", 1)}
    rain_mean = {"avg_precip": ("total_precip_mm", 0)}
    return chosen({
        "correlation_rank": lambda: correlations.corr_rank(signals, "yield_amount", RANKED_FEATURES, ["commodity"]),
        "mismatches": lambda: reports.mismatch_rows(signals),
        "mismatch_summary": lambda: reports.mismatch_summary(signals),
        "event_impact": lambda: reports.event_impact(signals),
        "drought_check": lambda: reports.event_validation(signals, states, drought_years, crop, "drought"),
        "flood_check": lambda: reports.event_validation(signals, states, flood_years, crop, "flood"),
        "correlations": lambda: correlations.corr_table(rainfed, "yield_amount", CORR_NAMES),
        "by_temperature": lambda: reports.binned_response(
            corn, "avg_temp_mean_c", reports.TEMP_BINS, "temp_bin", means=heat_mean | rain_mean),
        "by_rain": lambda: reports.binned_response(corn, "total_precip_mm", reports.RAIN_BINS, "precip_bin", means=heat_mean),
        "by_heat": lambda: reports.binned_response(
            corn, "heat_stress_days", reports.HEAT_BINS, "heat_stress_bin", "right", rain_mean, spread=False, versus=True),
        "heatmap": lambda: reports.state_year_heatmap(corn.filter(F.col("state_abbr").isin(list(states)))),
        "forest_importance": lambda: models.importance_by_group(materialize(rainfed), crops, "commodity", FOREST_FEATURES, s=forest),
        "event_pivot": lambda: reports.event_pivot(rainfed, states, reports.EVENT_PIVOT),
    }, only)


def ready_rows(merged: DataFrame, crop: str | None = None, target: str = "yield_amount") -> DataFrame:
    """Rows with a readable yield, optionally of one crop."""
    rows = merged.withColumn(target, as_num(target)).filter(F.col(target).isNotNull())
    return rows.filter(F.lower(F.trim("commodity")) == crop.strip().lower()) if crop else rows


def anomaly_study(
    merged: DataFrame, features_: Sequence[str] | None = None, k: int = 5, forest=models.ForestSettings(), number=None
) -> dict[str, DataFrame]:
    """Split by county, feature ranks on training rows, out-of-fold flags and z flags."""
    spark = merged.sparkSession
    rows = materialize(splits.entity_split(ready_rows(merged), number=number))
    used = list(features_ or features.available_features(rows))
    train = rows.filter(F.col("split") == "train")
    groups = driver_table(spark)
    flagged = models.oof_anomalies(rows, used, k, forest=forest, number=number)
    return {
        "correlation": correlations.driver_group(correlations.corr_rank(train, "yield_amount", used), groups),
        "importance": correlations.driver_group(models.importance_rank(train, used, s=forest), groups),
        "rows": anomalies.zscore_flag(flagged),
    }


def explainer(study: Mapping[str, DataFrame], k: int = 3) -> dict[str, DataFrame]:
    """Top features per driver group, flag counts and residual diagnostics."""
    rows = study["rows"]
    return {
        "drivers": correlations.driver_summary(study["importance"], "importance", k),
        "flags": grouping.value_counts(rows.filter(F.col("anomaly_flag") != ""), "anomaly_flag"),
        "diagnostics": reports.residual_diag(rows),
    }


def flag_types(scored: DataFrame) -> DataFrame:
    """Residual flags, weather extremity and the combined type on scored rows."""
    return anomalies.with_anomaly_type(anomalies.weather_extremity(anomalies.residual_z(scored)))


def map_layers(
    rows: DataFrame, polygons: DataFrame | None = None, centroids: DataFrame | None = None, k: int = 30,
    residual="yield_residual",
) -> dict[str, DataFrame]:
    """County and state aggregates for maps, and the k largest residuals with coordinates and rank."""
    flagged = F.col("anomaly_flag").cast("string").isin("1", "high_yield_vs_weather", "low_yield_vs_weather")
    by = ["state_fips", "county_fips", "state_abbr", "county_name"]
    county = reports.map_agg(rows, by, flagged, residual).withColumn("fips", geoid("state_fips", "county_fips"))
    county = geo.approx_coords(county) if centroids is None else geo.attach_centroids(county, centroids)
    top = grouping.top_abs(rows, residual, k, ["state_fips", "county_fips", "year", "commodity", "irrigation"], "abs_residual")
    top = grouping.with_rank(
        top, F.col("abs_residual").desc(), "state_fips", "county_fips", "year", "commodity", "irrigation")
    out = {
        "county": county,
        "state": geo.with_state_centres(reports.map_agg(rows, ["state_abbr"], flagged, residual)),
        "top": top.withColumn("fips", geoid("state_fips", "county_fips")).join(county.select("fips", "lat", "lon").groupBy(
            "fips").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")), "fips", "left"),
    }
    if polygons is not None:
        out["polygons"] = geo.map_layer(polygons, county.drop("state_abbr", "county_name"))
    return out


EXPLAINED = {"heat_stress_days": "heat stress days", "avg_precip_mm": "average precipitation", "gdd": "GDD"}
CASE_TIES = ["state_fips", "county_fips", "commodity", "irrigation"]


def explain_top(df: DataFrame, year: int, k: int = 3, residual="yield_residual") -> DataFrame:
    """The year's largest residuals with a sentence comparing their weather with the year's means."""
    case = df.filter((F.col("year") == year) & F.col(residual).isNotNull())
    deltas = delta_vs_mean(case, list(EXPLAINED))
    top = grouping.top_abs(deltas, residual, k, CASE_TIES)
    words = [direction_words(F.round(f"delta_{c}", 2), label, f"{year} mean") for c, label in EXPLAINED.items()]
    opening = F.format_string("%s, %s (%d) showed a residual of %.2f", "county_name", "state_abbr", "year", residual)
    return top.withColumn("sentence", F.concat_ws(" | ", opening, *words))


PROFILE = ["heat_stress_days", "dry_days", "avg_precip_mm", "gdd", "drought_flag", "flood_flag", "extreme_heat_flag"]


def case_study(df: DataFrame, year: int, residual="yield_residual", only=None) -> dict[str, DataFrame]:
    """Stress rates, crop and state tables, the largest residuals and their weather profile."""
    case = df.filter((F.col("year") == year) & F.col(residual).isNotNull())
    return chosen({
        "stress": lambda: reports.stress_rates(df, year),
        "by_crop": lambda: reports.case_by_crop(df, year, residual),
        "by_state": lambda: reports.case_by_state(df, year, residual),
        "top": lambda: grouping.top_abs(case, residual, 15, CASE_TIES, "abs_residual"),
        "profile": lambda: grouping.top_abs(delta_vs_mean(df.filter(F.col("year") == year), PROFILE), residual, 10, CASE_TIES),
        "explained": lambda: explain_top(df, year, residual=residual),
        "heat_versus_rest": lambda: comparisons.year_vs_rest(df.filter(F.col(residual).isNotNull()), "heat_stress_days", year),
        "by_region": lambda: reports.regional_summary(
            features.with_region(df, region_table(df.sparkSession, "summary"), "Other"), residual),
    }, only)


def compare_flagged(
    df: DataFrame, cols=("yield_amount", "pred_yield", "residual", "residual_zscore"),
    by=("commodity", "state_abbr", "irrigation"), flag="anomaly_flag", only=None,
) -> dict[str, DataFrame]:
    """Normal against flagged rows: group statistics, tests, cross tables and the yearly rate."""
    rows = df.withColumn(flag, F.coalesce(as_num(flag).cast("int"), F.lit(0)))
    cols = [c for c in cols if c in rows.columns]
    tables_ = {
        "groups": lambda: comparisons.two_group(rows, flag, cols),
        "welch": lambda: comparisons.welch_t(rows, flag, cols),
        "mann_whitney": lambda: comparisons.mann_whitney(rows, flag, cols),
        "by_year": lambda: reports.anomaly_trend(rows),
    }
    for c in by:
        tables_[f"crosstab_{c}"] = lambda c=c: comparisons.crosstab(rows, c, flag, [0, 1], margins=True)
        tables_[f"chi2_{c}"] = lambda c=c: comparisons.chi2(rows, c, flag)
    return chosen(tables_, only)


def train_and_export(
    merged: DataFrame, first_test_year: int, crops=("Corn", "Soybeans"), regions=("Midwest", "Plains", "South"),
    region_map: DataFrame | None = None, min_rows: int = models.MIN_TRAIN_ROWS, forest=models.ForestSettings(),
    boost=models.BoostSettings(), predictions_name: str | None = None, stats_name: str | None = None, models_folder: str | None = None,
) -> dict:
    """Impute, build features, fit the crop × region models, score the test years and derive the stats row; predictions, stats and
    models are written where a name or a folder is given."""
    spark = merged.sparkSession
    region_map = region_table(spark, "training") if region_map is None else region_map
    clean = merged.withColumn("commodity", F.trim("commodity"))
    rows = features.with_region(features.features_core(features.impute(clean)), region_map, "Other")
    rows = materialize(rows.filter(F.col("yield_amount").isNotNull()))
    train, test = rows.filter(F.col("year") < first_test_year), rows.filter(F.col("year") >= first_test_year)
    fitted, scored = models.fit_by_group(train, test, crops, regions, min_rows=min_rows, forest=forest, boost=boost)
    scored = materialize(features.residuals(scored).select(
        "state_abbr", "county_name", "year", "commodity", "region", "yield_amount", "pred_yield", "signed_residual", "abs_residual", "model"))
    weighted = metrics.weighted_r2(scored).select("weighted_r2").scalar()
    stats = scored.agg(
        F.lit("Boosted trees + random forest (ensemble)").alias("model_name"),
        F.lit("boosted 60% + forest 40%").alias("ensemble_weights"),
        F.lit(sum(fitted.train_rows.values())).cast("int").alias("train_rows"),
        F.count(F.lit(1)).cast("int").alias("test_rows"),
        F.min("year").cast("int").alias("test_year_min"), F.max("year").cast("int").alias("test_year_max"),
        metrics.metric_columns()["mae"].alias("test_mae"), metrics.metric_columns()["rmse"].alias("test_rmse"),
    ).withColumn("test_r2", weighted)
    if predictions_name:
        tables.overwrite_table(scored, predictions_name)
    if stats_name:
        tables.overwrite_table(stats, stats_name)
    if models_folder:
        artifacts.save_models(spark, fitted.models, models_folder, fitted.features, models.BLEND)
    return {"models": fitted, "predictions": scored, "stats": stats, "features": fitted.features}


def version_walk(spark: SparkSession, base: str, start: DataFrame, source: DataFrame, keys=("id",)) -> list[int]:
    """Create, upsert, update and delete a versioned table; every step writes a new snapshot."""
    steps = [snapshots.write_version(start, base)]
    steps.append(snapshots.write_version(changes.upsert(snapshots.read_version(spark, base), source, keys), base))
    key = keys[0]
    steps.append(snapshots.write_version(changes.update_where(
        snapshots.read_version(spark, base), F.col(key) % 2 == 0, {key: F.col(key) + 100}), base))
    steps.append(snapshots.write_version(changes.delete_where(
        snapshots.read_version(spark, base), F.col(key) % 2 == 0), base))
    return steps
