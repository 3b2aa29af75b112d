"""Serving tables: history, predictions, executive report, lookup and model page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harvestlens.functions import labels
from harvestlens.functions.numeric import as_int, as_num
from harvestlens.functions.text import norm_flag
from harvestlens.operators import anomalies, features, grouping, lookup, metrics, reports
from harvestlens.plans import chosen

CROPS = ("Corn", "Soybeans")
REGIONS = ("Midwest", "Plains", "South")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def clean_history(df: DataFrame) -> DataFrame:
    """History rows with settled types: counts and flags as whole numbers, measures as doubles, crisp texts."""
    measures = ["yield_amount", "pred_yield", "signed_residual", "residual_zscore", "avg_precip_mm", "heat_stress_days", "gdd"]
    return df.select(
        *[as_int(c, 0).alias(c) for c in ("state_fips", "county_fips", "year", "anomaly_flag", "weather_anomaly_flag")],
        F.trim(_text("county_name")).alias("county_name"), _text("state_abbr").alias("state_abbr"),
        _text("commodity").alias("commodity"), norm_flag("irrigation").alias("irrigation"),
        *[F.when(F.col(c).isNotNull(), as_num(c, 0.0)).alias(c) for c in measures],
        labels.outcome_category("anomaly_flag", "weather_anomaly_flag", "residual_zscore").alias("outcome_category"),
    )


def clean_predictions(df: DataFrame) -> DataFrame:
    measures = ["pred_yield", "avg_precip_mm", "heat_stress_days", "gdd"]
    return df.select(
        *[as_int(c, 0).alias(c) for c in ("state_fips", "county_fips", "year")],
        F.trim(_text("county_name")).alias("county_name"), _text("state_abbr").alias("state_abbr"),
        _text("commodity").alias("commodity"), norm_flag("irrigation").alias("irrigation"),
        *[F.when(F.col(c).isNotNull(), as_num(c, 0.0)).alias(c) for c in measures],
        _text("noaa_window_start").alias("noaa_window_start"), _text("noaa_window_end").alias("noaa_window_end"),
    )


def filter_options(df: DataFrame, cols=("year", "commodity", "state_abbr", "outcome_category")) -> DataFrame:
    """Distinct non-empty values of the filter columns in one pass: (option, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("option"), F.col(c).cast("string").alias("value")) for c in cols])
    long = df.select(F.explode(pairs).alias("p")).select("p.option", "p.value").distinct()
    return long.filter(F.col("value").isNotNull() & ~F.col("value").isin("", "0"))


def historical(df: DataFrame) -> dict[str, DataFrame]:
    rows = clean_history(df)
    return {"rows": rows, "filter_options": filter_options(rows)}


def predictions(df: DataFrame, summary: DataFrame | None = None, only=None) -> dict[str, DataFrame]:
    """Prediction rows, their summary levels (computed unless stored) and filter options."""
    rows = clean_predictions(df)
    return chosen({
        "rows": lambda: rows,
        "summary_rows": lambda: reports.summary_levels(df) if summary is None else summary,
        "filter_options": lambda: filter_options(rows, ("commodity", "state_abbr")),
    }, only)


TOP_COLUMNS = [
    "year", "state_abbr", "county_name", "commodity", "yield_amount", "pred_yield", "signed_residual", "residual_zscore",
    "outcome_category", "weather_anomaly_flag", "avg_precip_mm", "heat_stress_days", "gdd",
]
WORST_COLUMNS = [
    "year", "state_abbr", "county_name", "commodity", "pred_yield", "irrigation", "avg_precip_mm", "heat_stress_days", "gdd",
]
TIES = ["year", "state_abbr", "county_name", "commodity", "irrigation"]


def top_anomalies(rows: DataFrame, k: int = 10) -> DataFrame:
    flagged = rows.filter(F.col("anomaly_flag") == 1)
    return grouping.top_abs(flagged, "signed_residual", k, [*TIES, "yield_amount", "pred_yield"]).select(*TOP_COLUMNS)


def lowest_predictions(rows: DataFrame, k: int = 10) -> DataFrame:
    return grouping.bottom_k(rows, "pred_yield", k, TIES).select(*WORST_COLUMNS)


def window_span(rows: DataFrame) -> DataFrame:
    def known(c):
        return F.when(F.col(c) != "", F.col(c))

    return rows.agg(F.min(known("noaa_window_start")).alias("window_start"), F.max(known("noaa_window_end")).alias("window_end"),
                    F.count(F.lit(1)).alias("n_rows"))


def insights(rows: DataFrame, pred_rows: DataFrame) -> DataFrame:
    """Headline sentences of the report, one row each, from one-row aggregates."""
    years = reports.year_extremes(rows).filter(F.col("worst_year").isNotNull()).select(F.explode(F.array(
        F.struct(F.lit(1).alias("position"), F.format_string(
            "Weakest year: %d, with yields %.1f bu/ac under prediction on average over %d county records.",
            "worst_year", F.abs("worst_mean"), "worst_n").alias("sentence")),
        F.struct(F.lit(2).alias("position"), F.format_string(
            "Best year: %d, with yields %+.1f bu/ac against prediction on average.",
            "best_year", "best_mean").alias("sentence")),
    )).alias("i")).select("i.*")
    states = reports.anomaly_by_state(rows.filter(F.col("state_abbr") != ""), 1).select(
        F.lit(3).alias("position"), F.format_string(
            "Most flagged records: %s with %d.", "state_abbr", "anomalies"
        ).alias("sentence"))
    hero = reports.hero_kpis(rows).filter(F.col("total_records") > 0).select(
        F.lit(4).alias("position"), F.format_string(
            "Flagged records: %,d of %,d (%.1f%%).", "anomaly_count", "total_records",
            F.col("anomaly_rate") * 100).alias("sentence"))
    span = window_span(pred_rows).filter(F.col("window_start").isNotNull() & F.col("window_end").isNotNull()).select(
        F.lit(5).alias("position"), F.format_string(
            "Prediction-only records: %,d, from weather between %s and %s.",
            "n_rows", "window_start", "window_end").alias("sentence"))
    return years.unionAll(states).unionAll(hero).unionAll(span).filter(F.col("sentence").isNotNull())


def report(hist: DataFrame, pred: DataFrame, only=None) -> dict[str, DataFrame]:
    """Executive report tables."""
    rows, pred_rows = clean_history(hist), clean_predictions(pred)
    named = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("state_abbr", "commodity")})
    return chosen({
        "hero": lambda: reports.hero_kpis(named),
        "insights": lambda: insights(named, pred_rows),
        "top_anomalies": lambda: top_anomalies(rows),
        "worst_predicted": lambda: lowest_predictions(pred_rows),
        "anomaly_by_state": lambda: reports.anomaly_by_state(named),
        "anomaly_trend": lambda: reports.anomaly_trend(rows),
        "noaa_window": lambda: window_span(pred_rows),
    }, only)


def predictor_options(hist: DataFrame, pred: DataFrame, only=None) -> dict[str, DataFrame]:
    return chosen({
        "years": lambda: lookup.option_values("year", hist, pred),
        "commodities": lambda: lookup.option_values("commodity", hist, pred),
        "counties": lambda: lookup.counties_by_state(hist, pred),
    }, only)


def predictor_lookup(
    hist: DataFrame, pred: DataFrame, year: int, crop: str, state=None, county=None, irrigation=None, limit: int | None = None,
    first: int = lookup.FIRST_PREDICTION_YEAR, only=None,
) -> dict[str, DataFrame]:
    """Distribution, county breakdown and weather context of matching predictions.

    Statistics cover all matching rows; a limit only cuts the listed ones.
    """
    table = lookup.pick_table(hist, pred, year, first)
    match = lookup.lookup_filter(year, crop, state, county, irrigation)
    rows = table.filter(match)
    return chosen({
        "stats": lambda: reports.distribution(rows, "pred_yield"),
        "by_county": lambda: reports.by_county(rows),
        "weather_summary": lambda: reports.weather_context(rows),
        "rows": lambda: lookup.lookup(table, match, limit),
        "sample_rows": lambda: lookup.lookup(table, match, 50),
        "noaa_window": lambda: window_span(rows),
    }, only)


def _model_page(test: DataFrame, train_rows: DataFrame, hero: DataFrame, anomalies_: DataFrame, only=None) -> dict[str, DataFrame]:
    return chosen({
        "hero": lambda: hero,
        "train_rows": lambda: train_rows,
        "r2_by_crop_region": lambda: metrics.r2_grid(test, region=REGIONS, commodity=CROPS),
        "r2_by_crop": lambda: metrics.r2_grid(test, commodity=CROPS),
        "residual_by_year": lambda: metrics.residual_by_year(test),
        "scatter": lambda: test.select("yield_amount", "pred_yield", "commodity", "year", "state_abbr", "county_name"),
        "anomalies": lambda: anomalies_,
    }, only)


def model_dashboard_history(hist: DataFrame, regions: DataFrame, first_test_year: int = 2021, only=None) -> dict[str, DataFrame]:
    """Model page computed from the scored history."""
    rows = features.with_region(clean_history(hist), regions, "")
    valid = rows.filter(
        (F.col("region") != "") & F.col("yield_amount").isNotNull() & F.col("pred_yield").isNotNull()
        & F.col("commodity").isin(list(CROPS))
    ).withColumn("signed_residual", F.col("yield_amount") - F.col("pred_yield"))
    test = valid.filter(F.col("year") >= first_test_year)
    hero = test.agg(*[e.alias(n) for n, e in metrics.metric_columns().items()], F.max("year").alias("test_year_max"))
    trained = valid.filter(F.col("year") < first_test_year).agg(F.count(F.lit(1)).alias("train_rows"))
    flagged = test.agg(F.count_if(F.col("anomaly_flag") == 1).alias("anomaly_count"), F.count(F.lit(1)).alias("n"))
    return _model_page(test, trained, hero, flagged, only)


def model_dashboard_stored(test: DataFrame, stats: DataFrame, only=None) -> dict[str, DataFrame]:
    """Model page from stored test predictions; stored metrics win over computed ones."""
    rows = features.residuals(
        test.filter(as_num("yield_amount").isNotNull() & as_num("pred_yield").isNotNull()), stored="signed_residual")
    computed = rows.agg(
        *[e.alias(n) for n, e in metrics.metric_columns().items()],
        F.min("year").alias("test_year_min"), F.max("year").alias("test_year_max"), F.lit(0).alias("train_rows"),
    )
    hero = metrics.coalesce_stats(computed, stats, {
        "r2": "test_r2", "mae": "test_mae", "rmse": "test_rmse", "test_year_min": "test_year_min",
        "test_year_max": "test_year_max", "train_rows": "train_rows",
    })
    return _model_page(rows, hero.select("train_rows"), hero, anomalies.z_outlier_count(rows), only)


def model_dashboard(test: DataFrame | None, stats: DataFrame | None, hist: DataFrame, regions: DataFrame, first_test_year=2021):
    """Stored test predictions when there are any, else the scored history."""
    if test is not None and not test.isEmpty():
        return model_dashboard_stored(test, stats)
    return model_dashboard_history(hist, regions, first_test_year)
