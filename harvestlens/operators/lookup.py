"""Filtered lookups, option lists and table alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from harvestlens.functions.numeric import all_of
from harvestlens.functions.text import flag_is, norm_crop

FIRST_PREDICTION_YEAR = 2024
FEATURE_COLUMNS = [
    "avg_temp_max_c", "avg_temp_min_c", "avg_temp_mean_c", "peak_temp_max_c", "heat_stress_days", "avg_precip_mm",
    "precip_std_mm", "dry_days", "heavy_rain_days", "gdd", "frost_days", "winter_snowfall_mm", "snow_days",
]


def in_list(c: str, values: Sequence) -> Column:
    return F.col(c).isin(list(values))


def lookup_filter(
    year: int, crop: str, state: str | None = None, county: str | None = None, irrigation: int | None = None
) -> Column:
    """Predicate of a prediction lookup; unset criteria are left out, a county needs its state."""
    tests = [
        F.col("year") == int(year), F.col("pred_yield").isNotNull(), F.upper("commodity") == F.upper(F.lit(crop)),
    ]
    if state:
        tests.append(F.col("state_abbr") == state)
        if county:
            tests.append(F.trim("county_name") == county.strip())
    if irrigation in (0, 1):
        tests.append(flag_is("irrigation", irrigation))
    return all_of(tests)


def align(df: DataFrame, like: DataFrame | T.StructType) -> DataFrame:
    """Columns of another table in its order; absent ones become typed NULLs."""
    schema = like if isinstance(like, T.StructType) else like.schema
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def unified_predictions(historical: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scored history and prediction-only rows as one table."""
    return historical.unionByName(predictions, allowMissingColumns=True)


def pick_table(historical: DataFrame, predictions: DataFrame, year: int, first: int = FIRST_PREDICTION_YEAR):
    """The table that holds a year: history before `first`, predictions from then on, in one shape."""
    both = unified_predictions(historical.limit(0), predictions.limit(0)).schema
    return align(predictions if year >= first else historical, both)


def lookup(df: DataFrame, condition: Column, limit: int | None = None) -> DataFrame:
    """Matching rows, best prediction first; ties follow the row's key."""
    rows = df.filter(condition).orderBy(F.col("pred_yield").desc(), "state_abbr", F.trim("county_name"), "commodity", "irrigation")
    return rows if limit is None else rows.limit(limit)


def feature_lookup(df: DataFrame, state: str, county: int, year: int, crop: str, irrigated: int) -> DataFrame:
    """The season measures of one county, or the mean over its state when the county number is 0.

    A lookup without matching rows gives no row.
    """
    label = "Irrigated" if irrigated else "Non-Irrigated"
    state = state.strip().upper()
    match = (
        (F.col("state_abbr") == state) & (F.col("year") == int(year)) & (F.col("commodity") == norm_crop(F.lit(crop), True))
        & (F.trim("irrigation") == label)
    )
    shown = [F.lit(state).alias("state_abbr"), F.lit(int(year)).alias("year"), F.lit(irrigated).alias("is_irrigated")]
    if county > 0:
        rows = df.filter(match & (F.col("county_fips") == int(county)))
        return rows.select(
            "state_fips", "county_fips", *shown, "commodity", *FEATURE_COLUMNS, F.col("yield_amount").alias("actual_yield")
        ).orderBy("state_fips", "county_fips", "actual_yield", *FEATURE_COLUMNS).limit(1)
    return state_features_lookup(df.filter(match)).select(
        "state_fips", F.lit(0).alias("county_fips"), *shown, F.col("commodity"), *FEATURE_COLUMNS, "actual_yield"
    )


def state_features_lookup(rows: DataFrame) -> DataFrame:
    """Mean season measures over the given rows; nothing when there are none."""
    return rows.agg(
        F.count(F.lit(1)).alias("__n"), F.max("state_fips").alias("state_fips"), F.max("commodity").alias("commodity"),
        *[F.avg(c).alias(c) for c in FEATURE_COLUMNS], F.avg("yield_amount").alias("actual_yield"),
    ).filter(F.col("__n") > 0).drop("__n")


def option_values(col: str, *tables: DataFrame) -> DataFrame:
    """Distinct non-null values of a column over several tables."""
    out = None
    for t in tables:
        part = t.select(col).filter(F.col(col).isNotNull()).distinct()
        out = part if out is None else out.union(part)
    return out.distinct()


def counties_by_state(*tables: DataFrame) -> DataFrame:
    """Distinct state/county pairs over several tables, one row per pair."""
    out = None
    for t in tables:
        part = t.select("state_abbr", F.trim("county_name").alias("county_name")).distinct()
        out = part if out is None else out.union(part)
    return out.filter(
        F.col("state_abbr").isNotNull() & F.col("county_name").isNotNull() & (F.col("county_name") != "")
    ).distinct()
