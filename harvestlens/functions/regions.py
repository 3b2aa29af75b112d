"""State groupings and weather-driver groups as lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The regional groupings in use; `default` is the region of any other state.
REGION_SETS = {
    "dashboard": {
        "default": None,
        "Midwest": ["IL", "IN", "IA", "MI", "MN", "MO", "OH", "WI"],
        "Plains": ["KS", "NE", "ND", "SD", "OK", "TX"],
        "South": ["AL", "AR", "FL", "GA", "KY", "LA", "MS", "NC", "SC", "TN", "VA"],
    },
    "scoring": {
        "default": "midwest",
        "midwest": ["IA", "IL", "IN", "MI", "MN", "MO", "ND", "OH", "SD", "WI"],
        "plains": ["CO", "KS", "MT", "NE", "OK", "TX", "WY"],
        "south": ["AL", "AR", "FL", "GA", "KY", "LA", "MS", "NC", "SC", "TN", "VA", "MD", "DE"],
    },
    "training": {
        "default": "Other",
        "Midwest": ["IA", "IL", "IN", "MI", "MN", "MO", "OH", "WI", "NY", "PA", "VT", "CT", "MA", "ME", "NH", "RI", "NJ"],
        "Plains": ["CO", "KS", "MT", "ND", "NE", "OK", "SD", "WY"],
        "South": ["AL", "AR", "GA", "KY", "LA", "MS", "NC", "SC", "TN", "TX", "VA", "WV", "MD", "DE"],
    },
    "summary": {
        "default": "Other",
        "Midwest": ["IA", "IL", "IN", "KS", "MI", "MN", "MO", "ND", "NE", "OH", "SD", "WI"],
        "South": ["AL", "AR", "KY", "MD", "NC", "SC", "TN", "TX"],
        "Northeast": ["NY", "PA"],
        "West": ["CO"],
    },
    "map": {
        "default": "Other US",
        "Midwest": ["IA", "IL", "IN", "OH", "WI", "MN", "MO", "NE", "KS", "ND", "SD", "MI"],
        "Southeast": ["MS", "AL", "GA", "NC", "SC", "TN", "KY", "LA", "AR", "FL"],
        "South Central": ["TX", "OK"],
        "West": ["CA", "WA", "OR", "ID", "CO"],
    },
}
# Weather features by what drives the yield.
DRIVER_GROUPS = {
    "Heat stress": [
        "heat_stress_days", "peak_temp_max_c", "avg_temp_max_c", "extreme_heat_flag", "gdd", "avg_temp_mean_c",
    ],
    "Water availability": ["avg_precip_mm", "dry_days", "drought_flag", "flood_flag", "winter_snowfall_mm"],
    "Timing / variability": ["heavy_rain_days", "precip_std_mm", "frost_days"],
}
OTHER_DRIVER = "Other"


def region_table(spark: SparkSession, name: str) -> DataFrame:
    """Region lookup as a table of at most one row per state."""
    rows = [(s, r) for r, states in REGION_SETS[name].items() if r != "default" for s in states]
    return spark.createDataFrame(rows, "state_abbr string, region string")


def driver_table(spark: SparkSession) -> DataFrame:
    rows = [(f, g) for g, features in DRIVER_GROUPS.items() for f in features]
    return spark.createDataFrame(rows, "feature string, driver_group string")
