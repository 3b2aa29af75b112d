"""Yield reports: cleaning and the join with county weather."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

# Header texts of the public county yield report.
REPORT_COLUMNS = {
    "County Code": "county_fips",
    "State Code": "state_fips",
    "County Name": "county_name",
    "State Abbreviation": "state_abbr",
    "Commodity Name": "commodity",
    "Yield Year": "year",
    "Yield Amount": "yield_amount",
    "Irrigation Practice Name": "irrigation",
}
WHOLE = ("county_fips", "state_fips", "year")


def clean_yields(df: DataFrame, columns: Mapping[str, str] = REPORT_COLUMNS) -> DataFrame:
    """Short names, whole-number keys (unreadable text becomes NULL), rows with a yield only."""
    return df.select(*[
        (F.col(f"`{header}`").try_cast("int") if name in WHOLE else F.col(f"`{header}`")).alias(name)
        for header, name in columns.items()
    ]).filter(F.col("yield_amount").isNotNull())


def merge_yield_weather(yields: DataFrame, weather: DataFrame, keys=("state_fips", "county_fips", "year")) -> DataFrame:
    """Yields with the weather of their county and year."""
    return yields.join(weather, list(keys), "inner")
