"""Longest runs of days and rolling sums. Rows are first reduced to one per station and day, so a
window over station and year never holds more than one calendar year of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window

from harvestlens.functions import weather as wx


def daily_total(df: DataFrame, value: str, by: Sequence[str] = ("station",), date: str = "date") -> DataFrame:
    """One row per key and date: the summed value, its year and month."""
    return df.groupBy(*by, date).agg(F.sum(value).alias(value)).withColumns(
        {"year": F.year(date), "month": F.month(date)}
    )


def longest_run(daily: DataFrame, flag, by: Sequence[str] = ("station", "year"), date: str = "date") -> DataFrame:
    """Longest streak of flagged consecutive calendar days per group; a missing day ends a streak.

    `daily` must hold one row per group and date.
    """
    flagged = daily.filter(flag)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(date))
    islands = flagged.select(*by, date, F.date_sub(date, place).alias("__island"))
    streaks = islands.groupBy(*by, "__island").agg(F.count(F.lit(1)).alias("days"), F.min(date).alias("start"))
    best = F.max_by(F.struct("days", "start"), F.struct(F.col("days"), F.datediff(F.lit("9999-12-31"), "start")))
    return streaks.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.days").alias("longest_run_days"), F.col("b.start").alias("run_start")
    )


def longest_dry_run(df: DataFrame, rain: str = "precip_mm", months: tuple[int, int] | None = None) -> DataFrame:
    """Longest dry spell per station-year over days with known rain."""
    daily = daily_total(df.filter(F.col(rain).isNotNull()), rain)
    if months:
        daily = daily.filter(wx.in_season("month", *months))
    return longest_run(daily, F.col(rain) == 0)


def rolling_max_sum(
    daily: DataFrame, value: str, days: int, by: Sequence[str] = ("station", "year"), date: str = "date"
) -> DataFrame:
    """Largest sum over any `days` calendar days ending on an observed day, per group."""
    place = F.datediff(F.col(date), F.lit("1970-01-01"))
    w = Window.partitionBy(*by).orderBy(place).rangeBetween(-(days - 1), 0)
    return daily.withColumn("__burst", F.sum(value).over(w)).groupBy(*by).agg(
        F.max("__burst").alias(f"max_{days}day_{value}")
    )
