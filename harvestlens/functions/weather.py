"""Daily weather expressions: units, quality, heat units, day and season flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from harvestlens.functions.numeric import to_column

# Agronomic thresholds, crop calendars and state boxes.
HEAT_C = 35.0
COLD_C = -10.0
HEAVY_RAIN_MM = 25.0
SEASON_HEAVY_RAIN_TENTHS = 500
GDD_BASE_C, GDD_CAP_C = 10, 30
GDD_BASE_F, GDD_CAP_F = 50.0, 86.0
DROUGHT_MM, DROUGHT_HEAT_DAYS = 200, 10
FLOOD_RAIN_DAYS = 5
EXTREME_HEAT_DAYS = 20
GROWTH_PHASES = {
    "corn": {
        "planting": [4, 5],
        "vegetative_early": [6],
        "tasseling_silking": [7],
        "grain_fill": [8],
        "maturity_harvest": [9, 10],
    },
    "soy": {
        "planting": [5],
        "vegetative": [6],
        "flowering": [7],
        "pod_fill": [8],
        "maturity_harvest": [9, 10],
    },
}
DORMANT = "dormant"
# state: (south, north, west, east); earlier states win where boxes overlap
STATE_BOXES = {
    "IA": (40.375, 43.501, -96.639, -90.140),
    "IL": (36.970, 42.508, -91.513, -87.020),
    "IN": (37.772, 41.760, -88.098, -84.784),
    "NE": (40.002, 43.001, -104.053, -95.308),
    "MN": (43.499, 49.384, -97.239, -89.489),
}
CORN_BELT_BOX = (36.0, 49.5, -104.5, -84.5)
QUALITY_MARK = "S"


def from_tenths(c, scale: int = 10) -> Column:
    return to_column(c) / F.lit(float(scale))


def drop_negative(c) -> Column:
    """Sentinel nulling: negative readings stand for missing."""
    c = to_column(c)
    return F.when(c >= 0, c)


def quality_mask(c, attrs, mark: str = QUALITY_MARK) -> Column:
    """The reading where its attributes lack the mark; a missing attribute text drops the reading too."""
    return F.when(~to_column(attrs).contains(mark), to_column(c))


def c_to_f(c) -> Column:
    return to_column(c) * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)


def in_months(month, months: Sequence[int]) -> Column:
    return to_column(month).isin([int(m) for m in months])


def in_season(month, first: int, last: int) -> Column:
    """Month range; wraps over the new year when first > last."""
    month = to_column(month)
    if first <= last:
        return month.between(first, last)
    return (month >= first) | (month <= last)


def growth_phase(month, crop: str, calendar: Mapping[str, Mapping[str, Sequence[int]]] = GROWTH_PHASES) -> Column:
    """Crop stage of a month from a calendar given as {stage: months}."""
    stages = [F.when(in_months(month, months), F.lit(stage)) for stage, months in calendar[crop].items()]
    return F.coalesce(*stages, F.lit(DORMANT))


def gdd_c(tmax, tmin, base=GDD_BASE_C, cap=GDD_CAP_C, scale: int = 10, null_guard: bool = True) -> Column:
    """Celsius heat units in raw tenths: the mean capped, minus the base, never negative.

    Without the guard a missing mean scores as the cap does, because least() skips NULLs.
    """
    mean = (to_column(tmax) + to_column(tmin)) / 2
    units = F.greatest(F.least(mean, F.lit(float(cap * scale))) - F.lit(float(base * scale)), F.lit(0.0))
    return F.when(mean.isNotNull(), units) if null_guard else units


def gdd_f(tmax_f, tmin_f, base=GDD_BASE_F, cap: float | None = GDD_CAP_F) -> Column:
    """Fahrenheit heat units. With a cap, the high is cut to it and the low raised to the base first."""
    high, low = to_column(tmax_f), to_column(tmin_f)
    known = high.isNotNull() & low.isNotNull()
    if cap is not None:
        high, low = F.least(high, F.lit(cap)), F.greatest(low, F.lit(base))
    return F.when(known, F.greatest(F.lit(0.0), (high + low) / 2 - F.lit(base)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def day_flags(tmax_c, tmin_c, rain_mm, frost_inclusive: bool = True) -> dict[str, Column]:
    """Stress flags of one day, from values in °C and mm."""
    tmax_c, tmin_c, rain_mm = to_column(tmax_c), to_column(tmin_c), to_column(rain_mm)
    return {
        "heat_stress_flag": flag(tmax_c > HEAT_C),
        "frost_flag": flag(tmin_c <= 0.0 if frost_inclusive else tmin_c < 0.0),
        "extreme_cold_flag": flag(tmin_c < COLD_C),
        "heavy_rain_flag": flag(rain_mm > HEAVY_RAIN_MM),
        "dry_day_flag": flag(rain_mm == 0),
    }


def season_flags(
    rain_mm, heat_days, rain_days, drought_mm=DROUGHT_MM, drought_heat=DROUGHT_HEAT_DAYS,
    flood_days=FLOOD_RAIN_DAYS, heat_limit=EXTREME_HEAT_DAYS,
) -> dict[str, Column]:
    """Drought, flood and extreme-heat flags of one season."""
    rain_mm, heat_days, rain_days = to_column(rain_mm), to_column(heat_days), to_column(rain_days)
    return {
        "drought_flag": flag((rain_mm < drought_mm) & (heat_days > drought_heat)),
        "flood_flag": flag(rain_days > flood_days),
        "extreme_heat_flag": flag(heat_days > heat_limit),
    }


def in_box(lat, lon, box: Sequence[float]) -> Column:
    south, north, west, east = box
    return to_column(lat).between(south, north) & to_column(lon).between(west, east)


def state_by_box(lat, lon, boxes: Mapping[str, Sequence[float]] = STATE_BOXES, other: str = "OTHER") -> Column:
    """First state whose box holds the point."""
    chain = F
    for state, box in boxes.items():
        chain = chain.when(in_box(lat, lon, box), F.lit(state))
    return chain.otherwise(F.lit(other))


def in_any_box(lat, lon, boxes: Mapping[str, Sequence[float]] = STATE_BOXES) -> Column:
    return reduce(lambda a, b: a | b, [in_box(lat, lon, box) for box in boxes.values()])
