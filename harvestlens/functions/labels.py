"""Category labels built from flags, z-scores and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from harvestlens.functions.numeric import to_column

# Label texts and thresholds.
OUTCOME_NORMAL = "Normal"
OUTCOME_HANDLED = "Extreme Weather Model Handled"
OUTCOME_UNEXPLAINED = "Yield Mismatch / Unexplained"
OUTCOME_IMPACT = "Extreme Weather Yield Impact"
TYPE_IMPACT = "Extreme Weather → Yield Impact"
TYPE_MISMATCH = "Yield Mismatch (unexplained)"
TYPE_HANDLED = "Extreme Weather (model handled)"
YIELD_LIMITS = {"corn": (180, 150, 110), "soybeans": (55, 45, 35)}
YIELD_WORDS = ("excellent", "good", "average", "poor")
HIGH_YIELD, LOW_YIELD = "high_yield_vs_weather", "low_yield_vs_weather"


def outcome_category(anomaly, weather, z) -> Column:
    """Four-way outcome. Rows that no earlier rule settles, NULL flags included, count as impact."""
    anomaly, weather, size = to_column(anomaly), to_column(weather), F.abs(to_column(z))
    return (
        F.when(anomaly == 0, F.lit(OUTCOME_NORMAL))
        .when((weather == 1) & (size < 2), F.lit(OUTCOME_HANDLED))
        .when((weather == 0) & (size >= 2), F.lit(OUTCOME_UNEXPLAINED))
        .otherwise(F.lit(OUTCOME_IMPACT))
    )


def anomaly_type(anomaly, weather) -> Column:
    """Combined label of the two 0/1 flags."""
    a, w = to_column(anomaly).cast("int"), to_column(weather).cast("int")
    return (
        F.when((a == 1) & (w == 1), F.lit(TYPE_IMPACT))
        .when((a == 1) & (w == 0), F.lit(TYPE_MISMATCH))
        .when((a == 0) & (w == 1), F.lit(TYPE_HANDLED))
        .otherwise(F.lit("Normal"))
    )


def weather_event_type(temp_z, rain_z) -> Column:
    """Eight-way label of a month from its temperature and rain z-scores; the first rule that fits wins."""
    t, p = to_column(temp_z), to_column(rain_z)
    rules = [
        ("HOT_DRY_EXTREME", (t > 2.0) & (p < -1.5)),
        ("HEAT_WAVE", t > 2.0),
        ("COLD_EXTREME", t < -2.0),
        ("FLOOD_RISK", p > 2.0),
        ("DROUGHT", p < -2.0),
        ("HOT_DRY", (t > 1.5) & (p < -1.0)),
        ("COOL_WET", (p > 1.5) & (t < -0.5)),
    ]
    return F.coalesce(*[F.when(rule, F.lit(label)) for label, rule in rules], F.lit("NORMAL"))


def yield_category_z(z) -> Column:
    """Five-way yield class of a z-score."""
    z = to_column(z)
    return (
        F.when(z < -1.5, F.lit("VERY_LOW"))
        .when(z < -0.5, F.lit("BELOW_AVG"))
        .when(z > 1.5, F.lit("VERY_HIGH"))
        .when(z > 0.5, F.lit("ABOVE_AVG"))
        .otherwise(F.lit("NORMAL"))
    )


def yield_category_abs(value, crop) -> Column:
    """Yield class by per-crop thresholds; any crop but corn uses the soybean limits."""
    value, is_corn = to_column(value), F.lower(to_column(crop)) == "corn"

    def words(limits):
        return F.coalesce(*[F.when(value >= x, F.lit(w)) for x, w in zip(limits, YIELD_WORDS)], F.lit(YIELD_WORDS[-1]))

    return F.when(is_corn, words(YIELD_LIMITS["corn"])).otherwise(words(YIELD_LIMITS["soybeans"]))


def mismatch_label(yield_z, temp_z, rain_z) -> Column:
    """Where the yield departs from what its weather suggests."""
    y, t, p = to_column(yield_z), to_column(temp_z), to_column(rain_z)
    calm = (F.abs(t) <= 0.5) & (F.abs(p) <= 0.5)
    rules = [
        ("HIGH_YIELD_DESPITE_HOT_DRY", (y > 1.0) & (t > 1.0) & (p < -1.0)),
        ("LOW_YIELD_NORMAL_WEATHER", (y < -1.0) & calm),
        ("LOW_YIELD_EXTREME_WEATHER", (y < -1.5) & ((t > 1.5) | (p < -1.5))),
    ]
    return F.coalesce(*[F.when(rule, F.lit(label)) for label, rule in rules], F.lit("CONSISTENT"))


def event_label(drought, flood, heat) -> Column:
    """One event name per season; drought outranks flood, flood outranks heat."""
    return (
        F.when(to_column(drought) == 1, F.lit("Drought"))
        .when(to_column(flood) == 1, F.lit("Flood"))
        .when(to_column(heat) == 1, F.lit("Extreme Heat"))
        .otherwise(F.lit("Normal"))
    )


def two_sided_label(value, limit, high: str = HIGH_YIELD, low: str = LOW_YIELD, inclusive: bool = False) -> Column:
    """`high` above the limit, `low` below its negative, empty text between; unknown values stay empty."""
    value, limit = to_column(value), F.lit(limit) if not isinstance(limit, Column) else limit
    over = value >= limit if inclusive else value > limit
    under = value <= -limit if inclusive else value < -limit
    return F.when(over, F.lit(high)).when(under, F.lit(low)).otherwise(F.lit(""))
