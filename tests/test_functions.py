"""Column expressions on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from harvestlens.functions import labels, numeric, text, weather as wx


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def applied(spark, values, kind, expr):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(expr).collect()]


def test_messy_flags(spark):
    words = ["0", "1", "1.0", " Irrigated", " Non-Irrigated", "", "null", "2", "nan", "-3", "maybe", None, "TRUE", "0.4"]
    assert applied(spark, words, "string", text.norm_flag("v")) == [0, 1, 1, 1, 0, None, None, 1, None, 0, None, None, 1, 0]


def test_crop_labels(spark):
    assert applied(spark, [" corn", "SOY", "soybean", "wheat", None], "string", text.norm_crop("v")) == [
        "Corn", "Soybeans", "Soybeans", None, None]
    with pytest.raises(Exception, match="unsupported crop"):
        applied(spark, ["wheat"], "string", text.norm_crop("v", strict=True))


def test_numbers_from_text(spark):
    assert applied(spark, ["abc", "1.9", "NaN", None], "string", numeric.as_num("v")) == [None, 1.9, None, None]
    assert applied(spark, ["-1.9", "x"], "string", numeric.as_int("v", 7)) == [-1, 7]


def test_geo_keys(spark):
    assert applied(spark, [1, 17], "int", text.geoid("v", F.col("v") * 3)) == ["01003", "17051"]
    assert applied(spark, ["/a/tulip/x.jpg"], "string", text.path_parts("v")[0]) == ["tulip"]


def test_heat_units_with_missing_temperature(spark):
    rows = spark.createDataFrame([(None, 100), (400, 300), (200, 100), (50, 0)], "hi int, lo int")
    guarded = [r[0] for r in rows.select(wx.gdd_c("hi", "lo")).collect()]
    literal = [r[0] for r in rows.select(wx.gdd_c("hi", "lo", null_guard=False)).collect()]
    assert guarded == [None, 200.0, 50.0, 0.0]
    assert literal == [200.0, 200.0, 50.0, 0.0]


def test_fahrenheit_heat_units(spark):
    rows = spark.createDataFrame([(96.0, 40.0), (None, 60.0)], "hi double, lo double")
    assert [r[0] for r in rows.select(wx.gdd_f("hi", "lo")).collect()] == [18.0, None]
    assert [r[0] for r in rows.select(wx.gdd_f("hi", "lo", cap=None)).collect()] == [18.0, None]
    cool = spark.createDataFrame([(90.0, 30.0)], "hi double, lo double")
    assert cool.select(wx.gdd_f("hi", "lo"), wx.gdd_f("hi", "lo", cap=None)).first()[:] == (18.0, 10.0)


def test_quality_mask_drops_rows_without_attributes(spark):
    rows = spark.createDataFrame([(10, ",S,"), (10, ",,W"), (10, None)], "v int, a string")
    assert [r[0] for r in rows.select(wx.quality_mask("v", "a")).collect()] == [None, 10, None]


def test_frost_boundary(spark):
    def frost(inclusive):
        return applied(spark, [0.0, -0.1, None], "double", wx.day_flags(F.lit(0.0), "v", F.lit(0.0), inclusive)["frost_flag"])

    assert frost(True) == [1, 1, 0]
    assert frost(False) == [0, 1, 0]


def test_day_flag_limits(spark):
    flags = wx.day_flags("v", F.lit(5.0), F.lit(25.1))
    assert applied(spark, [35.0, 35.1], "double", flags["heat_stress_flag"]) == [0, 1]
    assert applied(spark, [1.0], "double", flags["heavy_rain_flag"]) == [1]


def test_season_wraps_over_new_year(spark):
    assert applied(spark, [9, 10, 12, 1, 3, 4], "int", wx.in_season("v", 10, 3)) == [False, True, True, True, True, False]


def test_growth_phase(spark):
    assert applied(spark, [4, 7, 12], "int", wx.growth_phase("v", "corn")) == ["planting", "tasseling_silking", "dormant"]
    assert applied(spark, [4, 7, 12], "int", wx.growth_phase("v", "soy")) == ["dormant", "flowering", "dormant"]


def test_first_matching_state_box_wins(spark):
    rows = spark.createDataFrame([(40.5, -91.0), (40.5, -88.0), (10.0, 10.0)], "lat double, lon double")
    assert [r[0] for r in rows.select(wx.state_by_box("lat", "lon")).collect()] == ["IA", "IL", "OTHER"]


def test_outcome_of_unknown_flags(spark):
    rows = spark.createDataFrame(
        [(0, 1, 9.0), (1, 1, 1.9), (1, 0, -2.0), (1, 1, 2.0), (1, 0, 1.0), (None, 1, 1.0), (None, None, None)],
        "a int, w int, z double")
    got = [r[0] for r in rows.select(labels.outcome_category("a", "w", "z")).collect()]
    assert got == [labels.OUTCOME_NORMAL, labels.OUTCOME_HANDLED, labels.OUTCOME_UNEXPLAINED, labels.OUTCOME_IMPACT,
                   labels.OUTCOME_IMPACT, labels.OUTCOME_HANDLED, labels.OUTCOME_IMPACT]


def test_weather_event_precedence(spark):
    rows = spark.createDataFrame(
        [(2.1, -1.6), (2.1, 0.0), (-2.1, 0.0), (0.0, 2.1), (0.0, -2.1), (1.6, -1.1), (-0.6, 1.6), (0.0, 0.0)], "t double, p double")
    got = [r[0] for r in rows.select(labels.weather_event_type("t", "p")).collect()]
    assert got == ["HOT_DRY_EXTREME", "HEAT_WAVE", "COLD_EXTREME", "FLOOD_RISK", "DROUGHT", "HOT_DRY", "COOL_WET", "NORMAL"]


def test_yield_classes(spark):
    assert applied(spark, [-1.6, -0.6, -0.5, 0.0, 0.6, 1.5, 1.6, None], "double", labels.yield_category_z("v")) == [
        "VERY_LOW", "BELOW_AVG", "NORMAL", "NORMAL", "ABOVE_AVG", "ABOVE_AVG", "VERY_HIGH", "NORMAL"]
    assert applied(spark, [180.0, 110.0, 109.9], "double", labels.yield_category_abs("v", F.lit("CORN"))) == ["excellent", "average", "poor"]


def test_event_label_precedence(spark):
    rows = spark.createDataFrame([(1, 1, 1), (0, 1, 1), (0, 0, 1), (0, None, 0)], "d int, f int, h int")
    assert [r[0] for r in rows.select(labels.event_label("d", "f", "h")).collect()] == ["Drought", "Flood", "Extreme Heat", "Normal"]


def test_bins_keep_their_edges(spark):
    assert applied(spark, [14.9, 15.0, None], "double", numeric.bin_by("v", [15], ["low", "high"])) == ["low", "high", "high"]
    assert applied(spark, [0.0, 5.0, 5.1], "double", numeric.bin_by("v", [0, 5], ["none", "few", "many"], "right")) == ["none", "few", "many"]


def test_safe_ratio(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in rows.select(numeric.safe_div("a", "b")).collect()] == [0.0, 0.5, 0.0]
