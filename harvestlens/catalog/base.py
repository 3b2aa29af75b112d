"""Domain tables derived from the given tables.

The derivations are plain SQL that Spark and DuckDB both accept, so the registered SQL texts start from the
same rows. Everything downstream is written twice: as DataFrame operators, and as SQL for the check.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from harvestlens.functions.regions import REGION_SETS
from harvestlens.operators import anomalies, seasons, yields
from harvestlens.plans import etl, studies
from harvestlens.session import file_state, fresh_folder

# One state per nation number, by position.
STATES = "IAILINNEMNMOKSNDSDOHWIMIKYTNARALMSLATXOKNCSCVAGACO"
COUNTIES = 4
# Wider than any data: the daily chain reads every year.
YEARS = (1900, 2100)
TEST_FROM = 1999
PREDICT_FROM = 2000
LIMITS = {"drought_mm": 800, "drought_heat": 15, "flood_days": 12, "heat_limit": 19}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

STATION = "concat(CASE WHEN {k} % 10 = 9 THEN 'CA' ELSE 'US' END, lpad(cast({k} AS string), 9, '0'))"
STATE = f"substr('{STATES}', cast({{k}} AS int) * 2 + 1, 2)"
RAW_MAX = "50 + 45 * (6 - abs(month(l_shipdate) - 7)) + cast(l_quantity AS int) * 3"
COLD = "month(l_shipdate) IN (11, 12, 1, 2, 3)"

DERIVED = {
    # one observation per line item; measures in tenths
    "wx": f"""
        SELECT {STATION.format(k='l_suppkey')} AS station, cast(l_shipdate AS date) AS date,
          (350 + (l_suppkey * 37) % 150) / 1e1 AS latitude, (-1060 + (l_suppkey * 53) % 220) / 1e1 AS longitude,
          (l_suppkey % 400) * 1e0 AS elevation, concat('STATION ', cast(l_suppkey AS string)) AS name,
          CASE WHEN l_suppkey % 10 = 9 THEN 'CA' ELSE 'US' END AS group_,
          CASE WHEN l_suppkey % 10 = 9 AND l_orderkey % 7 = 0 THEN -9999
            WHEN l_linenumber <= 3 THEN 0 ELSE cast(l_quantity AS int) * 15 END AS precipitation,
          CASE WHEN {COLD} AND l_linenumber >= 5 THEN cast(l_quantity AS int) ELSE 0 END AS snowfall,
          CASE WHEN l_linenumber = 1 THEN NULL WHEN {COLD} THEN cast(l_partkey % 30 AS int) * 10 ELSE 0 END AS snow_depth,
          CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE cast({RAW_MAX} AS int) END AS temp_max,
          CASE WHEN l_orderkey % 47 = 0 THEN NULL ELSE cast({RAW_MAX} - 60 - l_partkey % 120 AS int) END AS temp_min,
          CASE WHEN l_orderkey % 29 = 0 THEN ',S,' WHEN l_orderkey % 31 = 0 THEN NULL ELSE ',,W' END AS temp_max_attrs,
          CASE WHEN l_orderkey % 37 = 0 THEN ',S,' WHEN l_orderkey % 41 = 0 THEN NULL ELSE ',,W' END AS temp_min_attrs
        FROM {{lineitem}}""",
    # one report row per state, county, year, crop and irrigation practice
    "yield_report": f"""
        SELECT CASE WHEN top % 61 = 0 THEN 'abc' ELSE cast(county AS string) END AS county_code,
          cast(state AS string) AS state_code, concat('County ', cast(county AS string), CASE WHEN top % 2 = 0 THEN '  ' ELSE '' END)
          AS county_name, {STATE.format(k='state')} AS state_abbr, commodity, cast(yr AS string) AS yield_year,
          CASE WHEN top % 53 = 0 THEN NULL
            ELSE cast(cents AS double) / (n * CASE WHEN commodity = 'Corn' THEN 199999e0 ELSE 799996e0 END) END AS yield_amount,
          irrigation
        FROM (
          SELECT c_nationkey AS state, 1 + c_custkey % {COUNTIES} AS county, year(o_orderdate) AS yr,
            CASE WHEN o_orderkey % 2 = 0 THEN 'Corn' ELSE 'Soybeans' END AS commodity,
            CASE WHEN o_orderkey % 3 = 0 THEN ' Irrigated' ELSE ' Non-Irrigated' END AS irrigation,
            max(o_orderkey) AS top, count(*) AS n, sum(cast(round(o_totalprice * 100) AS bigint)) AS cents
          FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
          GROUP BY c_nationkey, 1 + c_custkey % {COUNTIES}, year(o_orderdate),
            CASE WHEN o_orderkey % 2 = 0 THEN 'Corn' ELSE 'Soybeans' END,
            CASE WHEN o_orderkey % 3 = 0 THEN ' Irrigated' ELSE ' Non-Irrigated' END
        ) AS g""",
    "station_map": f"""
        SELECT {STATION.format(k='s_suppkey')} AS station, cast(s_nationkey AS int) AS state_fips,
          cast(1 + s_suppkey % {COUNTIES} AS int) AS county_fips, {STATE.format(k='s_nationkey')} AS stusps
        FROM {{supplier}} WHERE s_suppkey % 10 <> 9""",
    # rectangles that tile the station area, four per nation
    "county_box": " UNION ALL ".join(f"""
        SELECT cast(n_nationkey AS int) AS state_fips, cast({k + 1} AS int) AS county_fips,
          {STATE.format(k='n_nationkey')} AS stusps,
          (350 + 15 * cast(floor((n_nationkey * {COUNTIES} + {k}) / 1e1) AS int)) / 1e1 AS south,
          (365 + 15 * cast(floor((n_nationkey * {COUNTIES} + {k}) / 1e1) AS int)) / 1e1 AS north,
          (-1060 + 22 * cast((n_nationkey * {COUNTIES} + {k}) % 10 AS int)) / 1e1 AS west,
          (-1038 + 22 * cast((n_nationkey * {COUNTIES} + {k}) % 10 AS int)) / 1e1 AS east
        FROM {{nation}}""" for k in range(COUNTIES)),
    "region_of_state": f"""
        SELECT {STATE.format(k='n_nationkey')} AS state_abbr, r_name AS region
        FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey""",
}

SALT = "(state_fips * 7 + county_fips * 13 + year * 3 + CASE WHEN commodity = 'Corn' THEN 5 ELSE 0 END + CASE WHEN irrigation = ' Irrigated' THEN 11 ELSE 0 END)"
PREDICTED = f"""CASE WHEN {SALT} % 29 = 0 THEN NULL ELSE yield_amount
  + ({SALT} % 41 - 20) * CASE WHEN commodity = 'Corn' THEN 75e-2 ELSE 25e-2 END
  + CASE {SALT} % 37 WHEN 0 THEN 4e1 WHEN 1 THEN -4e1 ELSE 0e0 END END"""

_MEANS = seasons.MEAN_MEASURES
WATCHED = anomalies.WATCHED


def _region_case(name: str) -> str:
    parts = " ".join(
        f"WHEN {{c}} IN ({', '.join(repr(s) for s in states)}) THEN '{r}'"
        for r, states in REGION_SETS[name].items() if r != "default"
    )
    return f"CASE {parts} ELSE '{REGION_SETS[name]['default'] or ''}' END"


def region_sql(name: str, col: str = "state_abbr") -> str:
    return _region_case(name).format(c=col)


def growing_sql(guard: bool = True, months=(4, 9)) -> str:
    mean = "(temp_max + temp_min) / 2e0"
    units = f"CASE WHEN {mean} IS NULL THEN {'NULL' if guard else 200} WHEN {mean} >= 300 THEN 200 WHEN {mean} <= 100 THEN 0 ELSE {mean} - 100 END"
    return f"""SELECT station, year(date) AS year, latitude, longitude, sum(precipitation) AS total_precip,
      stddev_samp(precipitation) AS precip_std, count(*) FILTER (precipitation = 0) AS dry_days,
      count(*) FILTER (precipitation > 500) AS heavy_rain_days, avg(temp_max) AS avg_temp_max, avg(temp_min) AS avg_temp_min,
      max(temp_max) AS peak_temp_max, avg({mean}) AS avg_temp_mean, count(*) FILTER (temp_max > 350) AS heat_stress_days,
      sum({units}) AS gdd_raw, count(*) FILTER (temp_min < 0) AS frost_days, count(*) AS obs_count_growing
      FROM wx WHERE month(date) BETWEEN {months[0]} AND {months[1]} GROUP BY station, year(date), latitude, longitude"""


WINTER_SQL = """SELECT station, year(date) AS year, sum(snowfall) AS winter_snowfall, avg(snow_depth) AS avg_snow_depth,
  max(snow_depth) AS max_snow_depth, count(*) FILTER (snowfall > 0) AS snow_days
  FROM wx WHERE month(date) NOT BETWEEN 4 AND 9 GROUP BY station, year(date)"""

# SQL twins of composite tables: name -> (needed tables, text)
CHECK = {
    "growing": (["wx"], growing_sql()),
    "winter": (["wx"], WINTER_SQL),
    "season": (["growing", "winter"], f"""SELECT *,
        CASE WHEN total_precip_mm < {LIMITS['drought_mm']} AND heat_stress_days > {LIMITS['drought_heat']} THEN 1 ELSE 0 END AS drought_flag,
        CASE WHEN heavy_rain_days > {LIMITS['flood_days']} THEN 1 ELSE 0 END AS flood_flag,
        CASE WHEN heat_stress_days > {LIMITS['heat_limit']} THEN 1 ELSE 0 END AS extreme_heat_flag
      FROM (SELECT g.station, g.year, latitude, longitude, dry_days, heavy_rain_days, heat_stress_days, frost_days,
        obs_count_growing, snow_days, total_precip / 1e1 AS total_precip_mm, precip_std / 1e1 AS precip_std_mm,
        avg_temp_max / 1e1 AS avg_temp_max_c, avg_temp_min / 1e1 AS avg_temp_min_c, avg_temp_mean / 1e1 AS avg_temp_mean_c,
        peak_temp_max / 1e1 AS peak_temp_max_c, gdd_raw / 1e1 AS gdd, winter_snowfall / 1e1 AS winter_snowfall_mm,
        avg_snow_depth / 1e1 AS avg_snow_depth_mm, max_snow_depth / 1e1 AS max_snow_depth_mm
        FROM growing g LEFT JOIN winter w ON g.station = w.station AND g.year = w.year) u"""),
    "county": (["season", "station_map"], f"""SELECT state_fips, county_fips, stusps, year,
        avg(total_precip_mm) AS avg_precip_mm, {', '.join(f'avg({m}) AS {m}' for m in _MEANS)},
        {', '.join(f'max({m}) AS {m}' for m in seasons.FLAG_MEASURES)}
      FROM season JOIN station_map USING (station) GROUP BY state_fips, county_fips, stusps, year
      HAVING avg(avg_temp_max_c) IS NOT NULL"""),
    "yields": (["yield_report"], """SELECT try_cast(county_code AS int) AS county_fips, try_cast(state_code AS int) AS state_fips,
        county_name, state_abbr, commodity, try_cast(yield_year AS int) AS year, yield_amount, irrigation
      FROM yield_report WHERE yield_amount IS NOT NULL"""),
    "merged": (["yields", "county"], "SELECT * FROM yields JOIN county USING (state_fips, county_fips, year)"),
    "scored0": (["merged"], f"SELECT *, {PREDICTED} AS pred_yield FROM merged"),
    "scored": (["scored0"], f"""SELECT *, CASE WHEN residual_zscore > 2 THEN 1 ELSE 0 END AS anomaly_flag,
        CASE WHEN weather_extremity > 2 THEN 1 ELSE 0 END AS weather_anomaly_flag
      FROM (SELECT *, yield_amount - pred_yield AS signed_residual, abs(pred_yield - yield_amount) AS residual,
        (abs(pred_yield - yield_amount) - avg(abs(pred_yield - yield_amount)) OVER c)
          / stddev_samp(abs(pred_yield - yield_amount)) OVER c AS residual_zscore,
        greatest({', '.join(f'abs(({m} - avg({m}) OVER c) / (stddev_samp({m}) OVER c + 1e-8))' for m in WATCHED)}) AS weather_extremity
        FROM scored0 WINDOW c AS (PARTITION BY commodity)) z"""),
    "hist": (["scored"], f"SELECT * FROM scored WHERE year < {PREDICT_FROM}"),
    "pred": (["scored0"], f"""SELECT state_fips, county_fips, county_name, state_abbr, commodity, irrigation, year, pred_yield,
        avg_precip_mm, heat_stress_days, gdd, drought_flag, flood_flag, extreme_heat_flag,
        drought_flag + extreme_heat_flag AS extreme_events, concat(cast(year AS string), '-04-01') AS noaa_window_start,
        concat(cast(year AS string), '-09-30') AS noaa_window_end
      FROM scored0 WHERE year >= {PREDICT_FROM}"""),
    "signals": (["merged"], """SELECT *, avg_precip_mm AS total_precip_mm,
        CASE WHEN yield_std > 0 THEN (yield_amount - yield_mean) / yield_std ELSE 0 END AS yield_zscore,
        CASE WHEN temp_clim_std > 0 THEN (avg_temp_mean_c - temp_clim_mean) / temp_clim_std ELSE 0 END AS temp_anomaly_z,
        CASE WHEN precip_clim_std > 0 THEN (avg_precip_mm - precip_clim_mean) / precip_clim_std ELSE 0 END AS precip_anomaly_z
      FROM (SELECT *, avg(yield_amount) OVER y AS yield_mean, stddev_samp(yield_amount) OVER y AS yield_std,
        avg(avg_temp_mean_c) OVER w AS temp_clim_mean, stddev_samp(avg_temp_mean_c) OVER w AS temp_clim_std,
        avg(avg_precip_mm) OVER w AS precip_clim_mean, stddev_samp(avg_precip_mm) OVER w AS precip_clim_std
        FROM merged WINDOW y AS (PARTITION BY commodity, state_fips, county_fips), w AS (PARTITION BY state_fips, county_fips)) s"""),
    "signal_labels": (["signals"], """SELECT *,
        CASE WHEN yield_zscore < -1.5 THEN 'VERY_LOW' WHEN yield_zscore < -0.5 THEN 'BELOW_AVG'
          WHEN yield_zscore > 1.5 THEN 'VERY_HIGH' WHEN yield_zscore > 0.5 THEN 'ABOVE_AVG' ELSE 'NORMAL' END AS yield_category,
        CASE WHEN yield_zscore > 1 AND temp_anomaly_z > 1 AND precip_anomaly_z < -1 THEN 'HIGH_YIELD_DESPITE_HOT_DRY'
          WHEN yield_zscore < -1 AND temp_anomaly_z BETWEEN -0.5 AND 0.5 AND precip_anomaly_z BETWEEN -0.5 AND 0.5
            THEN 'LOW_YIELD_NORMAL_WEATHER'
          WHEN yield_zscore < -1.5 AND (temp_anomaly_z > 1.5 OR precip_anomaly_z < -1.5) THEN 'LOW_YIELD_EXTREME_WEATHER'
          ELSE 'CONSISTENT' END AS weather_yield_mismatch FROM signals"""),
    # residual columns as an anomaly study names them
    "study": (["scored"], """SELECT * EXCLUDE (anomaly_flag),
        CASE WHEN z > 2 THEN 'high_yield_vs_weather' WHEN z < -2 THEN 'low_yield_vs_weather' ELSE '' END AS anomaly_flag,
        CASE WHEN yield_residual IS NULL THEN NULL ELSE z END AS yield_residual_z
      FROM (SELECT *, signed_residual AS yield_residual, (signed_residual - avg(signed_residual) OVER ())
        / stddev_pop(signed_residual) OVER () AS z FROM scored) q"""),
}


def _check_table(name: str) -> tuple[list[str], str]:
    if name in CHECK:
        return CHECK[name]
    return [], DERIVED[name].format(**{t: t for t in TABLES})


def _mentioned(sql: str) -> list[str]:
    known = [*DERIVED, *CHECK]
    return [n for n in known if re.search(rf"\b{n}\b", sql)]


def check_table(name: str, sql: str) -> None:
    """Add a composite SQL table that registered SQL texts may use."""
    CHECK[name] = ([n for n in _mentioned(sql) if n != name], sql)


def with_tables(sql: str) -> str:
    """Prefix a SQL text with the WITH entries of the derived tables it mentions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for n in _check_table(name)[0]:
            visit(n)
        ordered.append(name)

    for n in _mentioned(sql):
        visit(n)
    if not ordered:
        return sql
    parts = ", ".join(f"{n} AS ({_check_table(n)[1].strip()})" for n in ordered)
    opening = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if opening:
        return f"WITH {opening[1] or ''}{parts}, {sql[opening.end():]}"
    return f"WITH {parts} {sql}"


# Tables that several queries share, by session, folder, name and state of the given files.
_STORED: dict[tuple, str] = {}
SOURCES = ("lineitem", "supplier", "orders", "customer")


class Base:
    """Given tables and domain tables of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._schemas: dict[str, T.StructType] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def schema(self, name: str) -> T.StructType:
        """Schema of a given table; its footer is read once per query."""
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(self.path(name)).schema
        return self._schemas[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(self.path(name))

    def derived(self, name: str, **given: DataFrame) -> DataFrame:
        """A derived table; `given` replaces given tables, for example by a stream."""
        text = DERIVED[name]
        used = [t for t in TABLES if f"{{{t}}}" in text]
        return self.spark.sql(text, **{t: given[t] if t in given else self.table(t) for t in used})

    @property
    def weather(self) -> DataFrame:
        return self.derived("wx")

    @property
    def yield_report(self) -> DataFrame:
        names = {"county_code": "County Code", "state_code": "State Code", "county_name": "County Name",
                 "state_abbr": "State Abbreviation", "commodity": "Commodity Name", "yield_year": "Yield Year",
                 "yield_amount": "Yield Amount", "irrigation": "Irrigation Practice Name"}
        return self.derived("yield_report").withColumnsRenamed(names)

    @property
    def yields(self) -> DataFrame:
        return yields.clean_yields(self.yield_report)

    @property
    def station_map(self) -> DataFrame:
        return self.derived("station_map")

    @property
    def counties(self) -> DataFrame:
        corners = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
        ring = F.array(*[F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in corners])
        return self.derived("county_box").withColumn("ring", ring)

    @property
    def station_seasons(self) -> DataFrame:
        return etl.station_weather(self.weather, **LIMITS)

    @property
    def county_weather(self) -> DataFrame:
        return etl.county_table(self.weather, self.station_map, **LIMITS)

    def stored(self, name: str, make) -> DataFrame:
        """A table that many queries share: written once per session to the shared folder, then read back, so
        that later queries prune its columns instead of aggregating the daily rows again. It is written anew when the
        given files have changed or the written table is gone."""
        state = tuple(file_state(self.spark, self.path(t)) for t in SOURCES)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, state)
        if key not in _STORED or file_state(self.spark, f"{_STORED[key]}/_SUCCESS") is None:
            path = fresh_folder(self.spark, name)
            make().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @property
    def merged_plan(self) -> DataFrame:
        """The merged table as one plan from the given tables."""
        return etl.build_merged(self.weather, self.yield_report, self.station_map, **LIMITS)

    @property
    def merged(self) -> DataFrame:
        return self.stored("merged", lambda: self.merged_plan)

    @property
    def days(self) -> DataFrame:
        return etl.scoped_days(self.weather, YEARS)

    @property
    def signals(self) -> DataFrame:
        return etl.signal_table(self.merged)

    @property
    def predicted(self) -> DataFrame:
        return self.merged.withColumn("pred_yield", F.expr(PREDICTED))

    @property
    def scored(self) -> DataFrame:
        rows = self.predicted.withColumn("signed_residual", F.col("yield_amount") - F.col("pred_yield"))
        return self.stored("scored", lambda: studies.flag_types(rows))

    @property
    def history(self) -> DataFrame:
        return self.scored.filter(F.col("year") < PREDICT_FROM)

    @property
    def predictions(self) -> DataFrame:
        rows = self.predicted.filter(F.col("year") >= PREDICT_FROM)
        year = F.col("year").cast("string")
        return rows.select(
            "state_fips", "county_fips", "county_name", "state_abbr", "commodity", "irrigation", "year", "pred_yield",
            "avg_precip_mm", "heat_stress_days", "gdd", "drought_flag", "flood_flag", "extreme_heat_flag",
            (F.col("drought_flag") + F.col("extreme_heat_flag")).alias("extreme_events"),
            F.concat(year, F.lit("-04-01")).alias("noaa_window_start"), F.concat(year, F.lit("-09-30")).alias("noaa_window_end"),
        )

    @property
    def study(self) -> DataFrame:
        from harvestlens.operators.anomalies import oof_flags

        return oof_flags(self.scored.drop("anomaly_flag").withColumn("yield_residual", F.col("signed_residual")))
