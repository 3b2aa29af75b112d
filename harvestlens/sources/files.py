"""File scans and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from harvestlens.functions.numeric import as_num
from harvestlens.functions.text import digits_only, geoid, path_parts

# Accepted spellings of centroid file headers.
LAT_NAMES = ("lat", "latitude")
LON_NAMES = ("lon", "longitude", "lng", "long")
KEY_PAIRS = (("state_fips", "county_fips"), ("statefp", "countyfp"))
CENTROID_SCHEMA = "geoid string, lat double, lon double"

_POINT = T.ArrayType(T.DoubleType())
GEOJSON_SCHEMA = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            # read as text first: the nesting depth depends on the geometry type
            T.StructField("coordinates", T.StringType()),
        ])),
    ]))),
])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; blanks around column names are trimmed. Pass a schema to skip the inference pass."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write to a new folder; an existing one is refused."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def scan_binary(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Files under a folder tree with the label folder and file name taken from each path."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(directory)
    )
    folder, name = path_parts("path")
    return files.select("path", "modificationTime", "length", "content", folder.alias("label"), name.alias("filename"))


def _ring_mean(ring: Column) -> Column:
    total = F.aggregate(
        ring, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, p: F.struct((s["x"] + p[0]).alias("x"), (s["y"] + p[1]).alias("y")),
    )
    n = F.size(ring)
    return F.struct((total["y"] / n).alias("lat"), (total["x"] / n).alias("lon"))


def _outer_ring(kind: Column, coordinates: Column) -> Column:
    """Outer ring of a polygon, or the longest outer ring of a multi-polygon (the first among equals)."""
    polygon = F.from_json(coordinates, T.ArrayType(T.ArrayType(_POINT)))
    multi = F.from_json(coordinates, T.ArrayType(T.ArrayType(T.ArrayType(_POINT))))
    outers = F.transform(multi, lambda p: F.get(p, 0))
    longest = F.aggregate(
        outers, F.array().cast(T.ArrayType(_POINT)),
        lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best),
    )
    return F.when(kind == "Polygon", F.get(polygon, 0)).when(kind == "MultiPolygon", longest)


def geojson_centroids(features: DataFrame) -> DataFrame:
    """Mean point of each county's outer ring; features without usable coordinates are skipped."""
    props, geometry = F.col("f.properties"), F.col("f.geometry")
    rows = features.select(F.explode("features").alias("f")).select(
        geoid(F.coalesce(F.try_element_at(props, F.lit("STATE")), F.lit("")),
              F.coalesce(F.try_element_at(props, F.lit("COUNTY")), F.lit(""))).alias("geoid"),
        _outer_ring(geometry["type"], geometry["coordinates"]).alias("ring"),
    )
    found = rows.filter(F.col("ring").isNotNull() & (F.size("ring") > 0))
    return found.select("geoid", _ring_mean(F.col("ring")).alias("c")).select("geoid", "c.lat", "c.lon")


def geojson_polygons(features: DataFrame) -> DataFrame:
    """(state_fips, county_fips, stusps, rings) of each feature with a polygon: all rings of all its parts, outer ones and holes alike, for
    the even-odd test of a point join. Features without usable coordinates are skipped."""
    props, geometry = F.col("f.properties"), F.col("f.geometry")
    polygon = F.from_json(geometry["coordinates"], T.ArrayType(T.ArrayType(_POINT)))
    multi = F.from_json(geometry["coordinates"], T.ArrayType(T.ArrayType(T.ArrayType(_POINT))))
    rings = F.when(geometry["type"] == "Polygon", polygon).when(geometry["type"] == "MultiPolygon", F.flatten(multi))
    points = F.transform(F.filter(rings, lambda r: F.size(r) > 2), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    rows = features.select(F.explode("features").alias("f")).select(
        F.try_element_at(props, F.lit("STATE")).try_cast("int").alias("state_fips"), F.try_element_at(props, F.lit("COUNTY")).try_cast("int").alias("county_fips"),
        F.try_element_at(props, F.lit("STUSPS")).alias("stusps"), points.alias("rings"),
    )
    return rows.filter(F.col("rings").isNotNull() & (F.size("rings") > 0))


def scan_geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """County shapes of a FeatureCollection. A document is one record, read by one task: split large collections into several files."""
    return geojson_polygons(spark.read.schema(GEOJSON_SCHEMA).option("multiLine", True).json(path))


def scan_geojson_centroids(spark: SparkSession, path: str) -> DataFrame:
    """County centroids of a FeatureCollection file."""
    return geojson_centroids(spark.read.schema(GEOJSON_SCHEMA).option("multiLine", True).json(path))


def json_map_rows(df: DataFrame, col: str, value_type: str, key: str = "key", value: str = "value") -> DataFrame:
    """Entries of JSON object texts as (key, value) rows."""
    entries = F.explode(F.map_entries(F.from_json(col, f"map<string,{value_type}>")))
    return df.select(entries.alias("e")).select(F.col("e.key").alias(key), F.col("e.value").alias(value))


def scan_json_map(spark: SparkSession, path: str, value_type: str, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON object of any keys as (key, value) rows; lists and objects keep their nested type. A file is one record, read by one task."""
    return json_map_rows(spark.read.text(path, wholetext=True), "value", value_type, key, value)


def scan_state_counties(spark: SparkSession, path: str) -> DataFrame:
    """{state: [{name, fips}]} as one row per county."""
    states = scan_json_map(spark, path, "array<struct<name:string,fips:int>>", "state_abbr", "counties")
    return states.select("state_abbr", F.explode("counties").alias("c")).select(
        "state_abbr", F.col("c.name").alias("county_name"), F.col("c.fips").alias("county_fips")
    )


def centroid_columns(df: DataFrame) -> DataFrame:
    """(geoid, lat, lon) from a table with flexible header names; no rows when they cannot be found."""
    named = df.toDF(*[c.strip().lower() for c in df.columns])
    cols = named.columns
    lat = next((c for c in cols if c in LAT_NAMES), None)
    lon = next((c for c in cols if c in LON_NAMES), None)
    pair = next((p for p in KEY_PAIRS if set(p) <= set(cols)), None)
    if "geoid" in cols:
        digits = digits_only("geoid")
        key = F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0"))
    elif pair:
        key = geoid(*pair)
    else:
        key = None
    if lat is None or lon is None or key is None:
        return df.sparkSession.createDataFrame([], CENTROID_SCHEMA)
    return named.select(key.alias("geoid"), as_num(lat).alias("lat"), as_num(lon).alias("lon")).dropna()


def scan_centroids_csv(spark: SparkSession, path: str) -> DataFrame:
    """County centroids from a CSV file; all columns are read as text, so no inference pass is needed."""
    return centroid_columns(spark.read.option("header", True).csv(path))


def state_trend_rows(spark: SparkSession, path: str, commodity: str) -> DataFrame:
    """{state: [intercept, slope]} as trend rows."""
    lines = scan_json_map(spark, path, "array<double>", "state_abbr", "line")
    return lines.select(
        F.lit(commodity).alias("commodity"), "state_abbr", F.get("line", 0).alias("intercept"), F.get("line", 1).alias("slope")
    )


def from_rows(spark: SparkSession, rows, schema: T.StructType | str | None = None) -> DataFrame:
    """Small row lists to a DataFrame."""
    return spark.createDataFrame(rows, schema)


def range_source(spark: SparkSession, start: int, end: int) -> DataFrame:
    return spark.range(start, end)


def values_source(spark: SparkSession, columns: Mapping[str, list]) -> DataFrame:
    """Inline values as a relation."""
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    one = spark.range(1).select(F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows
    ])).alias("r"))
    return one.select("r.*")
