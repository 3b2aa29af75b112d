"""Points in polygons, centroid files and coordinates."""

import json

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import geo
from harvestlens.sources import files

# an L shape: the notch lies inside the bounding box but outside the polygon
L_SHAPE = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
SQUARE = [(10.0, 10.0), (12.0, 10.0), (12.0, 12.0), (10.0, 12.0), (10.0, 10.0)]


@pytest.fixture(scope="module")
def polygons(spark):
    return spark.createDataFrame([(1, L_SHAPE), (2, SQUARE)], "county_fips int, ring array<struct<lon:double,lat:double>>")


@pytest.mark.parametrize("cell", [0.3, 1.0, 50.0])
def test_points_in_polygons(spark, polygons, cell):
    points = {
        "inside": (0.5, 3.0), "notch": (3.0, 3.0), "edge": (2.0, 1.0), "corner": (4.0, 1.0), "outside": (20.0, 20.0), "square": (11.0, 11.0),
        "left edge": (0.0, 2.0), "level with a corner": (0.5, 1.0), "unknown": (None, 1.0),
    }
    df = spark.createDataFrame([(n, *p) for n, p in points.items()], "name string, longitude double, latitude double")
    got = {(r["name"], r["county_fips"]) for r in geo.points_in_polygons(df, polygons, cell=cell).collect()}
    assert got == {("inside", 1), ("square", 2), ("level with a corner", 1)}


def test_grid_join_is_an_equality_join(spark, polygons):
    df = spark.createDataFrame([("a", 0.5, 0.5)], "name string, longitude double, latitude double")
    plan = geo.points_in_polygons(df, polygons)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_geojson_centroids(spark, folder):
    def feature(kind, coordinates, state="1", county="3"):
        return {"type": "Feature", "properties": {"STATE": state, "COUNTY": county}, "geometry": {"type": kind, "coordinates": coordinates}}

    ring = [[0, 0], [4, 0], [4, 2], [0, 2]]
    doc = {"type": "FeatureCollection", "features": [
        feature("Polygon", [ring]), feature("MultiPolygon", [[[[9, 9]]], [ring, [[1, 1]]]], county="5"),
        feature("Polygon", None, county="7"), feature("Point", [1, 2], county="9"), {"type": "Feature", "properties": {}, "geometry": None},
    ]}
    path = folder("counties.json")
    with open(path, "w") as f:
        json.dump(doc, f, indent=1)
    got = {r["geoid"]: (r["lat"], r["lon"]) for r in files.scan_geojson_centroids(spark, path).collect()}
    assert got == {"01003": (1.0, 2.0), "01005": (1.0, 2.0)}


@pytest.mark.parametrize("header,row,want", [
    ("GEOID, Latitude,LNG", "1003,1.5,2.5", [("01003", 1.5, 2.5)]),
    ("state_fips,county_fips,lat,lon", "1,3,1.5,bad", []),
    ("STATEFP,COUNTYFP,lat,long", "1,3,1.5,2.5", [("01003", 1.5, 2.5)]),
    ("name,lat,lon", "x,1,2", []),
])
def test_centroid_csv_headers(spark, folder, header, row, want):
    path = folder("c.csv")
    with open(path, "w") as f:
        f.write(f"{header}\n{row}\n")
    assert [tuple(r) for r in files.scan_centroids_csv(spark, path).collect()] == want


def test_centroids_fall_back_below_the_match_rate(spark):
    rows = spark.createDataFrame([(19, i, "IA") for i in range(10)], "state_fips int, county_fips int, state_abbr string")
    some = spark.createDataFrame([("19001", 1.0, 2.0), ("19001", 1.0, 3.0), ("19002", 1.0, 2.0), ("19003", 5.0, 6.0)], files.CENTROID_SCHEMA)
    got = {r["county_fips"]: (r["lat"], r["lon"]) for r in geo.attach_centroids(rows, some, geo.MIN_MATCH).collect()}
    assert got[1] == (1.0, 2.0) and got[9] == (None, None)
    one = some.filter("geoid = '19001'")
    few = {r["county_fips"]: round(r["lat"], 6) for r in geo.attach_centroids(rows, one, geo.MIN_MATCH).collect()}
    assert few[1] == round(41.9 - 3 * 0.11, 6)
    each = {r["county_fips"]: (round(r["lat"], 6), r["source"]) for r in geo.attach_centroids(rows, one).collect()}
    assert each[1] == (1.0, "centroid") and each[2] == (round(41.9 - 2 * 0.11, 6), "approximate")


def test_parts_holes_and_islands(spark, folder):
    def box(west, south, east, north):
        return [[west, south], [east, south], [east, north], [west, north], [west, south]]

    def feature(kind, coordinates, county):
        return {"type": "Feature", "properties": {"STATE": "01", "COUNTY": county, "STUSPS": "AL"}, "geometry": {"type": kind, "coordinates": coordinates}}

    doc = {"type": "FeatureCollection", "features": [
        feature("MultiPolygon", [[box(0, 0, 10, 10), box(2, 2, 8, 8)], [box(4, 4, 6, 6)], [box(20, 0, 22, 2)]], "001"), feature("Polygon", [box(2, 2, 8, 8)], "002"),
        feature("Point", [1, 1], "003"),
    ]}
    path = folder("shapes.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    shapes = files.scan_geojson_polygons(spark, path)
    assert shapes.count() == 2
    points = {"ring": (1.0, 1.0), "hole": (3.0, 3.0), "island": (5.0, 5.0), "part": (21.0, 1.0), "hole edge": (2.0, 5.0), "island edge": (4.0, 5.0), "away": (15.0, 1.0)}
    df = spark.createDataFrame([(n, *p) for n, p in points.items()], "name string, longitude double, latitude double")
    got = sorted((r["name"], r["county_fips"]) for r in geo.points_in_polygons(df, shapes, ring="rings").collect())
    assert got == [("hole", 2), ("island", 1), ("island", 2), ("island edge", 2), ("part", 1), ("ring", 1)]


def test_unknown_state_uses_country_centre(spark):
    rows = spark.createDataFrame([("ZZ", "x")], "state_abbr string, county_fips string")
    r = geo.approx_coords(rows).first()
    assert (round(r["lat"], 4), round(r["lon"], 4)) == (round(39.8283 - 0.44, 4), round(-98.5795 - 0.56, 4))
    assert geo.with_state_centres(rows).select(F.col("lat")).first()["lat"] is None
