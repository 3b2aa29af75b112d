"""Points in polygons over refined cells against the fixed grid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import cells, geo

RING = "ring array<struct<lon:double,lat:double>>"
RINGS = "ring array<array<struct<lon:double,lat:double>>>"


def circle(x, y, r, n):
    return [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.fixture(scope="module")
def points(spark):
    """A third of the points in one city, half of those at one place; the rest spread, some on edges and corners, some without coordinates."""
    rng = random.Random(7)
    rows = [(i, rng.uniform(-12, 12), rng.uniform(-12, 12)) for i in range(4000)]
    rows += [(10000 + i, 2.5 if i % 2 else rng.gauss(2.5, 0.02), 2.5 if i % 2 else rng.gauss(2.5, 0.02)) for i in range(2000)]
    rows += [(20000 + i, float(rng.randint(-5, 5)), float(rng.randint(-5, 5))) for i in range(200)]
    rows += [(30000, None, 1.0), (30001, 1.0, None)]
    return spark.createDataFrame(rows, "name int, longitude double, latitude double").repartition(4)


@pytest.fixture(scope="module")
def shapes(spark):
    state = circle(0.0, 0.0, 9.0, 900)
    city = [(2.4, 2.4), (2.6, 2.4), (2.6, 2.6), (2.5, 2.5), (2.4, 2.6)]
    tiles = [(100 + 10 * i + j, [(float(i), float(j)), (i + 1.0, float(j)), (i + 1.0, j + 1.0), (float(i), j + 1.0), (float(i), float(j))]) for i in range(-5, 5) for j in range(-5, 5)]
    return spark.createDataFrame([(1, state), (2, city), *tiles], f"county_fips int, {RING}")


def pairs(df):
    return sorted((r["name"], r["county_fips"]) for r in df.select("name", "county_fips").collect())


@pytest.mark.parametrize("how", [{}, {"most": 40, "levels": 6}, {"most": 500, "levels": 2, "base": 4.0}, {"most": 10, "levels": 0}])
def test_equal_to_the_fixed_grid(points, shapes, how):
    got = cells.points_in_polygons(points, shapes, **how)
    assert got.columns == ["name", "longitude", "latitude", "county_fips", "ring"]
    assert pairs(got) == pairs(geo.points_in_polygons(points, shapes)) and got.count() > 5000


def test_holes_and_islands(spark, points):
    ring = lambda a: [(-a, -a), (a, -a), (a, a), (-a, a)]
    shapes = spark.createDataFrame([(1, [ring(8.0), ring(5.0), ring(2.0)]), (2, [circle(3.0, 3.0, 4.0, 50), circle(2.5, 2.5, 0.01, 8)])], f"county_fips int, {RINGS}")
    assert pairs(cells.points_in_polygons(points, shapes, most=60)) == pairs(geo.points_in_polygons(points, shapes))


def test_no_cell_is_overfull_and_inner_cells_test_no_edge(points, shapes):
    most = 100
    tree = cells.cell_tree(points, "longitude", "latitude", 0.5, 6, most).cache()
    per_cell = tree.select("level", "cx", "cy", "n").distinct().collect()
    assert sum(r["n"] for r in per_cell) == 6200
    assert all(r["n"] <= most or r["level"] == 6 for r in per_cell)
    # only cells that were too full one level up are fine ones
    assert {r["level"] for r in per_cell} >= {0, 6} and max(r["n"] for r in per_cell) >= 1000
    met = cells.cell_pairs(tree, shapes.filter("county_fips = 1"), "ring", 0.5).collect()
    inner = [r for r in met if r["near"] is None]
    assert len(inner) > len(met) / 2 and max(len(r["near"]) for r in met if r["near"] is not None) < 450
    plan = cells.points_in_polygons(points, shapes, most=most)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_that_clash_and_empty_tables(spark, points, shapes):
    odd = points.withColumns({"level": F.lit("a"), "part": F.lit("b"), "x": F.lit("c"), "n": F.lit(1)})
    got = cells.points_in_polygons(odd, shapes.filter("county_fips = 2").withColumn("near", F.lit("d")), most=100)
    assert {(r["level"], r["part"], r["x"], r["near"]) for r in got.select("level", "part", "x", "near").collect()} == {("a", "b", "c", "d")}
    assert cells.points_in_polygons(points.limit(0), shapes).count() == 0 and cells.points_in_polygons(points, shapes.limit(0)).count() == 0
