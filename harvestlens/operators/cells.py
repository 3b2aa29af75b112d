"""Points in polygons over cells that are finer where points crowd: inner cells need no edge test, and no cell is one heavy task.

The plane is cut into squares of `base` degrees, and a square with more than `most` points into four, `levels` times at most. A polygon meets such a cell in one of three
ways. Where none of its edges comes near the cell, one test of the cell's middle holds for all points in it; where edges do, a point is tested against
those edges only that a ray from the cell to the right can cross; other cells have no pair. The join is an equality on the cell and, for cells that hold more
than `most` points at the last level, on a number that their points are dealt by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harvestlens.operators.geo import _several, with_bbox
from harvestlens.session import materialize

EDGE = "struct<ax:double,ay:double,bx:double,by:double>"


def _edges(ring: str, several: bool) -> Column:
    """All edges of a shape's rings, closed."""
    def closed(r):
        whole = F.concat(r, F.slice(r, 1, 1))
        return F.zip_with(F.slice(whole, 1, F.size(r)), F.slice(whole, 2, F.size(r)), lambda a, b: F.struct(
            a["lon"].cast("double").alias("ax"), a["lat"].cast("double").alias("ay"), b["lon"].cast("double").alias("bx"), b["lat"].cast("double").alias("by")))

    return F.flatten(F.transform(ring, closed)) if several else closed(F.col(ring))


def _by_edges(x: Column, y: Column, edges: Column) -> Column:
    """True strictly inside by the even-odd rule over the given edges; points on an edge are outside."""
    def step(state, e):
        turn = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        spans = x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        crosses = ((e["ay"] > y) != (e["by"] > y)) & ((turn > 0) == (e["by"] > e["ay"]))
        return F.struct((state["odd"] != crosses).alias("odd"), (state["edge"] | ((turn == 0) & spans)).alias("edge"))

    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("edge"))
    return F.aggregate(edges, start, step, lambda s: s["odd"] & ~s["edge"])


def cell_tree(points: DataFrame, lon: str, lat: str, base: float, levels: int, most: int) -> DataFrame:
    """(fx, fy, level, cx, cy, n): for every square of the finest level that has points, the cell it belongs to and how many points that cell holds.

    The points are counted once, with map-side combine; the levels are counted from those counts."""
    fine = base / 2**levels
    counts = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(
        F.floor(F.col(lon) / fine).alias("fx"), F.floor(F.col(lat) / fine).alias("fy")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts)
    at = counts
    for level in range(levels + 1):
        x, y = F.shiftright("fx", levels - level), F.shiftright("fy", levels - level)
        whole = counts.groupBy(x.alias("x"), y.alias("y")).agg(F.sum("n").alias(f"n{level}"))
        at = at.withColumns({"x": x, "y": y}).join(whole, ["x", "y"]).drop("x", "y")
    # the first level whose cell is not too full
    level = F.coalesce(*[F.when(F.col(f"n{k}") <= most, F.lit(k)) for k in range(levels)], F.lit(levels))
    held = F.array(*[F.col(f"n{k}") for k in range(levels + 1)])
    out = at.select("fx", "fy", level.alias("level"), held.alias("held"))
    own = lambda c: F.expr(f"shiftright({c}, {levels} - level)")
    return materialize(out.select("fx", "fy", "level", own("fx").alias("cx"), own("fy").alias("cy"), F.get("held", F.col("level")).alias("n")))


def cell_pairs(cells: DataFrame, polygons: DataFrame, ring: str, base: float) -> DataFrame:
    """(level, cx, cy, n, shape, near): the shapes that may hold points of a cell, with the edges that decide; without edges all points of the cell are inside."""
    several = _several(polygons, ring)
    shapes = with_bbox(polygons.select(F.struct(*polygons.columns).alias("shape"), F.col(ring).alias("__ring")), "__ring")
    shapes = shapes.withColumn("__edges", _edges("__ring", several))
    # a margin, so that rounding never parts a shape from a cell it touches
    step = lambda low, high: F.sequence(F.floor(F.col(low) / base), F.floor(F.col(high) / base))
    shapes = shapes.withColumn("bx", F.explode(step("min_lon", "max_lon"))).withColumn("by", F.explode(step("min_lat", "max_lat")))
    side = F.lit(base) / F.pow(F.lit(2.0), F.col("level"))
    places = cells.select("level", "cx", "cy", "n").distinct().withColumns({
        "bx": F.expr("shiftright(cx, level)"), "by": F.expr("shiftright(cy, level)"),
        "west": F.col("cx") * side - side * 1e-9, "east": (F.col("cx") + 1) * side + side * 1e-9, "south": F.col("cy") * side - side * 1e-9, "north": (F.col("cy") + 1) * side + side * 1e-9,
    })
    met = places.join(shapes, ["bx", "by"]).filter("min_lon <= east AND max_lon >= west AND min_lat <= north AND max_lat >= south")
    in_band = lambda e: (F.least(e["ay"], e["by"]) <= F.col("north")) & (F.greatest(e["ay"], e["by"]) >= F.col("south")) & (F.greatest(e["ax"], e["bx"]) >= F.col("west"))
    met = met.withColumn("right", F.filter("__edges", in_band))
    touches = F.exists("right", lambda e: F.least(e["ax"], e["bx"]) <= F.col("east"))
    middle = _by_edges((F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2, F.col("right"))
    none = F.expr(f"CAST(NULL AS array<{EDGE}>)")
    return met.filter(touches | middle).select("level", "cx", "cy", "n", "shape", F.when(touches, F.col("right")).otherwise(none).alias("near"))


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, lon: str = "longitude", lat: str = "latitude", ring: str = "ring", base: float = 0.5, levels: int = 6, most: int = 50_000,
) -> DataFrame:
    """The same rows as `geo.points_in_polygons`: an inner join of points with the polygons that hold them, points on an edge outside.

    Points without coordinates are in no polygon. A cell that is too full at the last level (many points at one place) is dealt to several parts, to each of which
    its few shapes go."""
    tree = cell_tree(points, lon, lat, base, levels, most)
    pairs = materialize(cell_pairs(tree, polygons, ring, base))
    parts = F.ceil(F.col("n") / most).cast("int")
    fine = base / 2**levels
    placed = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.struct(*points.columns).alias("point"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    placed = placed.withColumns({"fx": F.floor(F.col("point")[lon] / fine), "fy": F.floor(F.col("point")[lat] / fine)})
    placed = placed.join(tree.withColumn("parts", parts), ["fx", "fy"]).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int"))
    dealt = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    hits = placed.select("point", "x", "y", "level", "cx", "cy", "part").join(dealt, ["level", "cx", "cy", "part"])
    inside = F.col("near").isNull() | _by_edges(F.col("x"), F.col("y"), F.col("near"))
    return hits.filter(inside).select("point.*", *[F.col("shape")[c].alias(c) for c in polygons.columns])
