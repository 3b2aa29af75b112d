"""Points in county polygons, centroids and map layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from harvestlens.functions.numeric import as_num, to_column
from harvestlens.functions.text import geoid

# Approximate state centres, and the centre used for any other state.
STATE_CENTRES = {
    "AL": (32.9, -86.9), "AR": (34.9, -92.4), "IA": (41.9, -93.6), "IL": (40.0, -89.0), "IN": (40.3, -86.1),
    "KS": (38.5, -98.5), "KY": (37.5, -85.3), "MD": (39.0, -76.6), "MI": (43.3, -84.5), "MN": (46.0, -94.0),
    "MO": (37.9, -91.5), "NC": (35.6, -79.4), "ND": (47.5, -100.5), "NE": (41.1, -98.0), "OH": (40.4, -82.8),
    "PA": (40.9, -77.6), "SC": (33.9, -80.9), "SD": (44.4, -100.2), "TN": (35.9, -86.6), "TX": (31.0, -100.0),
    "WI": (44.5, -89.6), "NY": (43.0, -75.5), "CO": (39.1, -105.3),
}
COUNTRY_CENTRE = (39.8283, -98.5795)
LAT_STEP, LON_STEP, SPREAD = 0.11, 0.14, 9
MIN_MATCH = 0.3


def _crossed(x: Column, y: Column, ring: Column) -> Column:
    """(odd, edge): whether a ray from the point crosses the ring an odd number of times, and whether the point is on it."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    edges = F.zip_with(
        F.slice(closed, 1, F.size(ring)), F.slice(closed, 2, F.size(ring)),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )

    def step(state, e):
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        within_span = x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
        straddles = (ay > y) != (by > y)
        # a crossing lies to the right of the point when the turn has the edge's vertical direction
        crosses = straddles & ((turn > 0) == (by > ay))
        return F.struct(
            (state["odd"] != crosses).alias("odd"), (state["edge"] | ((turn == 0) & within_span)).alias("edge")
        )

    return F.aggregate(edges, _NOT_CROSSED(), step)


def _NOT_CROSSED() -> Column:
    return F.struct(F.lit(False).alias("odd"), F.lit(False).alias("edge"))


def point_in_ring(lon, lat, ring) -> Column:
    """True strictly inside a ring of (lon, lat) points, by edge crossings; points on an edge are outside.

    The ring may or may not repeat its first point at the end.
    """
    crossed = _crossed(to_column(lon), to_column(lat), to_column(ring))
    return crossed["odd"] & ~crossed["edge"]


def point_in_rings(lon, lat, rings) -> Column:
    """True strictly inside a shape of several rings by the even-odd rule: parts add up, holes are outside, islands in holes are inside
    again; points on any edge are outside."""
    x, y = to_column(lon), to_column(lat)

    def step(state, ring):
        one = _crossed(x, y, ring)
        return F.struct((state["odd"] != one["odd"]).alias("odd"), (state["edge"] | one["edge"]).alias("edge"))

    return F.aggregate(to_column(rings), _NOT_CROSSED(), step, lambda s: s["odd"] & ~s["edge"])


def _several(polygons: DataFrame, ring: str) -> bool:
    """Whether a column holds several rings per shape."""
    return isinstance(polygons.schema[ring].dataType.elementType, ArrayType)


def with_bbox(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    r = F.flatten(ring) if _several(polygons, ring) else F.col(ring)
    return polygons.withColumns({
        "min_lon": F.array_min(F.transform(r, lambda p: p["lon"])),
        "max_lon": F.array_max(F.transform(r, lambda p: p["lon"])),
        "min_lat": F.array_min(F.transform(r, lambda p: p["lat"])),
        "max_lat": F.array_max(F.transform(r, lambda p: p["lat"])),
    })


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, lon: str = "longitude", lat: str = "latitude", ring: str = "ring",
    cell: float = 0.5,
) -> DataFrame:
    """Inner spatial join. `ring` is one ring per polygon, or a list of rings: parts, holes and islands. Each polygon is listed under the grid cells its box touches, which makes the
    join an equality on the cell; the box and the exact ring test then decide within the join."""
    cells = with_bbox(polygons, ring)

    def span(low, high):
        return F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))

    cells = cells.withColumn("__cx", F.explode(span("min_lon", "max_lon")))
    cells = cells.withColumn("__cy", F.explode(span("min_lat", "max_lat")))
    placed = points.withColumns({"__px": F.floor(F.col(lon) / cell), "__py": F.floor(F.col(lat) / cell)})
    hit = (
        (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy"))
        & F.col(lon).between(F.col("min_lon"), F.col("max_lon"))
        & F.col(lat).between(F.col("min_lat"), F.col("max_lat"))
    )
    # NULL placements would not match anyway; dropping them early keeps them out of the shuffle
    placed = placed.filter(F.col("__px").isNotNull() & F.col("__py").isNotNull())
    return (
        placed.join(cells, hit, "inner")
        .filter(point_in_rings(lon, lat, ring) if _several(polygons, ring) else point_in_ring(lon, lat, ring))
        .drop("__px", "__py", "__cx", "__cy", "min_lon", "max_lon", "min_lat", "max_lat")
    )


def stations_in_counties(daily: DataFrame, counties: DataFrame, prefix: str = "US", cell: float = 0.5) -> DataFrame:
    """Station to county: distinct station positions of one country, joined to county polygons."""
    stations = daily.filter(F.col("group_").startswith(prefix)).select("station", "latitude", "longitude").distinct()
    return points_in_polygons(stations, counties, cell=cell).select("station", "state_fips", "county_fips", "stusps")


def centre_map(centres: Mapping[str, Sequence[float]] = STATE_CENTRES) -> Column:
    pairs = [x for s, (la, lo) in centres.items() for x in (F.lit(s), F.struct(F.lit(la).alias("lat"), F.lit(lo).alias("lon")))]
    return F.create_map(*pairs)


def with_state_centres(df: DataFrame, state: str = "state_abbr", centres=STATE_CENTRES) -> DataFrame:
    """State-level coordinates; unknown states get NULL."""
    spot = F.try_element_at(centre_map(centres), F.trim(F.col(state)))
    return df.withColumn("__c", spot).select("*", F.col("__c.lat").alias("lat"), F.col("__c.lon").alias("lon")).drop("__c")


def approx_coords(df: DataFrame, state: str = "state_abbr", county: str = "county_fips", centres=STATE_CENTRES):
    """Coordinates spread around the state centre by county number, for maps without real centroids."""
    fallback = F.struct(F.lit(COUNTRY_CENTRE[0]).alias("lat"), F.lit(COUNTRY_CENTRE[1]).alias("lon"))
    spot = F.coalesce(F.try_element_at(centre_map(centres), F.trim(F.col(state))), fallback)
    number = as_num(county, 0.0).try_cast("bigint")
    row, column = F.pmod(number, F.lit(SPREAD)), F.pmod(F.floor(number / SPREAD), F.lit(SPREAD))
    half = SPREAD // 2
    out = df.withColumn("__c", spot)
    return out.select(
        "*",
        (F.col("__c.lat") + (row - half) * F.lit(LAT_STEP)).alias("lat"),
        (F.col("__c.lon") + (column - half) * F.lit(LON_STEP)).alias("lon"),
    ).drop("__c")


def attach_centroids(
    df: DataFrame, centroids: DataFrame, min_match: float | None = None, state="state_fips", county="county_fips"
) -> DataFrame:
    """Real centroids where a row finds one, else approximate ones; `source` says which.

    With `min_match` the whole table decides at once: real ones for all rows (NULL where none is found) when that share of the
    rows finds one, else approximate ones for all."""
    keyed = df.withColumn("__geoid", geoid(state, county))
    # any one row per key: min() over the pair keeps repeated runs identical
    unique = centroids.groupBy(F.col("geoid").alias("__geoid")).agg(F.min(F.struct("lat", "lon")).alias("__real"))
    joined = keyed.join(unique, "__geoid", "left")
    good = F.col("__real").isNotNull()
    if min_match is not None:
        good = joined.agg((F.count("__real") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("m")).scalar() >= F.lit(min_match)
    spread = approx_coords(joined).withColumn("__good", good)
    return spread.select(
        *df.columns,
        F.when(F.col("__good"), F.col("__real.lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(F.col("__good"), F.col("__real.lon")).otherwise(F.col("lon")).alias("lon"),
        F.when(F.col("__good"), F.lit("centroid")).otherwise(F.lit("approximate")).alias("source"),
    )


def map_layer(polygons: DataFrame, aggregates: DataFrame, keys=("state_fips", "county_fips")) -> DataFrame:
    """Every polygon with its aggregates, empty counties included."""
    return polygons.join(aggregates, list(keys), "left")
