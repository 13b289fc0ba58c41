"""Point in polygon and polygon area with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import EARTH_RADIUS_M
from ..session import stage

RINGS = "array<array<array<struct<lon:double,lat:double>>>>"
BROADCAST_BYTES = 128 << 20
BYTES_PER_CELL, BYTES_PER_EDGE, BYTES_PER_FLIP = 64, 64, 8


def _edges(ring: Column) -> Column:
    """Consecutive point pairs of a closed ring."""
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def crossing(lon: Column, lat: Column, e: Column) -> Column:
    """The edge lies to the right of the point at its latitude."""
    a, b = e["a"], e["b"]
    spans = (a["lat"] > lat) != (b["lat"] > lat)
    x = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
    return spans & (lon < x)


def inside(lon: Column, lat: Column, polygons: Column) -> Column:
    """Even-odd test over all rings, holes included: odd number of edges to the right of the point."""
    crossings = F.aggregate(
        F.flatten(polygons), F.lit(0), lambda acc, ring: acc + F.size(F.filter(_edges(ring), lambda e: crossing(lon, lat, e)))
    )
    return crossings % 2 == 1


def _cell(x: Column, step: float) -> Column:
    return F.floor(x / step)


def polygon_cells(areas: DataFrame, key: str, step: float, polygons: str = "polygons") -> DataFrame:
    """Grid cells that an area reaches into, each with what decides a point in it and no more.

    One row per area row and cell: (key, _cx, _cy, _edges, _flips). _edges are the edges whose box touches the cell.
    Edges wholly to the right of the cell matter by latitude alone, and where two of them meet they cancel: _flips are
    the latitudes at which their number turns from even to odd or back, -inf for what holds below the cell. A cell
    inside has one flip at -inf and no edge, a cell outside no row at all. All comparisons go by cell numbers, which
    rise with the coordinate, so the result is that of `inside` on the whole rings.
    """
    edge = F.explode(F.flatten(F.transform(F.flatten(polygons), _edges))).alias("e")
    edges = areas.select(key, F.monotonically_increasing_id().alias("_aid"), polygons).select(key, "_aid", edge)
    lon = lambda f: f(F.col("e.a.lon"), F.col("e.b.lon"))
    lat = lambda f: f(F.col("e.a.lat"), F.col("e.b.lat"))
    # a level edge is never crossed
    rows = edges.where("e.a.lat <> e.b.lat").select(
        key, "_aid", "e", _cell(lon(F.least), step).alias("_x0"), _cell(lon(F.greatest), step).alias("_x1"),
        lat(F.least).alias("_y0"), lat(F.greatest).alias("_y1"),
    )
    bands = stage(rows.withColumn("_cy", F.explode(F.sequence(_cell(F.col("_y0"), step), _cell(F.col("_y1"), step)))))
    place = [key, "_aid", "_cx", "_cy"]
    near = bands.withColumn("_cx", F.explode(F.sequence("_x0", "_x1"))).select(*place, "e", F.lit(None).cast("double").alias("_y"))

    ends = bands.select(key, "_aid", "_cy", "_x0", F.explode(F.array("_y0", "_y1")).alias("_y")).where(_cell(F.col("_y"), step) <= F.col("_cy"))
    ends = ends.withColumn("_y", F.when(_cell(F.col("_y"), step) < F.col("_cy"), F.lit(float("-inf"))).otherwise(F.col("_y")))
    odd = lambda df, *by: df.groupBy(key, "_aid", "_cy", *by, "_y").agg((F.count("*") % 2).alias("_odd")).where("_odd = 1")
    left = bands.groupBy("_aid", "_cy").agg(F.min("_x0").alias("_left")).withColumnsRenamed({"_aid": "_a", "_cy": "_b"})
    columns = odd(ends, "_x0").join(left, (F.col("_aid") == F.col("_a")) & (F.col("_cy") == F.col("_b")))
    columns = columns.where("_left < _x0").withColumn("_cx", F.explode(F.sequence("_left", F.col("_x0") - 1)))
    flips = odd(columns, "_cx").select(*place, F.lit(None).cast(dict(bands.dtypes)["e"]).alias("e"), "_y")
    return near.unionByName(flips).groupBy(*place).agg(F.collect_list("e").alias("_edges"), F.collect_list("_y").alias("_flips")).drop("_aid")


def inside_cell(lon: Column, lat: Column, edges: Column, flips: Column) -> Column:
    """`inside` for a point of the cell that the edges and flips belong to."""
    return (F.size(F.filter(flips, lambda y: y <= lat)) + F.size(F.filter(edges, lambda e: crossing(lon, lat, e)))) % 2 == 1


def cell_bytes(cells: DataFrame) -> int:
    """Estimated size of the cell table from its rows, edges and flips."""
    content = F.size("_edges") * BYTES_PER_EDGE + F.size("_flips") * BYTES_PER_FLIP
    row = cells.agg(F.count("*").alias("n"), F.coalesce(F.sum(content), F.lit(0)).alias("v")).first()
    return row["n"] * BYTES_PER_CELL + row["v"]


def assign_areas(
    points: DataFrame,
    areas: DataFrame,
    key: str,
    step: float,
    lon: str = "lon",
    lat: str = "lat",
    polygons: str = "polygons",
) -> DataFrame:
    """Left join of points to the polygons that contain them.

    Points meet the cells of the areas in an equi-join, and the exact test sees the edges of that cell only. A point in
    no polygon keeps a null key; in overlapping polygons it appears once for each. Points on an edge count for at most
    one of the two sides. The cell table is written once and broadcast only when its measured size allows it; beyond
    that the points meet it in a shuffle join on the cell, where Spark splits crowded cells.
    """
    cells = stage(polygon_cells(areas, key, step, polygons))
    if cell_bytes(cells) <= BROADCAST_BYTES:
        cells = F.broadcast(cells)
    located = points.withColumns({"_px": _cell(F.col(lon), step), "_py": _cell(F.col(lat), step)})
    hit = (
        (F.col("_px") == F.col("_cx"))
        & (F.col("_py") == F.col("_cy"))
        & inside_cell(F.col(lon), F.col(lat), F.col("_edges"), F.col("_flips"))
    )
    return located.join(cells, hit, "left").drop("_px", "_py", "_cx", "_cy", "_edges", "_flips")


def match_rate(assigned: DataFrame, key: str) -> DataFrame:
    """Rows, matched rows and their share."""
    return assigned.agg(
        F.count("*").alias("row_count"),
        F.count(key).alias("matched_rows"),
        (F.count(key) / F.count("*")).alias("match_rate"),
    )


def ring_area_m2(ring: Column, lat0: Column | None = None) -> Column:
    """Shoelace area on the equirectangular plane around lat0 (degrees), default the mean ring latitude."""
    mean_lat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    scale = F.cos(F.radians(mean_lat if lat0 is None else lat0))
    twice = F.aggregate(
        _edges(ring),
        F.lit(0.0),
        lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"],
    )
    metres_per_degree = F.radians(F.lit(1.0)) * EARTH_RADIUS_M
    return F.when(F.size(ring) < 4, 0.0).otherwise(F.abs(twice) / 2 * scale * metres_per_degree * metres_per_degree)


def area_km2(areas: DataFrame, key: str, lat0: float | None = None, polygons: str = "polygons") -> DataFrame:
    """Outer ring minus holes, summed over the polygons of a key; not positive -> null."""
    centre = None if lat0 is None else F.lit(float(lat0))
    holes = F.aggregate(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + ring_area_m2(r, centre))
    net = F.greatest(ring_area_m2(F.element_at("_p", 1), centre) - holes, F.lit(0.0))
    per_key = areas.select(key, F.explode(polygons).alias("_p")).groupBy(key).agg((F.sum(net) / 1e6).alias("_km2"))
    return per_key.select(key, F.when(F.col("_km2") > 0, F.col("_km2")).alias("area_km2"))
