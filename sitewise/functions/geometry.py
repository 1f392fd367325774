"""Geometry normal form: MULTI = array of polygons, polygon = array of rings, ring = array of points.

The first ring of a polygon is its outline, the others are holes; rings are closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

POINT = "struct<x:double,y:double>"
POINT_TYPE = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
MULTI = f"array<array<array<{POINT}>>>"
_POLYGON_JSON = "array<array<array<double>>>"
_MULTI_JSON = f"array<{_POLYGON_JSON}>"
# The box in which a swapped first vertex is recognised.
SWAP_LAT, SWAP_LON = (49.8, 60.9), (-8.2, 1.9)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def multi_of_ring(*points: tuple[Column, Column]) -> Column:
    """A one-ring geometry from its corners; the ring is closed here."""
    return F.array(F.array(F.array(*[point(x, y) for x, y in (*points, points[0])])))


def format_reason(doc: Column) -> Column:
    """Why a GeoJSON text is not a Feature with a polygon; the empty string where it is one."""
    kind = F.get_json_object(doc, "$.type")
    geometry = F.get_json_object(doc, "$.geometry")
    shape = F.get_json_object(doc, "$.geometry.type")
    none = F.lit("None")
    return (
        F.when(kind.isNull() | (kind != "Feature"),
               F.concat(F.lit("Expected 'Feature', got '"), F.coalesce(kind, none), F.lit("'")))
        .when(geometry.isNull() | geometry.isin("", "{}", "null"), F.lit("Missing 'geometry' field"))
        .when(shape.isNull() | ~shape.isin("MultiPolygon", "Polygon"),
              F.concat(F.lit("Expected 'MultiPolygon' or 'Polygon', got '"), F.coalesce(shape, none), F.lit("'")))
        .otherwise(F.lit(""))
    )


def geometry_text(doc: Column) -> Column:
    """The geometry member as JSON text, also where a producer wrote it as a quoted string."""
    return F.get_json_object(doc, "$.geometry")


def _points(ring: Column) -> Column:
    closed = F.transform(ring, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    open_ring = F.element_at(closed, 1) != F.element_at(closed, -1)
    return F.when(open_ring, F.concat(closed, F.slice(closed, 1, 1))).otherwise(closed)


def parse_geometry(doc: Column) -> Column:
    """GeoJSON Feature text to the normal form. Rings with fewer than four points are dropped,
    with the whole polygon where it is the outline; NULL where nothing is left."""
    text = geometry_text(doc)
    shape = F.get_json_object(text, "$.type")
    coordinates = F.get_json_object(text, "$.coordinates")
    parts = F.when(shape == "Polygon", F.array(F.from_json(coordinates, _POLYGON_JSON))).when(
        shape == "MultiPolygon", F.from_json(coordinates, _MULTI_JSON)
    )
    rings = F.transform(parts, lambda poly: F.transform(poly, lambda ring: F.when(F.size(ring) >= 3, _points(ring))))
    rings = F.transform(rings, lambda poly: F.transform(poly, lambda ring: F.when(F.size(ring) >= 4, ring)))
    solid = F.filter(rings, lambda poly: F.get(poly, F.lit(0)).isNotNull())
    solid = F.transform(solid, lambda poly: F.array_compact(poly))
    return F.when(F.size(solid) > 0, solid)


def to_geojson(geom: Column, properties: Column | None = None) -> Column:
    """Normal form back to a Feature; always a MultiPolygon."""
    coordinates = F.transform(
        geom, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    )
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            (F.create_map().cast("map<string,string>") if properties is None else properties).alias("properties"),
        )
    )


def swapped_axes(geom: Column) -> Column:
    """True where the first vertex reads as (lat, lon) instead of (lon, lat)."""
    first = F.get(F.get(F.get(geom, F.lit(0)), F.lit(0)), F.lit(0))
    return F.coalesce(first["x"].between(*SWAP_LAT) & first["y"].between(*SWAP_LON), F.lit(False))


def bounds(geom: Column) -> Column:
    flat = F.flatten(F.flatten(geom))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )


def edges(df: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """One row per segment: keys, part, ring, pos, x0, y0, x1, y1."""
    df = df.select(*keys, F.posexplode(geom).alias("part", "_poly"))
    df = df.select(*keys, "part", F.posexplode("_poly").alias("ring", "_ring"))
    sides = F.arrays_zip(
        F.slice("_ring", F.lit(1), F.size("_ring") - 1).alias("a"),
        F.slice("_ring", F.lit(2), F.size("_ring") - 1).alias("b"),
    )
    df = df.select(*keys, "part", "ring", F.posexplode(sides).alias("pos", "_s"))
    return df.select(
        *keys, "part", "ring", "pos",
        F.col("_s.a.x").alias("x0"), F.col("_s.a.y").alias("y0"),
        F.col("_s.b.x").alias("x1"), F.col("_s.b.y").alias("y1"),
    )


def scale_vertices(vertices: Column, width: Column, height: Column) -> Column:
    """Normalised (y, x) in [0, 1000] to pixel (x, y)."""
    return F.transform(
        vertices, lambda v: point(F.get(v, F.lit(1)) * width / 1000, F.get(v, F.lit(0)) * height / 1000)
    )


def vertices_out_of_range(vertices: Column) -> Column:
    return F.size(
        F.filter(vertices, lambda v: ~(F.get(v, F.lit(0)).between(0, 1000) & F.get(v, F.lit(1)).between(0, 1000)))
    )
