"""Geometry across coordinate systems, vertex by vertex: every corner is a row of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions import crs

Transform = Callable[[DataFrame, str, str, str, str], DataFrame]


def vertices(df: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """keys, part, ring, pos, x, y."""
    df = df.select(*keys, F.posexplode(geom).alias("part", "_poly"))
    df = df.select(*keys, "part", F.posexplode("_poly").alias("ring", "_ring"))
    return df.select(*keys, "part", "ring", F.posexplode("_ring").alias("pos", "_p")).select(
        *keys, "part", "ring", "pos", "_p.x", "_p.y"
    )


def grid_to_degrees(df: DataFrame, x: str, y: str, out_x: str, out_y: str) -> DataFrame:
    return crs.bng_to_wgs84(df, x, y, out_y, out_x)


def degrees_to_grid(df: DataFrame, x: str, y: str, out_x: str, out_y: str) -> DataFrame:
    return crs.wgs84_to_bng(df, y, x, out_x, out_y)


def reprojected_bounds(df: DataFrame, key: str, transform: Transform, geom: str = "geom") -> DataFrame:
    """key, minx, miny, maxx, maxy after reprojecting every vertex, not just the box's corners."""
    moved = transform(vertices(df, [key], geom), "x", "y", "_tx", "_ty")
    return moved.groupBy(key).agg(
        F.min("_tx").alias("minx"), F.min("_ty").alias("miny"), F.max("_tx").alias("maxx"), F.max("_ty").alias("maxy")
    )


def geometry_pixels(df: DataFrame, key: str, box: list[str], size: list[str], geom: str = "geom") -> DataFrame:
    """key, part, ring, pos, px, py: grid geometry on a canvas.

    `box` names the canvas' Mercator bounds (xmin, ymin, xmax, ymax), `size` its width and height.
    """
    rows = grid_to_degrees(vertices(df, [key, *box, *size], geom), "x", "y", "_lon", "_lat")
    mx, my = crs.mercator_x(F.col("_lon")), crs.mercator_y(F.col("_lat"))
    xmin, ymin, xmax, ymax = (F.col(b) for b in box)
    return rows.select(
        key, "part", "ring", "pos",
        ((mx - xmin) / (xmax - xmin) * F.col(size[0])).alias("px"),
        ((1 - (my - ymin) / (ymax - ymin)) * F.col(size[1])).alias("py"),
    )
