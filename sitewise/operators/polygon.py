"""Measures of one polygon: area, centroid, bounds, span, containment and boundary distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sitewise.functions import geo
from sitewise.functions.geometry import POINT_TYPE


def _ring_moments(ring: Column, i: Column) -> Column:
    """Area and first moments of one ring: the outline counts as positive, holes as negative.

    One pass over the ring, relative to its first corner so that large coordinates do not cancel.
    """
    origin = F.element_at(ring, 1)
    relative = F.transform(
        ring, lambda p: F.struct((p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y"))
    )
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("x", "y", "a", "mx", "my")])

    def step(acc: Column, q: Column) -> Column:
        cross = acc["x"] * q["y"] - q["x"] * acc["y"]
        return F.struct(
            q["x"].alias("x"), q["y"].alias("y"),
            (acc["a"] + cross / 2).alias("a"),
            (acc["mx"] + (acc["x"] + q["x"]) * cross / 6).alias("mx"),
            (acc["my"] + (acc["y"] + q["y"]) * cross / 6).alias("my"),
        )

    def finish(acc: Column) -> Column:
        sign = F.signum(acc["a"]) * F.when(i == 0, 1.0).otherwise(-1.0)
        return F.struct(
            (sign * acc["a"]).alias("a"),
            (sign * (acc["mx"] + acc["a"] * origin["x"])).alias("mx"),
            (sign * (acc["my"] + acc["a"] * origin["y"])).alias("my"),
        )

    return F.aggregate(relative, zero, step, finish)


def _moments(geom: Column, finish) -> Column:
    rings = F.flatten(F.transform(geom, lambda poly: F.transform(poly, _ring_moments)))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "mx", "my")])
    return F.aggregate(
        rings, zero, lambda acc, m: F.struct(*[(acc[n] + m[n]).alias(n) for n in ("a", "mx", "my")]), finish
    )


def area(geom: Column) -> Column:
    return _moments(geom, lambda m: m["a"])


def centroid(geom: Column) -> Column:
    """Area-weighted centre over all parts and holes; the vertex mean where the area is zero."""
    points = F.flatten(F.flatten(geom))
    n = F.size(points)
    mean = F.struct(
        (F.aggregate(points, F.lit(0.0), lambda a, p: a + p["x"]) / n).alias("x"),
        (F.aggregate(points, F.lit(0.0), lambda a, p: a + p["y"]) / n).alias("y"),
    )
    exact = _moments(
        geom, lambda m: F.when(m["a"] != 0, F.struct((m["mx"] / m["a"]).alias("x"), (m["my"] / m["a"]).alias("y")))
    )
    return F.coalesce(exact, mean)


def area_centroid(geom: Column) -> Column:
    """Struct of area and centroid (c) from one pass over the corners, where both are asked for."""
    points = F.flatten(F.flatten(geom))

    def mean(axis: str) -> Column:
        return F.try_divide(F.aggregate(points, F.lit(0.0), lambda a, p: a + p[axis]), F.size(points))

    def both(m: Column) -> Column:
        solid = m["a"] != 0
        return F.struct(m["a"].alias("area"), F.struct(
            F.when(solid, m["mx"] / m["a"]).otherwise(mean("x")).alias("x"),
            F.when(solid, m["my"] / m["a"]).otherwise(mean("y")).alias("y")).alias("c"))

    return _moments(geom, both)


def part_centroids(geom: Column) -> Column:
    return F.transform(geom, lambda poly: centroid(F.array(poly)))


def nearest_part_error_km(lat: Column, lon: Column, geom: Column) -> Column:
    """Distance from a pick to the nearest part centre; NULL without parts."""
    return F.array_min(
        F.transform(part_centroids(geom), lambda c: geo.haversine_km(lat, lon, c["y"], c["x"]))
    )


def _hull(xs: np.ndarray, ys: np.ndarray) -> list[tuple[float, float]]:
    """Convex hull of a point set in the plane."""
    points = sorted(set(zip(xs.tolist(), ys.tolist())))
    if len(points) < 3:
        return points

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
            ) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


@F.pandas_udf(ArrayType(POINT_TYPE))
def hull_points(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series(
        [[{"x": px, "y": py} for px, py in _hull(np.asarray(x), np.asarray(y))] for x, y in zip(xs, ys)]
    )


def span_m(df: DataFrame, geom: str = "geom", out: str = "span_m") -> DataFrame:
    """Add the widest distance in metres between two corners of the planar hull (degrees in)."""
    flat = F.flatten(F.flatten(F.col(geom)))
    df = df.withColumn(
        "_hull", hull_points(F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"]))
    )

    def farthest(p: Column, i: Column) -> Column:
        rest = F.slice(F.col("_hull"), i + 1, F.size("_hull"))
        return F.array_max(F.transform(rest, lambda q: geo.haversine_m(p["y"], p["x"], q["y"], q["x"])))

    widest = F.array_max(F.transform("_hull", farthest))
    return df.withColumn(out, F.coalesce(widest, F.lit(0.0))).drop("_hull")


def boundary_distance_km(points: DataFrame, edges: DataFrame, point_id: str, polygon_id: str) -> DataFrame:
    """point_id, polygon_id, distance_km from each point to the nearest spot of its polygon's rings.

    `points` has lat, lon and polygon_id; `edges` has polygon_id and x0..y1 in degrees. Nearness is
    planar in degrees, the distance to that spot is on the sphere.
    """
    joined = points.select(point_id, polygon_id, F.col("lon").alias("px"), F.col("lat").alias("py")).join(
        edges.select(polygon_id, "x0", "y0", "x1", "y1"), polygon_id
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = (F.col("px") - F.col("x0")) * dx + (F.col("py") - F.col("y0")) * dy
    t = F.coalesce(F.try_divide(along, dx * dx + dy * dy), F.lit(0.0))
    joined = joined.withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    joined = joined.withColumns({"_nx": F.col("x0") + F.col("_t") * dx, "_ny": F.col("y0") + F.col("_t") * dy})
    planar = F.pow(F.col("_nx") - F.col("px"), 2) + F.pow(F.col("_ny") - F.col("py"), 2)
    nearest = F.min_by(F.struct("_nx", "_ny", "px", "py"), planar).alias("_s")
    best = joined.groupBy(point_id, polygon_id).agg(nearest)
    return best.select(
        point_id, polygon_id,
        geo.haversine_km(F.col("_s.py"), F.col("_s.px"), F.col("_s._ny"), F.col("_s._nx")).alias("distance_km"),
    )


def check_in_area(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, size: float) -> DataFrame:
    """point_id, polygon_id, inside, distance_km (0 inside, two decimals) for (point, area) pairs.

    `points` has point_id, polygon_id, lat, lon; `polygons` has polygon_id and geom in degrees.
    """
    from sitewise.functions.geometry import edges
    from sitewise.operators.cells import points_in_polygons

    spots = points.select(point_id, F.col("lon").alias("x"), F.col("lat").alias("y"))
    hits = points_in_polygons(spots, polygons, point_id, polygon_id, size).withColumn("_in", F.lit(True))
    paired = points.join(hits, [point_id, polygon_id], "left")
    outside = paired.where("_in IS NULL")
    away = boundary_distance_km(outside, edges(polygons, [polygon_id]), point_id, polygon_id)
    return paired.join(away, [point_id, polygon_id], "left").select(
        point_id, polygon_id, F.coalesce("_in", F.lit(False)).alias("inside"),
        F.when(F.col("_in"), F.lit(0.0)).otherwise(F.round("distance_km", 2)).alias("distance_km"),
    )
