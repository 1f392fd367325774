"""British National Grid, WGS84 and Web Mercator.

Each step is a projection of its own, so an intermediate value is computed once per row and
stays inside code generation; nesting it all in one column would repeat the terms many times.
The grid step is the seven-parameter shift, a few metres off the surveyed shift grid.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ellipsoids, grid projection and datum shift as published by Ordnance Survey.
AIRY = (6377563.396, 6356256.909)
WGS84 = (6378137.0, 6356752.314245)
GRID_SCALE = 0.9996012717
GRID_LAT0, GRID_LON0 = math.radians(49.0), math.radians(-2.0)
GRID_E0, GRID_N0 = 400000.0, -100000.0
TO_WGS84 = (446.448, -125.157, 542.060)
TO_WGS84_ROTATION_SEC = (0.1502, 0.2470, 0.8421)
TO_WGS84_SCALE_PPM = -20.4894
MERCATOR_RADIUS = 6378137.0

_A, _B = AIRY
_E2 = 1 - (_B / _A) ** 2
_N = (_A - _B) / (_A + _B)


def _meridian_arc(lat: Column) -> Column:
    n = _N
    dif, tot = lat - GRID_LAT0, lat + GRID_LAT0
    return F.lit(_B * GRID_SCALE) * (
        F.lit(1 + n + 1.25 * n**2 + 1.25 * n**3) * dif
        - F.lit(3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(dif) * F.cos(tot)
        + F.lit(1.875 * (n**2 + n**3)) * F.sin(2 * dif) * F.cos(2 * tot)
        - F.lit(35 / 24 * n**3) * F.sin(3 * dif) * F.cos(3 * tot)
    )


def _arc_at_origin() -> float:
    """Arc length from the equator to the grid origin, in the rectifying series."""
    n, lat = _N, GRID_LAT0
    series = (
        (1 + n**2 / 4 + n**4 / 64) * lat
        - 1.5 * (n - n**3 / 8) * math.sin(2 * lat)
        + 15 / 16 * (n**2 - n**4 / 4) * math.sin(4 * lat)
        - 35 / 48 * n**3 * math.sin(6 * lat)
    )
    return _A / (1 + n) * series


def _to_cartesian(df: DataFrame, lat: str, lon: str, ellipsoid: tuple[float, float]) -> DataFrame:
    a, b = ellipsoid
    e2 = 1 - (b / a) ** 2
    df = df.withColumn("_nu", F.lit(a) / F.sqrt(1 - F.lit(e2) * F.pow(F.sin(lat), 2)))
    return df.withColumns(
        {
            "_x": F.col("_nu") * F.cos(lat) * F.cos(lon),
            "_y": F.col("_nu") * F.cos(lat) * F.sin(lon),
            "_z": F.lit(1 - e2) * F.col("_nu") * F.sin(lat),
        }
    )


def _shift_matrix() -> np.ndarray:
    rx, ry, rz = (math.radians(r / 3600) for r in TO_WGS84_ROTATION_SEC)
    k = 1 + TO_WGS84_SCALE_PPM * 1e-6
    return np.array([[k, -rz, ry], [rz, k, -rx], [-ry, rx, k]])


def _shift(df: DataFrame, to_wgs84: bool) -> DataFrame:
    """Datum shift; the way back is the exact inverse of the way there."""
    matrix, offset = _shift_matrix(), np.array(TO_WGS84)
    if not to_wgs84:
        matrix = np.linalg.inv(matrix)
        offset = -matrix @ offset
    axes = [F.col("_x"), F.col("_y"), F.col("_z")]
    return df.withColumns(
        {
            name: F.lit(float(offset[i])) + sum(F.lit(float(matrix[i, j])) * axes[j] for j in range(3))
            for i, name in enumerate(("_x2", "_y2", "_z2"))
        }
    )


def _to_geodetic(df: DataFrame, lat: str, lon: str, ellipsoid: tuple[float, float]) -> DataFrame:
    """Bowring's closed form; exact to nanometres near the ground."""
    a, b = ellipsoid
    e2, ep2 = 1 - (b / a) ** 2, (a / b) ** 2 - 1
    df = df.withColumn("_p", F.hypot("_x2", "_y2"))
    df = df.withColumn("_t", F.atan2(F.lit(a) * F.col("_z2"), F.lit(b) * F.col("_p")))
    return df.withColumns(
        {
            lat: F.atan2(
                F.col("_z2") + F.lit(ep2 * b) * F.pow(F.sin("_t"), 3),
                F.col("_p") - F.lit(e2 * a) * F.pow(F.cos("_t"), 3),
            ),
            lon: F.atan2("_y2", "_x2"),
        }
    )


def _grid_terms(df: DataFrame, lat: str) -> DataFrame:
    df = df.withColumn("_s", 1 - F.lit(_E2) * F.pow(F.sin(lat), 2))
    df = df.withColumn("_nu", F.lit(_A * GRID_SCALE) / F.sqrt("_s"))
    df = df.withColumn("_rho", F.lit(_A * GRID_SCALE * (1 - _E2)) * F.pow("_s", F.lit(-1.5)))
    return df.withColumns({"_eta2": F.col("_nu") / F.col("_rho") - 1, "_tan": F.tan(lat)})


def bng_to_osgb_radians(df: DataFrame, easting: str, northing: str, lat: str, lon: str) -> DataFrame:
    """Projection step alone: grid metres to latitude and longitude on the Airy ellipsoid."""
    n = _N
    rectifying_radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    mu = (F.col(northing) - GRID_N0) / F.lit(GRID_SCALE) + _arc_at_origin()
    df = df.withColumn("_mu", mu / F.lit(rectifying_radius))
    m = F.col("_mu")
    df = df.withColumn(
        "_phi",
        m
        + F.lit(1.5 * n - 27 / 32 * n**3) * F.sin(2 * m)
        + F.lit(21 / 16 * n**2 - 55 / 32 * n**4) * F.sin(4 * m)
        + F.lit(151 / 96 * n**3) * F.sin(6 * m)
        + F.lit(1097 / 512 * n**4) * F.sin(8 * m),
    )
    df = _grid_terms(df, "_phi").withColumn("_de", F.col(easting) - GRID_E0)
    t, nu, rho, eta2, de = (F.col(c) for c in ("_tan", "_nu", "_rho", "_eta2", "_de"))
    t2, t4, t6 = F.pow(t, 2), F.pow(t, 4), F.pow(t, 6)
    seven = t / (2 * rho * nu)
    eight = t / (24 * rho * F.pow(nu, 3)) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2)
    nine = t / (720 * rho * F.pow(nu, 5)) * (61 + 90 * t2 + 45 * t4 + eta2 * (46 - 252 * t2 - 90 * t4))
    last = t / (40320 * rho * F.pow(nu, 7)) * (1385 + 3633 * t2 + 4095 * t4 + 1575 * t6)
    ten = 1 / nu
    eleven = (nu / rho + 2 * t2) / (6 * F.pow(nu, 3))
    twelve = (5 + 28 * t2 + 24 * t4 + eta2 * (6 + 8 * t2)) / (120 * F.pow(nu, 5))
    twelve_a = (61 + 662 * t2 + 1320 * t4 + 720 * t6) / (5040 * F.pow(nu, 7))
    sec = 1 / F.cos("_phi")
    return df.withColumns(
        {
            lat: F.col("_phi") - seven * F.pow(de, 2) + eight * F.pow(de, 4) - nine * F.pow(de, 6)
            + last * F.pow(de, 8),
            lon: F.lit(GRID_LON0)
            + sec * (ten * de - eleven * F.pow(de, 3) + twelve * F.pow(de, 5) - twelve_a * F.pow(de, 7)),
        }
    )


def bng_to_wgs84(
    df: DataFrame, easting: str = "easting", northing: str = "northing", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Add WGS84 degrees for grid metres; NULL in gives NULL out."""
    keep = [c for c in df.columns if c not in (lat, lon)]
    df = bng_to_osgb_radians(df, easting, northing, "_lat", "_lon")
    df = _to_geodetic(_shift(_to_cartesian(df, "_lat", "_lon", AIRY), True), "_lat2", "_lon2", WGS84)
    return df.select(*keep, F.degrees("_lat2").alias(lat), F.degrees("_lon2").alias(lon))


def wgs84_to_bng(
    df: DataFrame, lat: str = "lat", lon: str = "lon", easting: str = "easting", northing: str = "northing"
) -> DataFrame:
    """Add grid metres for WGS84 degrees."""
    keep = [c for c in df.columns if c not in (easting, northing)]
    df = df.withColumns({"_lat": F.radians(lat), "_lon": F.radians(lon)})
    df = _to_geodetic(_shift(_to_cartesian(df, "_lat", "_lon", WGS84), False), "_phi", "_lam", AIRY)
    df = _grid_terms(df, "_phi").withColumn("_dl", F.col("_lam") - GRID_LON0)
    t, nu, rho, eta2, dl = (F.col(c) for c in ("_tan", "_nu", "_rho", "_eta2", "_dl"))
    t2, t4, t6 = F.pow(t, 2), F.pow(t, 4), F.pow(t, 6)
    sin, cos = F.sin("_phi"), F.cos("_phi")
    one = _meridian_arc(F.col("_phi")) + GRID_N0
    two = nu / 2 * sin * cos
    three = nu / 24 * sin * F.pow(cos, 3) * (5 - t2 + 9 * eta2)
    three_a = nu / 720 * sin * F.pow(cos, 5) * (61 - 58 * t2 + t4)
    four = nu * cos
    five = nu / 6 * F.pow(cos, 3) * (nu / rho - t2)
    six = nu / 120 * F.pow(cos, 5) * (5 - 18 * t2 + t4 + 14 * eta2 - 58 * t2 * eta2)
    # One term past the published series on each axis: millimetres at the grid's western edge.
    east_7 = nu / 5040 * F.pow(cos, 7) * (61 - 479 * t2 + 179 * t4 - t6)
    north_8 = nu / 40320 * sin * F.pow(cos, 7) * (1385 - 3111 * t2 + 543 * t4 - t6)
    east = F.lit(GRID_E0) + four * dl + five * F.pow(dl, 3) + six * F.pow(dl, 5) + east_7 * F.pow(dl, 7)
    north = one + two * F.pow(dl, 2) + three * F.pow(dl, 4) + three_a * F.pow(dl, 6) + north_8 * F.pow(dl, 8)
    return df.select(
        *keep,
        east.alias(easting),
        north.alias(northing),
    )


def mercator_x(lon: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_RADIUS)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - F.pi() / 2)


def mercator_box_to_bng(df: DataFrame, box: list[str], out: list[str], pad: float = 0.05) -> DataFrame:
    """Grid box of a Mercator box from two corners, padded by a share of the larger side."""
    keep = [c for c in df.columns if c not in out]
    for i, (x, y) in enumerate(((box[0], box[1]), (box[2], box[3]))):
        df = df.withColumns({"_clat": mercator_lat(F.col(y)), "_clon": mercator_lon(F.col(x))})
        df = wgs84_to_bng(df, "_clat", "_clon", f"_e{i}", f"_n{i}")
    margin = F.greatest(F.abs(F.col("_e1") - F.col("_e0")), F.abs(F.col("_n1") - F.col("_n0"))) * pad
    df = df.withColumn("_pad", margin)
    return df.select(
        *keep,
        (F.least("_e0", "_e1") - F.col("_pad")).alias(out[0]),
        (F.least("_n0", "_n1") - F.col("_pad")).alias(out[1]),
        (F.greatest("_e0", "_e1") + F.col("_pad")).alias(out[2]),
        (F.greatest("_n0", "_n1") + F.col("_pad")).alias(out[3]),
    )
