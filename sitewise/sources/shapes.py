"""Readers of shapefiles, zipped road tiles and GeoPackage layers as Spark data sources.

A reader splits its files into record ranges, so each task decodes its own range.
"""

from __future__ import annotations

import glob as globlib
import io
import os
import sqlite3
import struct
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual,
)

from sitewise.functions.geometry import MULTI
from sitewise.operators.union import _area2, _inside

RECORDS_PER_SPLIT = 20_000
# Admin layers, the earlier claims a name first.
ADMIN_LAYERS = (
    "district_borough_unitary_region.shp", "county_region.shp", "boundary-line-ceremonial-counties_region.shp",
)


def _record_count(shx_size: int) -> int:
    return (shx_size - 100) // 8


def _shape(record: bytes) -> tuple[int, list[list[tuple[float, float]]]]:
    """Type and parts of one record; plain, Z and M kinds share the layout of the plane part."""
    kind = struct.unpack_from("<i", record, 0)[0]
    if kind % 10 not in (3, 5):
        return kind, []
    n_parts, n_points = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", record, 44 + 4 * n_parts)
    points = list(zip(flat[::2], flat[1::2]))
    return kind, [points[a:b] for a, b in zip(starts, starts[1:])]


def _polygons(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Clockwise rings are outlines, the others holes of the outline that holds them."""
    rings = [r for r in rings if len(r) >= 4]
    polygons = [[r] for r in rings if _area2(r) <= 0]
    for hole in (r for r in rings if _area2(r) > 0):
        middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        holders = [p for p in polygons if _inside(middle, p[0])]
        if holders:
            holders[0].append(hole)
        else:
            polygons.append([hole])
    return polygons


def _fields(dbf) -> tuple[int, int, list[tuple[str, int, int]]]:
    """Header length, record length and (name, offset, length) of an attribute table."""
    head = dbf.read(32)
    header, length = struct.unpack_from("<2H", head, 8)
    fields, offset = [], 1
    while True:
        raw = dbf.read(32)
        if len(raw) < 32 or raw[0] == 0x0D:
            return header, length, fields
        fields.append((raw[:11].split(b"\0")[0].decode("latin-1"), offset, raw[16]))
        offset += raw[16]


def _records(shp, shx, dbf, first: int, last: int) -> Iterator[tuple[int, dict[str, str], int, list]]:
    """index, attributes, kind, parts of records first..last-1."""
    header, length, fields = _fields(dbf)
    for i in range(first, last):
        shx.seek(100 + 8 * i)
        offset, size = (2 * v for v in struct.unpack(">2i", shx.read(8)))
        shp.seek(offset + 8)
        kind, parts = _shape(shp.read(size))
        dbf.seek(header + i * length)
        row = dbf.read(length)
        yield i, {n: row[o : o + w].decode("latin-1").strip() for n, o, w in fields}, kind, parts


def _points(ring) -> list[tuple[float, float]]:
    return [(float(x), float(y)) for x, y in ring]


class RecordRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[RecordRange]:
        files = sorted(globlib.glob(self.path, recursive=True)) if globlib.has_magic(self.path) else [self.path]
        return [
            RecordRange(f, a, min(n, a + RECORDS_PER_SPLIT))
            for f in files
            for n in [_record_count(os.path.getsize(f[:-4] + ".shx"))]
            for a in range(0, n, RECORDS_PER_SPLIT)
        ]

    def read(self, partition: RecordRange) -> Iterator[tuple]:
        base = partition.path[:-4]
        with open(base + ".shp", "rb") as shp, open(base + ".shx", "rb") as shx, open(base + ".dbf", "rb") as dbf:
            for i, attributes, _, parts in _records(shp, shx, dbf, partition.first, partition.last):
                if parts:
                    geom = [[_points(r) for r in poly] for poly in _polygons(parts)]
                    yield partition.path, i, {k.lower(): v for k, v in attributes.items()}, geom


class ShapefileSource(DataSource):
    """format("shp"): file, record, attributes (lower-case names), geom in the file's coordinates."""

    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> str:
        return f"file string, record int, attributes map<string,string>, geom {MULTI}"

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(self.options["path"])


def _wkb(data: bytes, at: int = 0) -> tuple[int, list, int]:
    """Plane kind, polygons (lines as one-ring polygons) and the next position."""
    order = "<" if data[at] == 1 else ">"
    raw = struct.unpack_from(order + "I", data, at + 1)[0]
    kind, dims = raw % 1000, 2 + (raw // 1000 in (1, 2)) + 2 * (raw // 1000 == 3)
    at += 5

    def points(at: int) -> tuple[list[tuple[float, float]], int]:
        n = struct.unpack_from(order + "I", data, at)[0]
        flat = struct.unpack_from(f"{order}{n * dims}d", data, at + 4)
        return [(flat[k], flat[k + 1]) for k in range(0, n * dims, dims)], at + 4 + 8 * n * dims

    if kind == 2:
        line, at = points(at)
        return kind, [[line]], at
    n, at = struct.unpack_from(order + "I", data, at)[0], at + 4
    if kind == 3:
        rings = []
        for _ in range(n):
            ring, at = points(at)
            rings.append(ring)
        return kind, [rings], at
    parts = []
    for _ in range(n):
        _, inner, at = _wkb(data, at)
        parts += inner
    return kind, parts, at


def _gpkg_geometry(blob: bytes) -> tuple[int, list]:
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    kind, parts, _ = _wkb(blob, 8 + envelope)
    return kind, parts


class GeoPackageReader(DataSourceReader):
    """Reads one layer by feature-id ranges; comparisons on the box columns go to the file's index."""

    def __init__(self, path: str, layer: str):
        self.path, self.layer = path, layer
        self.bounds: list[tuple[str, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, GreaterThanOrEqual) and column in ("maxx", "maxy"):
                self.bounds.append((column, ">=", float(f.value)))
            elif isinstance(f, LessThanOrEqual) and column in ("minx", "miny"):
                self.bounds.append((column, "<=", float(f.value)))
            # The index holds single precision boxes rounded outwards, so Spark checks again.
            yield f

    def _open(self) -> tuple[sqlite3.Connection, str, str]:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        row = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (self.layer,)).fetchone()
        if row is None:
            raise ValueError(f"no layer {self.layer} in {self.path}")
        key = next(r[1] for r in con.execute(f'PRAGMA table_info("{self.layer}")') if r[5])
        return con, row[0], key

    def partitions(self) -> list[RecordRange]:
        con, _, key = self._open()
        low, high = con.execute(f'SELECT min("{key}"), max("{key}") FROM "{self.layer}"').fetchone()
        con.close()
        if low is None:
            return [RecordRange(self.path, 0, 0)]
        return [RecordRange(self.path, a, min(high + 1, a + RECORDS_PER_SPLIT)) for a in range(low, high + 1, RECORDS_PER_SPLIT)]

    def read(self, partition: RecordRange) -> Iterator[tuple]:
        con, geometry, key = self._open()
        columns = {r[1].lower() for r in con.execute(f'PRAGMA table_info("{self.layer}")')}
        take = ", ".join(f't."{c}"' if c in columns else f"NULL AS {c}" for c in ("type", "name"))
        index = f"rtree_{self.layer}_{geometry}"
        indexed = con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (index,)).fetchone() and self.bounds
        sql = f'SELECT t."{key}", {take}, t."{geometry}" FROM "{self.layer}" t'
        if indexed:
            sql += f' JOIN "{index}" r ON r.id = t."{key}"'
        sql += f' WHERE t."{key}" >= ? AND t."{key}" < ?'
        values: list[float] = [partition.first, partition.last]
        if indexed:
            sql += "".join(f" AND r.{c} {op} ?" for c, op, _ in self.bounds)
            values += [v for _, _, v in self.bounds]
        for fid, kind, name, blob in con.execute(sql, values):
            if blob is None:
                continue
            _, parts = _gpkg_geometry(blob)
            points = [p for poly in parts for ring in poly for p in ring]
            if points:
                xs, ys = [p[0] for p in points], [p[1] for p in points]
                yield self.layer, fid, kind, name, [[_points(r) for r in poly] for poly in parts], min(xs), min(ys), max(xs), max(ys)
        con.close()


class GeoPackageSource(DataSource):
    """format("gpkg").option("layer", ...): layer, fid, type, name, geom and its box."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        return (
            f"layer string, fid bigint, type string, name string, geom {MULTI}, "
            "minx double, miny double, maxx double, maxy double"
        )

    def reader(self, schema) -> GeoPackageReader:
        return GeoPackageReader(self.options["path"], self.options["layer"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShapefileSource)
    spark.dataSource.register(GeoPackageSource)


def read_layer(spark: SparkSession, path: str, layer: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features of a layer, only those whose box meets `box` where one is given."""
    df = spark.read.format("gpkg").option("layer", layer).load(path)
    if box is None:
        return df
    return df.where(
        (F.col("maxx") >= box[0]) & (F.col("minx") <= box[2]) & (F.col("maxy") >= box[1]) & (F.col("miny") <= box[3])
    )


def read_admin_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """polygon_id, layer_rank, name, geom (grid metres) of the admin layers found under a folder."""
    found = {}
    for path in sorted(globlib.glob(f"{folder}/**/*.[sS][hH][pP]", recursive=True)):
        found.setdefault(os.path.basename(path).lower(), path)
    frames = [
        spark.read.format("shp").load(found[name]).select(
            F.struct(F.lit(rank).alias("rank"), "record").alias("polygon_id"), F.lit(rank).alias("layer_rank"),
            F.col("attributes")["name"].alias("name"), "geom",
        ).where(F.length(F.trim("name")) > 0)
        for rank, name in enumerate(ADMIN_LAYERS) if name in found
    ]
    if not frames:
        raise FileNotFoundError(f"no admin layers under {folder}")
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def _archive_roads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Roads of each zipped tile; tiles without a road layer give nothing."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            tile = os.path.basename(path).rsplit(".", 1)[0].rsplit("_", 1)[-1].upper()
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                base = next((n[:-4] for n in archive.namelist() if n.endswith("_Road.shp")), None)
                if base is None:
                    continue
                shp, shx, dbf = (io.BytesIO(archive.read(base + e)) for e in (".shp", ".shx", ".dbf"))
            n = _record_count(len(shx.getvalue()))
            for first in range(0, n, RECORDS_PER_SPLIT):
                rows = [
                    (tile, a.get("DISTNAME", ""), a.get("CLASSIFICA", ""),
                     [{"x": x, "y": y} for part in parts for x, y in part])
                    for _, a, _, parts in _records(shp, shx, dbf, first, min(n, first + RECORDS_PER_SPLIT))
                ]
                yield pd.DataFrame(rows, columns=["tile", "name", "cls", "points"])


def read_road_archives(spark: SparkSession, glob: str) -> DataFrame:
    """tile, name, cls, points of every zipped road tile; one archive is one tile of the country."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(_archive_roads, "tile string, name string, cls string, points array<struct<x:double,y:double>>")
