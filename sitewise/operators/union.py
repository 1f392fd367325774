"""Union of polygons: boundary pieces come from the slabs, rings are chained per result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sitewise.functions.geometry import point
from sitewise.operators.overlay import layer_edges, slab_edges

SNAP = 9  # decimals at which two computed crossing heights are the same point


def _boundary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of the union's outline along its edges: keys, xl, xr, yl, yr, lower (covered above it)."""
    pieces = slab_edges(rows, keys).withColumn("ym", (F.col("yl") + F.col("yr")) / 2)
    slab = [*keys, "strip", "xl"]
    own = F.row_number().over(Window.partitionBy(*slab, "g").orderBy("ym", "eid"))
    pieces = pieces.withColumn("_step", F.when(own % 2 == 1, 1).otherwise(-1))
    upto = Window.partitionBy(*slab).orderBy("ym", F.desc("_step"), "g", "eid").rowsBetween(
        Window.unboundedPreceding, 0
    )
    pieces = pieces.withColumn("_cover", F.sum("_step").over(upto))
    bottom = (F.col("_step") == 1) & (F.col("_cover") == 1)
    top = (F.col("_step") == -1) & (F.col("_cover") == 0)
    return pieces.where(bottom | top).select(
        *keys, "xl", "xr", F.round("yl", SNAP).alias("yl"), F.round("yr", SNAP).alias("yr"), bottom.alias("lower")
    )


def closed_pieces(xl, xr, yl, yr, lower) -> list[tuple[float, float, float, float]]:
    """Directed pieces ax, ay, bx, by of one outline, interior on the left, upright ones added."""
    pieces, net = [], {}
    for x0, x1, y0, y1, low in zip(xl, xr, yl, yr, lower):
        pieces.append((x0, y0, x1, y1) if low else (x1, y1, x0, y0))
        d = 1 if low else -1
        left, right = net.setdefault(x0, {}), net.setdefault(x1, {})
        left[y0] = left.get(y0, 0) - d
        right[y1] = right.get(y1, 0) + d
    # At a breakpoint the covered intervals left and right of it may differ: where only the left
    # side is covered the outline runs up, where only the right side is covered it runs down.
    for x, steps in net.items():
        level, heights = 0, sorted(steps)
        for y, above in zip(heights, heights[1:]):
            level += steps[y]
            if level:
                pieces.append((x, y, x, above) if level > 0 else (x, above, x, y))
    return pieces


def _area2(ring: list[tuple[float, float]]) -> float:
    x, y = ring[0]
    return sum((a[0] - x) * (b[1] - y) - (b[0] - x) * (a[1] - y) for a, b in zip(ring, ring[1:]))


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
            odd = not odd
    return odd


def _straighten(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Drop points in the middle of straight stretches of a closed ring."""
    points = ring[:-1]
    keep = []
    for i, p in enumerate(points):
        a, b = points[i - 1], points[(i + 1) % len(points)]
        ux, uy, vx, vy = p[0] - a[0], p[1] - a[1], b[0] - p[0], b[1] - p[1]
        if abs(ux * vy - uy * vx) > 1e-9 * (abs(ux) + abs(uy)) * (abs(vx) + abs(vy)):
            keep.append(p)
    return [*keep, keep[0]] if len(keep) >= 3 else []


def _turn(back: tuple[float, float], ahead: tuple[float, float]) -> float:
    """Angle from the reversed incoming direction to the outgoing one, clockwise, in (0, 2 pi]."""
    import math

    angle = math.atan2(back[1], back[0]) - math.atan2(ahead[1], ahead[0])
    angle %= 2 * math.pi
    return angle if angle > 1e-12 else 2 * math.pi


def chain_rings(pieces: list[tuple[float, float, float, float]]) -> list[list[list[tuple[float, float]]]]:
    """Polygons (outline first, then holes) from directed pieces with the interior on the left."""
    leaving: dict[tuple[float, float], list[int]] = {}
    for i, (ax, ay, _, _) in enumerate(pieces):
        leaving.setdefault((ax, ay), []).append(i)
    used = [False] * len(pieces)
    rings = []
    for start in range(len(pieces)):
        if used[start]:
            continue
        ring, i = [pieces[start][:2]], start
        while True:
            used[i] = True
            ax, ay, bx, by = pieces[i]
            ring.append((bx, by))
            if (bx, by) == ring[0]:
                break
            options = [j for j in leaving.get((bx, by), ()) if not used[j]]
            if not options:
                break
            # At a touching point the sharpest left turn keeps the parts apart.
            back = (ax - bx, ay - by)
            i = min(options, key=lambda j: _turn(back, (pieces[j][2] - bx, pieces[j][3] - by)))
        clean = _straighten(ring) if ring[0] == ring[-1] else []
        if clean:
            rings.append(clean)
    outer = [r for r in rings if _area2(r) > 0]
    polygons = [[r] for r in outer]
    for hole in (r for r in rings if _area2(r) < 0):
        middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        holders = [p for p in polygons if _inside(middle, p[0])]
        if holders:
            min(holders, key=lambda p: _area2(p[0])).append(hole)
    return polygons


@F.pandas_udf(ArrayType(ArrayType(ArrayType(ArrayType(DoubleType())))))
def _chain_udf(xl: pd.Series, xr: pd.Series, yl: pd.Series, yr: pd.Series, lower: pd.Series) -> pd.Series:
    return pd.Series(
        [[[[list(p) for p in ring] for ring in poly] for poly in chain_rings(closed_pieces(*(c.tolist() for c in row)))]
         for row in zip(xl, xr, yl, yr, lower)]
    )


def union_geometries(parts: DataFrame, key: str, part_id: str, geom: str = "geom") -> DataFrame:
    """key, geom: union of the geometries of a key. A single geometry is passed through as it is.

    Crossing and covering run as joins and windows over strips; only the finished outline of one
    result, which has to be one value anyway, is chained in a task.
    """
    parts = parts.where(F.col(geom).isNotNull() & (F.size(geom) > 0))
    flat = F.flatten(F.flatten(F.col(geom)))
    xs = F.transform(flat, lambda p: p["x"])
    extent = parts.groupBy(key).agg(
        F.count("*").alias("_k"), F.sum(F.size(flat)).alias("_n"), F.min(F.array_min(xs)).alias("_min"),
        F.max(F.array_max(xs)).alias("_max"),
    )
    # Merged by hint: the planner takes exploded corners for few bytes and would send whole tables to the driver.
    sized = parts.join(extent.hint("merge"), key)
    single = sized.where("_k = 1").select(key, F.col(geom).alias("geom"))
    many = sized.where("_k > 1").withColumn("g", F.col(part_id))
    outline = _boundary(layer_edges(many.select(key, "g", "_n", "_min", "_max", geom), [key], "g", geom), [key])
    # Small outlines, costly chaining: spread over all shuffle partitions.
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = outline.groupBy(key).agg(*[F.collect_list(c).alias(c) for c in ("xl", "xr", "yl", "yr", "lower")]).repartition(n)
    chained = whole.select(key, _chain_udf("xl", "xr", "yl", "yr", "lower").alias("_g"))
    merged = chained.select(
        key,
        F.transform("_g", lambda poly: F.transform(poly, lambda ring: F.transform(
            ring, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))).alias("geom"),
    )
    return single.unionByName(merged)
