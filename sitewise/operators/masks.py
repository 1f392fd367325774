"""Masks as run-length rows: overlap, scan fill, outline tracing and outline filling.

A run is (mask_id, row_no, x_start, x_end), x_end exclusive. Counting works on rows of runs and
never on whole masks. Tracing and filling look at one mask at a time, which is one page image and
so has a fixed number of pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from sitewise.functions import geo
from sitewise.functions.geometry import point

# Share of filled pixels within which a mask is taken for an outline, and the gates
# of an accepted fill.
OUTLINE_SHARE = (0.001, 0.4)
FILL_GROWTH, FILL_MAX = 1.2, 0.85
# Half widths of a 7 x 7 elliptic closing kernel, row by row.
ELLIPSE_HALF_WIDTHS = (0, 2, 3, 3, 3, 2, 0)
CLOSE_ROUNDS = 2


def merge_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the runs of each key: overlapping and touching runs become one.

    One row per start is kept before the window, so a row of a mask never holds more than its width.
    """
    by = list(keys)
    starts = runs.where("x_end > x_start").groupBy(*by, "x_start").agg(F.max("x_end").alias("x_end"))
    order = Window.partitionBy(*by).orderBy("x_start")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = starts.withColumns({
        "_before": F.max("x_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_last": F.max("x_end").over(whole),
    })
    # A merged run ends where the runs before the next one reach; one sort serves both windows.
    opening = marked.where("_before IS NULL OR x_start > _before")
    end = F.coalesce(F.lead("_before").over(order), "_last")
    return opening.select(*by, "x_start", end.alias("x_end"))


def mask_confusion(runs: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """mask_id, tp, n_pred, n_gt, iou, precision, recall, f1, dice; `runs` has which in ('pred', 'gt').

    `shapes` has mask_id, which, height, width: where the two masks' shapes differ, or one is not known,
    their pixels can't be compared, so tp and all scores are NULL.

    One sweep along each pixel row: starts and ends are summed per position first, so a row never
    holds more than its width, and no run is paired with another.
    """
    by = ["mask_id", "row_no"]
    ends = F.explode(F.array(F.struct(F.col("x_start").alias("x"), F.lit(1).alias("d")),
                             F.struct(F.col("x_end").alias("x"), F.lit(-1).alias("d")))).alias("_e")
    steps = runs.where("x_end > x_start").select(*by, "which", ends).select(*by, "which", "_e.*")
    turns = steps.groupBy(*by, "x").agg(
        F.sum(F.when(F.col("which") == "pred", F.col("d")).otherwise(0)).alias("dp"),
        F.sum(F.when(F.col("which") == "gt", F.col("d")).otherwise(0)).alias("dg"),
    )
    order = Window.partitionBy(*by).orderBy("x")
    swept = turns.select(
        "mask_id", (F.sum("dp").over(order) > 0).alias("p"), (F.sum("dg").over(order) > 0).alias("g"),
        (F.lead("x").over(order) - F.col("x")).alias("size"),
    )

    def pixels(inside: Column) -> Column:
        return F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).cast("bigint")

    sums = swept.groupBy("mask_id").agg(
        pixels(F.col("p") & F.col("g")).alias("tp"), pixels(F.col("p")).alias("n_pred"), pixels(F.col("g")).alias("n_gt")
    )
    scored = sums.select("mask_id", "tp", "n_pred", "n_gt", *confusion_scores("tp", "n_pred", "n_gt"))
    if shapes is None:
        return scored
    size = F.struct("height", "width")
    both = shapes.where("height IS NOT NULL AND width IS NOT NULL").groupBy("mask_id").agg(
        (F.count_distinct("which") == 2).alias("_both"), (F.min(size) == F.max(size)).alias("_same")
    )
    scored = scored.join(both, "mask_id", "left").withColumn("_fit", F.coalesce(F.col("_both") & F.col("_same"), F.lit(False)))
    return scored.select("mask_id", *[
        F.col(c) if c in ("n_pred", "n_gt") else F.when(F.col("_fit"), F.col(c)).alias(c) for c in scored.columns if c[0] != "_" and c != "mask_id"
    ])


def confusion_scores(tp: str, n_pred: str, n_gt: str) -> list[Column]:
    """IoU, precision, recall, F1 and Dice from one triple; 0 where a denominator is 0."""

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    t, p, g = F.col(tp).cast("double"), F.col(n_pred), F.col(n_gt)
    precision, recall = share(t, p), share(t, g)
    return [
        share(t, p + g - t).alias("iou"), precision.alias("precision"), recall.alias("recall"),
        share(2 * precision * recall, precision + recall).alias("f1"), share(2 * t, p + g).alias("dice"),
    ]


def fill_polygons(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, row_no, x_start, x_end of the pixels whose centre lies inside (even-odd).

    `edges` has keys and x0..y1 in pixels, at most one polygon per key.
    """
    by = list(keys)
    top, bottom = F.least("y0", "y1"), F.greatest("y0", "y1")
    # Rows whose centre line lies in [top, bottom).
    first, last = F.ceil(top - 0.5).cast("int"), (F.ceil(bottom - 0.5) - 1).cast("int")
    rows = edges.withColumns({"_a": first, "_b": last}).where("_a <= _b AND y0 <> y1")
    rows = rows.withColumn("row_no", F.explode(F.sequence("_a", "_b")))
    at = F.col("x0") + (F.col("row_no") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(
        F.col("y1") - F.col("y0"), F.lit(0.0)
    )
    order = Window.partitionBy(*by, "row_no").orderBy("x")
    crossed = rows.select(*by, "row_no", at.alias("x"))
    paired = crossed.withColumns({"_rn": F.row_number().over(order), "_next": F.lead("x").over(order)})
    spans = paired.where("_rn % 2 = 1 AND _next IS NOT NULL").select(
        *by, "row_no", F.ceil(F.col("x") - 0.5).cast("int").alias("x_start"),
        (F.floor(F.col("_next") - 0.5) + 1).cast("int").alias("x_end"),
    )
    return spans.where("x_end > x_start")


def _components(rows: list[list[tuple[int, int]]], reach: int) -> list[list[int]]:
    """Component label per run; runs of neighbouring rows join if they come within `reach`."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids: list[list[int]] = []
    for y, spans in enumerate(rows):
        ids.append([])
        for start, end in spans:
            me = len(parent)
            parent.append(me)
            ids[y].append(me)
            if y:
                for (s, e), other in zip(rows[y - 1], ids[y - 1]):
                    if s < end + reach and start < e + reach:
                        parent[root(me)] = root(other)
    return [[root(i) for i in row] for row in ids]


def _row_spans(line: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True in one pixel row."""
    steps = np.flatnonzero(np.diff(np.concatenate(([0], line.astype(np.int8), [0]))))
    return list(zip(steps[::2].tolist(), steps[1::2].tolist()))


def _outside(solid: np.ndarray, everywhere: bool) -> np.ndarray:
    """Background reached from the whole border, or from the four corners only (4-connected)."""
    rows = [_row_spans(~line) for line in solid]
    labels = _components(rows, 0)
    h, w = solid.shape
    reached: set[int] = set()
    for y in range(h):
        for (s, e), label in zip(rows[y], labels[y]):
            edge_row = y in (0, h - 1)
            if everywhere and (edge_row or s == 0 or e == w):
                reached.add(label)
            elif not everywhere and edge_row and (s == 0 or e == w):
                reached.add(label)
    out = np.zeros_like(solid)
    for y in range(h):
        for (s, e), label in zip(rows[y], labels[y]):
            if label in reached:
                out[y, s:e] = True
    return out


def _raster(ys, starts, ends, height: int, width: int, pad: int = 0) -> np.ndarray:
    grid = np.zeros((height + 2 * pad, width + 2 * pad), dtype=bool)
    for y, s, e in zip(ys, starts, ends):
        grid[y + pad, s + pad : e + pad] = True
    return grid


def _gathered(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per mask with its merged runs as three arrays: at most one page image each.

    Runs are few bytes and the work on them is not: callers spread masks before their runs are made, and
    every stage here keeps that.
    """
    merged = merge_runs(runs, [*keys, "row_no"])
    return merged.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in ("row_no", "x_start", "x_end")])


# The eight neighbours (dx, dy), clockwise on a page with y pointing down.
_AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def _follow(grid: Sequence[Sequence[int]], x: int, y: int) -> list[tuple[int, int]]:
    """Outer border of the component whose topmost, leftmost pixel is (x, y)."""
    path, here, facing = [(x, y)], (x, y), 0
    first_step = None
    while True:
        for turn in range(8):
            d = (facing + 5 + turn) % 8
            nx, ny = here[0] + _AROUND[d][0], here[1] + _AROUND[d][1]
            if grid[ny][nx]:
                break
        else:
            return path
        if first_step is None:
            first_step = d
        elif here == (x, y) and d == first_step:
            return path[:-1]
        here, facing = (nx, ny), d
        path.append(here)


def _corners(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Drop points inside straight horizontal, vertical and diagonal runs."""
    n = len(path)
    if n < 3:
        return path
    keep = []
    for i, p in enumerate(path):
        a, b = path[i - 1], path[(i + 1) % n]
        if (p[0] - a[0], p[1] - a[1]) != (b[0] - p[0], b[1] - p[1]):
            keep.append(p)
    return keep


def _outlines(ys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int]]]:
    """Outlines of the outermost 8-connected components of one mask, given as merged runs."""
    top, left = int(ys.min()), int(starts.min())
    height, width = int(ys.max()) - top + 1, int(ends.max()) - left
    rows: list[list[tuple[int, int]]] = [[] for _ in range(height + 2)]
    grid = [bytearray(width + 2) for _ in rows]
    for y, s, e in sorted(zip((ys - top + 1).tolist(), (starts - left + 1).tolist(), (ends - left + 1).tolist())):
        rows[y].append((s, e))
        grid[y][s:e] = b"\x01" * (e - s)
    labels = _components(rows, 1)
    start: dict[int, tuple[int, int]] = {}
    for y, spans in enumerate(rows):
        for (s, _), label in zip(spans, labels[y]):
            start.setdefault(label, (s, y))
    if len(start) > 1:
        start = _open_to_page(rows, labels, start, _raster(ys - top, starts - left, ends - left, height, width, pad=1))
    return [
        [(px - 1 + left, py - 1 + top) for px, py in _corners(_follow(grid, x, y))] for x, y in start.values()
    ]


def _open_to_page(rows, labels, start: dict[int, tuple[int, int]], grid: np.ndarray) -> dict[int, tuple[int, int]]:
    """Of several components, those that the background around the page touches; a single one always is."""
    outside = _outside(grid, True)
    found: set[int] = set()
    for y, spans in enumerate(rows):
        for (s, e), label in zip(spans, labels[y]):
            if outside[y - 1, s:e].any() or outside[y + 1, s:e].any() or outside[y, s - 1] or outside[y, e]:
                found.add(label)
    return {label: at for label, at in start.items() if label in found}


@F.pandas_udf(ArrayType(ArrayType(ArrayType(DoubleType()))))
def _outline_udf(ys: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series(
        [[[[float(x), float(y)] for x, y in ring] for ring in _outlines(np.asarray(a), np.asarray(b), np.asarray(c))]
         for a, b, c in zip(ys, starts, ends)]
    )


def trace_outlines(runs: DataFrame) -> DataFrame:
    """mask_id, ring_no, ring (array of pixel points) of every outline with four corners or more."""
    traced = _gathered(runs, ["mask_id"]).select("mask_id", _outline_udf("row_no", "x_start", "x_end").alias("_r"))
    rings = traced.select("mask_id", F.posexplode("_r").alias("ring_no", "_p")).where(F.size("_p") >= 4)
    return rings.select(
        "mask_id", "ring_no", F.transform("_p", lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))).alias("ring")
    )


def project_outlines(rings: DataFrame, affines: DataFrame) -> DataFrame:
    """mask_id, geom in degrees: rings through the affine to tile pixels and on to lon/lat.

    `affines` has mask_id, a00..a12, zoom, tx_min, ty_min.
    """
    joined = rings.join(affines.hint("merge"), "mask_id")
    a = [F.col(c) for c in ("a00", "a01", "a02", "a10", "a11", "a12")]

    def project(p: Column) -> Column:
        x, y = geo.affine_apply(a, p["x"], p["y"])
        return point(geo.pixel_lon(x, F.col("zoom"), F.col("tx_min")), geo.pixel_lat(y, F.col("zoom"), F.col("ty_min")))

    closed = F.concat("ring", F.slice("ring", 1, 1))
    placed = joined.select("mask_id", "ring_no", F.array(F.transform(closed, project)).alias("poly"))
    parts = placed.groupBy("mask_id").agg(F.array_sort(F.collect_list(F.struct("ring_no", "poly"))).alias("_p"))
    return parts.select("mask_id", F.transform("_p", lambda p: p["poly"]).alias("geom"))


def _shifted_any(grid: np.ndarray, any_of: bool) -> np.ndarray:
    """One dilation (any) or erosion (all) with the elliptic kernel; the page edge is ignored."""
    h, w = grid.shape
    r = len(ELLIPSE_HALF_WIDTHS) // 2
    padded = np.full((h + 2 * r, w + 2 * r), not any_of)
    padded[r : r + h, r : r + w] = grid
    out = np.full((h, w), not any_of)
    for dy, half in enumerate(ELLIPSE_HALF_WIDTHS):
        for dx in range(r - half, r + half + 1):
            part = padded[dy : dy + h, dx : dx + w]
            out = (out | part) if any_of else (out & part)
    return out


def _filled(grid: np.ndarray) -> np.ndarray:
    total = grid.size
    share = grid.sum() / total
    if not OUTLINE_SHARE[0] <= share <= OUTLINE_SHARE[1]:
        return grid
    closed = grid
    for any_of in (True, False):
        for _ in range(CLOSE_ROUNDS):
            closed = _shifted_any(closed, any_of)
    filled = ~_outside(closed, False)
    after = filled.sum() / total
    return filled if share * FILL_GROWTH < after < FILL_MAX else grid


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _fill_udf(ys: pd.Series, starts: pd.Series, ends: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    def runs(a, b, c, h, w) -> list[list[int]]:
        grid = _filled(_raster(a, b, c, h, w))
        return [[y, s, e] for y in range(h) for s, e in _row_spans(grid[y])]

    return pd.Series([runs(*row) for row in zip(ys, starts, ends, height, width)])


def fill_outlines(runs: DataFrame) -> DataFrame:
    """Runs of each mask with its outline filled, or the mask as it was where the gates refuse.

    `runs` has mask_id, height, width and the run columns.
    """
    filled = _gathered(runs, ["mask_id", "height", "width"]).select(
        "mask_id", F.explode(_fill_udf("row_no", "x_start", "x_end", "height", "width")).alias("_r")
    )
    return filled.select("mask_id", *[F.col("_r")[k].alias(c) for k, c in enumerate(("row_no", "x_start", "x_end"))])
