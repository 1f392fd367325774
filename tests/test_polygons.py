import math
import random

import pytest
from pyspark.sql import functions as F

from sitewise.functions.geometry import MULTI, edges
from sitewise.operators import masks, overlay, union
from sitewise.operators.cells import points_in_polygons
from sitewise.operators.polygon import area, centroid, span_m


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def square(x, y, s=1.0):
    return ring([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])


def star(rng, n, cx, cy):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return ring([(cx + (0.3 + rng.random()) * math.cos(t), cy + (0.3 + rng.random()) * math.sin(t)) for t in turns])


def even_odd(geom, x, y):
    odd = False
    for poly in geom:
        for r in poly:
            for a, b in zip(r, r[1:]):
                if (a["y"] > y) != (b["y"] > y) and x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]):
                    odd = not odd
    return odd


def pairs_frame(spark, pairs):
    rows = [(k, a, b) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, f"k int, a {MULTI}, b {MULTI}")


def test_overlay_closed_forms(spark):
    holed = [[square(0, 0, 4), square(1, 1, 2)]]
    pairs = [
        ([[square(0, 0)]], [[square(0.5, 0)]]),
        (holed, [[square(1, 1, 2)]]),
        ([[square(0, 0)], [square(3, 0)]], [[square(0, 0, 4)]]),
        ([[square(0, 0)]], [[square(5, 5)]]),
        ([[ring([(0, 0), (2, 2), (2, 0), (0, 2)])]], [[square(0, 0, 2)]]),
    ]
    rows = {r.k: r for r in overlay.score_pairs(pairs_frame(spark, pairs), "k", "a", "b").collect()}
    assert rows[0].iou == pytest.approx(1 / 3) and rows[0].precision == rows[0].recall == pytest.approx(0.5)
    assert rows[1].iou == pytest.approx(0.0)
    assert rows[2].iou == pytest.approx(2 / 16) and rows[2].recall == pytest.approx(1.0)
    assert rows[3].iou == 0
    assert rows[4].repaired and rows[4].iou == pytest.approx(0.5)
    assert not rows[0].repaired


def test_overlay_of_large_polygons_matches_a_grid(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [([[star(rng, 150, 0, 0)]], [[star(rng, 170, 0.2, 0.1)]])]
    for strip in (8, 32, 10_000):
        monkeypatch.setattr(overlay, "STRIP_EDGES", strip)
        monkeypatch.setattr(overlay, "WHOLE", 2 * strip)
        row = overlay.overlay_areas(pairs_frame(spark, pairs), "k", "a", "b").collect()[0]
        n, hit = 240, [0, 0, 0, 0]
        for i in range(n):
            for j in range(n):
                x, y = -1.6 + 3.4 * (i + 0.5) / n, -1.6 + 3.4 * (j + 0.5) / n
                a, b = even_odd(pairs[0][0], x, y), even_odd(pairs[0][1], x, y)
                for k, v in enumerate((a, b, a and b, a or b)):
                    hit[k] += v
        cell = (3.4 / n) ** 2
        got = (row.area_a, row.area_b, row.area_both, row.area_any)
        assert got == pytest.approx([h * cell for h in hit], abs=0.02)
        assert row.area_any == pytest.approx(row.area_a + row.area_b - row.area_both)


def shape_pairs():
    """Pairs whose corners often share heights, sides and lines, with holes, parts and crossing rings."""
    def dense(points, k):
        out = []
        for (x, y), (u, v) in zip(points, [*points[1:], points[0]]):
            out += [(x + (u - x) * j / k, y + (v - y) * j / k) for j in range(k)]
        return ring(out)

    def box(x, y, w, h, k):
        return dense([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], k)

    frame = [[box(0, 0, 8, 8, 16), box(2, 2, 4, 4, 16)], [box(12, 0, 4, 2, 16)]]
    bow = [[dense([(0, 0), (8, 8), (8, 0), (0, 8)], 16)], [box(13, 0, 4, 2, 16)]]
    comb = [[ring([(k / 8, 10 * (k % 2)) for k in range(160)] + [(20, -1), (0, -1)])]]
    flat = [[ring([(p["y"], p["x"]) for p in comb[0][0][:-1]])]]
    return [(frame, bow), (comb, flat), (comb, [[box(3, 2, 5, 3, 3)]]), (frame, frame), (bow, comb)]


def test_overlay_in_cells_equals_overlay_as_a_whole(spark, monkeypatch):
    pairs = shape_pairs()
    frame = pairs_frame(spark, pairs)
    results = []
    for strip in (2, 5, 16, 10_000):
        monkeypatch.setattr(overlay, "STRIP_EDGES", strip)
        monkeypatch.setattr(overlay, "WHOLE", 2 * strip)
        rows = sorted(overlay.overlay_areas(frame, "k", "a", "b").collect())
        results.append([v for r in rows for v in r])
    assert results[-1][1:5] == pytest.approx([64 - 16 + 8, 32 + 8, 24 + 6, 56 + 40 - 30])
    for other in results[:-1]:
        assert other == pytest.approx(results[-1], abs=1e-9)


@pytest.mark.parametrize("turned", [False, True])
def test_cells_of_a_coastline_are_small(spark, turned):
    """An upright coastline of 20,000 corners, which strips alone leave to one task, and a level one."""
    rng = random.Random(3)
    coast, x = [], 0.0
    for k in range(20_000):
        x = min(1.0, max(-1.0, x + rng.uniform(-0.05, 0.05)))
        coast.append((x, k / 100))
    points = [*coast, (30.0, 199.99), (30.0, 0.0)]
    land = [[ring([(y, x) for x, y in points] if turned else points)]]
    frame = pairs_frame(spark, [(land, [[square(-5, -5, 300)]])])
    cells = overlay.cell_pieces(frame, "k", "a", "b").groupBy("k", "strip", "row").count()
    most = cells.agg(F.max("count")).collect()[0][0]
    assert most < 8 * overlay.STRIP_EDGES
    row = overlay.overlay_areas(frame, "k", "a", "b").collect()[0]
    size = abs(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(land[0][0], land[0][0][1:]))) / 2
    assert row.area_a == pytest.approx(size) and row.area_both == pytest.approx(size)
    assert row.area_any == pytest.approx(90_000)


def test_centroid_with_hole_and_parts(spark):
    geom = [[square(0, 0, 4), square(2, 0.5, 1)], [square(10, 0, 2)]]
    row = spark.createDataFrame([(geom,)], f"g {MULTI}").select(centroid(F.col("g")).alias("c"), area(F.col("g")).alias("a")).collect()[0]
    assert row.a == pytest.approx(16 - 1 + 4)
    assert row.c.x == pytest.approx((16 * 2 - 2.5 + 4 * 11) / 19) and row.c.y == pytest.approx((16 * 2 - 1.0 + 4 * 1) / 19)


def test_span_uses_the_hull(spark):
    geom = [[ring([(0, 52), (0.01, 52), (0.005, 52.001), (0.004, 52.0005)])]]
    row = span_m(spark.createDataFrame([(geom,)], f"geom {MULTI}")).collect()[0]
    assert row.span_m == pytest.approx(6371000 * 2 * math.asin(math.cos(math.radians(52)) * math.sin(math.radians(0.005))), rel=1e-6)


def test_points_in_polygon_match_brute_force(spark):
    rng = random.Random(3)
    shapes = [(k, [[star(rng, 40, 2 * k, k)]]) for k in range(4)]
    points = [(p, rng.uniform(-2, 8), rng.uniform(-2, 5)) for p in range(500)]
    got = points_in_polygons(
        spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(shapes, f"k int, geom {MULTI}"), "p", "k", 0.7
    )
    assert {(r.p, r.k) for r in got.collect()} == {(p, k) for p, x, y in points for k, g in shapes if even_odd(g, x, y)}


def test_union_of_touching_nested_and_single(spark):
    rows = [
        (1, 0, [[square(0, 0, 2)]]), (1, 1, [[square(1, 1, 2)]]),
        (2, 0, [[square(0, 0)]]), (2, 1, [[square(1, 0)]]),
        (3, 0, [[square(0, 0, 5)]]), (3, 1, [[square(1, 1)]]),
        (4, 0, [[square(0, 0)]]),
        (5, 0, [[ring([(0, 0), (4, 0), (4, 1), (0, 1)])]]), (5, 1, [[ring([(0, 3), (4, 3), (4, 4), (0, 4)])]]),
        (5, 2, [[ring([(0, 0), (1, 0), (1, 4), (0, 4)])]]), (5, 3, [[ring([(3, 0), (4, 0), (4, 4), (3, 4)])]]),
        (6, 0, None),
    ]
    parts = spark.createDataFrame(rows, f"k int, g int, geom {MULTI}")
    got = {r.k: r for r in union.union_geometries(parts, "k", "g").withColumn("a", area(F.col("geom"))).collect()}
    assert {k: round(r.a, 6) for k, r in got.items()} == {1: 7.0, 2: 2.0, 3: 25.0, 4: 1.0, 5: 12.0}
    assert len(got[2].geom) == 1 and len(got[2].geom[0][0]) == 5
    assert len(got[5].geom) == 1 and len(got[5].geom[0]) == 2


def test_fill_and_trace(spark):
    shape = spark.createDataFrame([(1, [[ring([(2, 3), (12, 3), (12, 9), (2, 9)])]])], f"mask_id int, geom {MULTI}")
    runs = masks.fill_polygons(edges(shape, ["mask_id"]), ["mask_id"])
    assert {(r.row_no, r.x_start, r.x_end) for r in runs.collect()} == {(y, 2, 12) for y in range(3, 9)}
    outline = masks.trace_outlines(runs).collect()
    assert {(p.x, p.y) for p in outline[0].ring} == {(2, 3), (11, 3), (11, 8), (2, 8)}


def test_trace_leaves_out_what_lies_in_a_hole(spark):
    frame = [(1, y, 0, 10) for y in (0, 9)] + [(1, y, s, e) for y in range(1, 9) for s, e in ((0, 1), (9, 10))]
    inner = [(1, y, 4, 6) for y in (4, 5)]
    apart = [(1, y, 20, 23) for y in (2, 3, 4)]
    df = spark.createDataFrame(frame + inner + apart, "mask_id int, row_no int, x_start int, x_end int")
    corners = [{(p.x, p.y) for p in r.ring} for r in masks.trace_outlines(df).collect()]
    assert {(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)} in corners and {(20.0, 2.0), (22.0, 2.0), (22.0, 4.0), (20.0, 4.0)} in corners
    assert len(corners) == 2


def test_fill_outline_gates(spark):
    def frame(mask, size):
        edge = [(mask, 60, 60, 10, 10, 10 + size), (mask, 60, 60, 9 + size, 10, 10 + size)]
        return edge + [(mask, 60, 60, y, s, s + 1) for y in range(11, 9 + size) for s in (10, 9 + size)]

    broken = [r for r in frame(2, 30) if not (r[3] in (20, 21, 22) and r[4] == 10)]
    solid = [(3, 60, 60, y, 0, 50) for y in range(60)]
    df = spark.createDataFrame(frame(1, 30) + broken + solid, "mask_id int, height int, width int, row_no int, x_start int, x_end int")
    sizes = {r.mask_id: r.n for r in masks.fill_outlines(df).groupBy("mask_id").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("n")).collect()}
    assert sizes[1] == 900 and sizes[2] == 900 and sizes[3] == 3000
