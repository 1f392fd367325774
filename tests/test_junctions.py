"""Junctions of polylines: crossings, shared stretches, roads that are absent or out of the box, and the limit."""

import pytest
from pyspark.sql import functions as F

from sitewise.operators import roads

BASE = 400_000.0  # the lines lie near the middle of the grid


def lines(spark, rows):
    out = []
    for i, (name, *points) in enumerate(rows):
        xs, ys = [BASE + x for x, _ in points], [BASE + y for _, y in points]
        out.append((i, name, min(xs), min(ys), max(xs), max(ys), [{"x": x, "y": y} for x, y in zip(xs, ys, strict=True)]))
    schema = "road_id long, name_lc string, minx double, miny double, maxx double, maxy double, points array<struct<x:double,y:double>>"
    return spark.createDataFrame(out, schema)


def asked(spark, *rows):
    box = lambda b: [None] * 4 if b is None else [BASE + v for v in b]
    return spark.createDataFrame([(i, list(n), *box(b)) for i, (n, b) in enumerate(rows)], "request_id int, names array<string>, minx double, miny double, maxx double, maxy double")


ROADS = [
    ("high street", (0, 0), (100, 0), (200, 0), (300, 50)),
    ("mill lane", (50, -50), (50, 50), (250, 60), (250, -60)),  # crosses high street at (50, 0) and (250, 25)
    ("old road", (20, 0), (80, 0), (120, 0), (120, 90)),  # shares 20..120 with high street
    ("loop", (10, 10), (10, 0), (30, 0), (30, 10), (60, 10), (60, 0), (90, 0), (90, -40)),  # two stretches, 10..30 and 60..90
    ("bend", (150, -30), (150, 30), (180, 30), (180, 0), (200, 0)),  # crosses at (150, 0) and shares 180..200
    ("far lane", (9000, 9000), (9100, 9000)),
    ("stub", (5, 5)),
]


@pytest.fixture(scope="module")
def got(spark):
    requests = asked(
        spark, (("High Street", "Mill Lane"), None), (("High Street", "Old"), None), (("High Street", "Loop"), None), (("High Street", "Bend"), None),
        (("High Street", "Mill Lane", "Nowhere"), None), (("High Street", "Mill Lane", "Far Lane"), (0, -100, 500, 100)), (("High Street", "Stub"), None),
        (("Mill Lane", "High Street", "Old Road"), (0, -100, 500, 100)),
    )
    table = lines(spark, ROADS)
    found = {}
    for r in roads.junctions(requests, table, 40.0).orderBy("request_id", "hit").collect():
        found.setdefault(r.request_id, []).append((round(r.x - BASE, 3), round(r.y - BASE, 3)))
    missing = sorted((r.request_id, r.asked) for r in roads.missing_roads(requests, table).collect())
    return found, missing, requests, table


def test_points_of_polylines(got):
    found = got[0]
    assert found[0] == [(50, 0), (250, 25)]
    assert found[1] == [(70, 0)]  # the middle of 20..120, in one
    assert found[2] == [pytest.approx(((20 * 20 + 75 * 30) / 50, 0), abs=1e-3)]  # both stretches by length
    assert found[3] == [(150, 0), (190, 0)]  # beside a crossing each stretch has its own
    assert found[7] == [(50, 0), (250, 25), (120, 53.5), (70, 0)]  # (50, 0) is kept once


def test_a_missing_road_fails_its_request(got):
    found, missing, _, _ = got
    assert missing == [(4, "Nowhere"), (5, "Far Lane"), (6, "Stub")]
    assert not {4, 5, 6} & set(found)


def test_limit_and_degrees(got):
    _, _, requests, table = got
    rows = roads.junctions(requests, table, 40.0, limit=1).collect()
    assert sorted((r.request_id, r.hit, r.n_intersections) for r in rows) == [(0, 1, 2), (1, 1, 1), (2, 1, 1), (3, 1, 2), (7, 1, 4)]
    assert all(53.4 < r.lat < 53.6 and -2.1 < r.lon < -1.9 for r in rows)
    assert roads.junctions(requests.where(F.lit(False)), table).count() == 0


def test_looked_up_roads_have_degrees(spark):
    table = lines(spark, ROADS[:2]).withColumns({"cx": F.col("minx"), "cy": F.col("miny"), "area_id": F.lit(1)})
    asked_for = spark.createDataFrame([(1, "High Street", None), (2, "mill lane", 1), (3, "mill lane", 2)], "query_id int, query string, area_id int")
    got = {r.query_id: r for r in roads.lookup_roads(asked_for, table).collect()}
    assert set(got) == {1, 2} and all(53.4 < r.lat < 53.6 and -2.1 < r.lon < -1.9 for r in got.values())
