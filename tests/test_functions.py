import math

import pytest
from pyspark.sql import functions as F

from sitewise.functions import crs, fuzzy, geo, geometry, gridref
from sitewise.functions import text as tx


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0].asDict()


def test_projection_of_the_published_point(spark):
    df = spark.createDataFrame([(651409.903, 313177.270)], "easting double, northing double")
    row = crs.bng_to_osgb_radians(df, "easting", "northing", "la", "lo").select("la", "lo").collect()[0]
    assert math.degrees(row.la) == pytest.approx(52 + 39 / 60 + 27.2531 / 3600, abs=2e-8)
    assert math.degrees(row.lo) == pytest.approx(1 + 43 / 60 + 4.5177 / 3600, abs=2e-8)


def test_grid_round_trip(spark):
    points = [(float(e), float(n)) for e in range(60_000, 700_000, 80_000) for n in range(5_000, 1_200_000, 150_000)]
    df = spark.createDataFrame(points, "e double, n double")
    back = crs.wgs84_to_bng(crs.bng_to_wgs84(df, "e", "n"), "lat", "lon", "e2", "n2")
    worst = back.agg(F.max(F.hypot(F.col("e2") - F.col("e"), F.col("n2") - F.col("n"))).alias("d")).collect()[0].d
    # Millimetres, and only at the far western edge of the grid.
    assert worst < 0.002


def test_documented_grid_corners(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1234.0, 5678.0)], "easting double, northing double")
    rows = [(round(r.lat, 2), r.lon) for r in crs.bng_to_wgs84(df).collect()]
    assert rows[0][0] == 49.77 and rows[1][0] == 49.82
    assert all(-7.56 < lon < -7.54 for _, lon in rows)


def test_grid_references(spark):
    refs = ["TR 34 SE", "TR3559-60", "TR 206 48", "TG 210 080", "TG2108", "XX 12 34", "TR 20488", "nonsense"]
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    got = {r.ref: (r.easting, r.northing) for r in gridref.parse_grid_ref(df, "ref").collect()}
    assert got["TR 34 SE"] == (None, None)
    assert got["TR3559-60"] == (635500.0, 159500.0)
    assert got["TR 206 48"] == (620650.0, 148500.0)
    assert got["TG 210 080"] == (621050.0, 308050.0)
    assert got["TG2108"] == (621500.0, 308500.0)
    assert got["TR 20488"] == (620500.0, 148500.0)
    assert got["XX 12 34"] == got["nonsense"] == (None, None)


def test_grid_squares(spark):
    squares = {r.letters: (r.easting, r.northing) for r in gridref.grid_squares(spark).collect()}
    assert squares["SV"] == (0, 0) and squares["TQ"] == (500000, 100000) and len(squares) == 200


def test_postcodes_and_case_keys(spark):
    row = one(
        spark, p=tx.normalise_postcode(F.lit("al1 3je")), a=tx.postcode_area(F.lit("AL1 3JE")), s=tx.normalise_postcode(F.lit("b1")),
        r=tx.route_key(F.lit("CPA4(1a)")), q=tx.route_key(F.lit("12:00114:ART4_p4")), c=tx.page_case(F.lit("A108P_p4")),
    )
    assert row == {"p": "AL1 3JE", "a": "al", "s": "B1", "r": "CPA4_1a_", "q": "12_00114_ART4", "c": "A108P"}


@pytest.mark.parametrize("name,expected", [
    ("Royal Borough of Kensington and Chelsea", "kensington and chelsea"),
    ("X Metropolitan Borough Council", "x metropolitan"),
    ("South Norfolk District (B)", "south norfolk"),
    ("St. Albans City Council", "st albans"),
])
def test_admin_names(spark, name, expected):
    assert one(spark, n=tx.normalise_admin(F.lit(name)))["n"] == expected


def test_sigma_from_scale(spark):
    df = spark.createDataFrame([(1250,), (2500,), (10000,), (25000,), (100,), (None,)], "s int")
    assert [r[0] for r in df.select(geo.sigma_from_scale(F.col("s"))).collect()] == [227, 454, 1818, 4546, 150, 2500]


def test_fuzzy_scores():
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.5517, abs=1e-3)
    assert fuzzy.partial_ratio("this is a test", "this is a test!") == 100
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzzy.token_set_ratio("manour road", "manor road") >= 88
    assert fuzzy.weighted_ratio("manor", "manor road east") == pytest.approx(90.0)
    assert fuzzy.weighted_ratio("", "x") == 0
    for a, b in (("east langdon", "langdon east"), ("weybourne", "weyborne"), ("abc", "xyz")):
        assert fuzzy.weighted_ratio(a, b) == fuzzy.weighted_ratio(b, a)


def test_longest_common_subsequence_by_table():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert fuzzy._lcs(a, b) == plain(a, b)


def test_geojson_parsing(spark):
    quoted = '{"type":"Feature","geometry":"{\\"type\\":\\"Polygon\\",\\"coordinates\\":[[[0,0],[1,0],[1,1]]]}"}'
    df = spark.createDataFrame([(quoted,), ('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0]]]}}',)], "doc string")
    rows = [r.g for r in df.select(geometry.parse_geometry(F.col("doc")).alias("g")).collect()]
    assert [(p.x, p.y) for p in rows[0][0][0]] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert rows[1] is None
