"""Roads: lookups by name, junctions of named roads, and the roads around a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import crs, geo
from sitewise.functions import text as tx
from sitewise.functions.fuzzy import token_set_ratio_udf
from sitewise.operators.cells import with_box_cells
from sitewise.operators.geocode import first_per_key

NEARBY_M = 1500.0
ROAD_CUTOFF = 88.0


def name_keys(query: Column) -> Column:
    """A road is looked up under its name and under its name plus ' road'."""
    name = tx.strip(F.lower(query))
    return F.array(name, F.concat(name, F.lit(" road")))


def lookup_roads(requests: DataFrame, roads: DataFrame, k: int = 5) -> DataFrame:
    """query_id, hit, road_id, cx, cy, lat, lon: the first k roads of a name, plain name first.

    `requests` has query_id, query and area_id (NULL = anywhere); `roads` has road_id, name_lc, cx,
    cy and area_id of the area its centre lies in. Only the first k roads per name and area can be
    asked for, so they are cut before any request is joined.
    """
    spots = roads.select("road_id", "name_lc", "cx", "cy", "area_id")
    top_area = first_per_key(spots.where("area_id IS NOT NULL"), ["name_lc", "area_id"], ["road_id"], k)
    once = spots.groupBy("name_lc", "road_id").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    top_any = first_per_key(once, ["name_lc"], ["road_id"], k).withColumn("area_id", F.lit(None).cast("bigint"))
    top = top_area.drop("rn").unionByName(top_any.drop("rn").select("road_id", "name_lc", "cx", "cy", "area_id"))
    asked = requests.select("query", F.col("area_id").cast("bigint").alias("_area")).distinct()
    asked = asked.select("query", "_area", F.posexplode(name_keys(F.col("query"))).alias("pos", "name_lc"))
    t = top.withColumn("area_id", F.col("area_id").cast("bigint")).withColumnRenamed("name_lc", "_n")
    found = asked.join(t, (F.col("name_lc") == F.col("_n")) & F.col("_area").eqNullSafe(F.col("area_id")))
    found = found.select("query", "_area", "pos", "road_id", "cx", "cy")
    best = first_per_key(found, ["query", "_area"], ["pos", "road_id"], k)
    r = requests.select("query_id", F.col("query").alias("_q"), F.col("area_id").cast("bigint").alias("_a"))
    joined = r.join(best, (F.col("_q") == F.col("query")) & F.col("_a").eqNullSafe(F.col("_area")))
    hits = joined.select("query_id", F.col("rn").alias("hit"), "road_id", "cx", "cy")
    placed = crs.bng_to_wgs84(hits, "cx", "cy", "lat", "lon")
    return placed.select(*hits.columns, F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def segments(roads: DataFrame, points: str = "points") -> DataFrame:
    """road columns plus pos, x0, y0, x1, y1 for every piece of a line."""
    keep = [c for c in roads.columns if c != points]
    sides = F.arrays_zip(
        F.slice(points, F.lit(1), F.size(points) - 1).alias("a"),
        F.slice(points, F.lit(2), F.size(points) - 1).alias("b"),
    )
    rows = roads.where(F.size(points) >= 2).select(*keep, F.posexplode(sides).alias("pos", "_s"))
    return rows.select(
        *keep, "pos", F.col("_s.a.x").alias("x0"), F.col("_s.a.y").alias("y0"),
        F.col("_s.b.x").alias("x1"), F.col("_s.b.y").alias("y1"),
    )


def _meeting_stretch(a: str, b: str) -> Column:
    """(lo, hi) along piece a, from 0 to 1, where piece b meets it; lo = hi for a crossing, NULL if they are apart."""
    ax, ay, bx, by = (F.col(f"{a}{c}") for c in ("x0", "y0", "x1", "y1"))
    cx, cy, ex, ey = (F.col(f"{b}{c}") for c in ("x0", "y0", "x1", "y1"))
    dx, dy, fx, fy = bx - ax, by - ay, ex - cx, ey - cy
    turn = dx * fy - dy * fx
    t = F.try_divide((cx - ax) * fy - (cy - ay) * fx, turn)
    u = F.try_divide((cx - ax) * dy - (cy - ay) * dx, turn)
    crossing = F.when(t.between(0, 1) & u.between(0, 1), F.struct(t.alias("lo"), t.alias("hi")))
    length2 = dx * dx + dy * dy
    p = F.try_divide((cx - ax) * dx + (cy - ay) * dy, length2)
    q = F.try_divide((ex - ax) * dx + (ey - ay) * dy, length2)
    lo, hi = F.greatest(F.lit(0.0), F.least(p, q)), F.least(F.lit(1.0), F.greatest(p, q))
    aligned = ((cx - ax) * dy - (cy - ay) * dx) == 0
    return F.when(turn != 0, crossing).otherwise(F.when(aligned & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi"))))


def _instances(requests: DataFrame, lines: DataFrame, cell_m: float) -> DataFrame:
    """request_id, i, asked, road_id: the lines of each asked road in the request's box (anywhere without one)."""
    asked = requests.select("request_id", *[F.col(c).alias(f"q{c}") for c in ("minx", "miny", "maxx", "maxy")],
                            F.posexplode("names").alias("i", "asked"))
    keyed = asked.withColumn("name_lc", F.explode(name_keys(F.col("asked"))))
    # A request's box and a road meet in cells: no pair of a request and a far road is built.
    roads = lines.where(F.size("points") >= 2).select("road_id", "name_lc", "minx", "miny", "maxx", "maxy")
    boxed = with_box_cells(keyed.where("qminx IS NOT NULL"), ["qminx", "qminy", "qmaxx", "qmaxy"], cell_m * 5)
    near = boxed.join(with_box_cells(roads, ["minx", "miny", "maxx", "maxy"], cell_m * 5), ["cx", "cy", "name_lc"])
    apart = geo.bbox_disjoint(
        [F.col(c) for c in ("minx", "miny", "maxx", "maxy")], [F.col(f"q{c}") for c in ("minx", "miny", "maxx", "maxy")]
    )
    chosen = near.where(~apart).select("request_id", "i", "asked", "road_id").distinct()
    anywhere = keyed.where("qminx IS NULL").join(roads, "name_lc").select("request_id", "i", "asked", "road_id")
    return chosen.unionByName(anywhere)


def missing_roads(requests: DataFrame, lines: DataFrame, cell_m: float = 200.0) -> DataFrame:
    """request_id, asked: asked roads without a line in the request's box; such a request fails as a whole."""
    known = _instances(requests, lines, cell_m).select("request_id", "i").distinct()
    asked = requests.select("request_id", F.posexplode("names").alias("i", "asked"))
    return asked.join(known, ["request_id", "i"], "left_anti").select("request_id", "asked")


def junctions(requests: DataFrame, lines: DataFrame, cell_m: float = 200.0, limit: int | None = None) -> DataFrame:
    """request_id, hit, name_a, name_b, x, y, lat, lon, n_intersections: where the 2-3 asked roads meet inside the box.

    `requests` has request_id, names (array) and minx..maxy (NULL = anywhere); `lines` has road_id,
    name_lc, minx..maxy and points. A request of which a road has no line in the box gives no rows.

    Pieces of different asked roads meet through cells. A pair of lines meets in points and in
    stretches they share: stretches that follow each other along the first line are one. Where lines
    share stretches only, they give one point, the middle of all shared length; beside crossings, each
    stretch gives its own. Crossings on a shared stretch don't count. A point is kept once per 0.1 m;
    hit numbers a request's points by roads, lines and place along the line, `limit` cuts them, and
    n_intersections counts them all.
    """
    chosen = _instances(requests, lines, cell_m)
    failed = missing_roads(requests, lines, cell_m).select("request_id").distinct()
    pieces = segments(lines)
    picked = chosen.join(failed, "request_id", "left_anti").join(pieces.select("road_id", "pos", "x0", "y0", "x1", "y1"), "road_id")
    box = [F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1")]
    picked = with_box_cells(picked, box, cell_m)
    names = ["i", "asked", "road_id", "pos", "x0", "y0", "x1", "y1"]
    a = picked.select("request_id", "cx", "cy", *[F.col(c).alias(f"a_{c}") for c in names])
    b = picked.select("request_id", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in names])
    pairs = a.join(b, ["request_id", "cx", "cy"]).where("a_i < b_i").withColumn("at", _meeting_stretch("a_", "b_")).where("at IS NOT NULL")
    pair = ["request_id", "a_i", "b_i", "a_road_id", "b_road_id", "a_asked", "b_asked"]

    def along(t: Column, axis: str) -> Column:
        return F.col(f"a_{axis}0") + t * (F.col(f"a_{axis}1") - F.col(f"a_{axis}0"))

    length = (F.col("at.hi") - F.col("at.lo")) * F.hypot(F.col("a_x1") - F.col("a_x0"), F.col("a_y1") - F.col("a_y0"))
    met = pairs.select(
        *pair, "b_pos", (F.col("a_pos") + F.col("at.lo")).alias("start"), (F.col("a_pos") + F.col("at.hi")).alias("stop"), length.alias("len"),
        *[along(F.col(f"at.{end}"), axis).alias(f"{axis}_{end}") for axis in "xy" for end in ("lo", "hi")],
    ).distinct()  # pieces may meet in several cells
    shared = met.where("len > 1e-9")
    in_order = Window.partitionBy(*pair).orderBy("start", "stop", "b_pos")
    reached = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    parted = shared.withColumn("new", F.coalesce((F.col("start") > reached + 1e-9).cast("int"), F.lit(1)))
    stretches = parted.withColumn("stretch", F.sum("new").over(in_order))
    # A crossing that lies on a shared stretch is a part of it.
    s, c = shared.select(*pair, "x_lo", "y_lo", "x_hi", "y_hi").alias("s"), met.where("len <= 1e-9").alias("c")
    dx, dy = F.col("s.x_hi") - F.col("s.x_lo"), F.col("s.y_hi") - F.col("s.y_lo")
    px, py = F.col("c.x_lo") - F.col("s.x_lo"), F.col("c.y_lo") - F.col("s.y_lo")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / (dx * dx + dy * dy)))
    on_it = F.hypot(px - t * dx, py - t * dy) <= 1e-6
    same = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in pair]
    crossings = c.join(s, [*same, on_it], "left_anti").select(*pair, "start", F.col("x_lo").alias("x"), F.col("y_lo").alias("y"))
    crossed = crossings.select(*pair).distinct().withColumn("crossed", F.lit(True))
    known = stretches.join(crossed, pair, "left").withColumn("stretch", F.when(F.col("crossed"), F.col("stretch")))
    weight = [(F.sum((F.col(f"{k}_lo") + F.col(f"{k}_hi")) / 2 * F.col("len")) / F.sum("len")).alias(k) for k in "xy"]
    middles = known.groupBy(*pair, "stretch").agg(F.min("start").alias("start"), *weight).drop("stretch")
    points = crossings.unionByName(middles.select(crossings.columns))
    key = ["request_id", F.round("x", 1).alias("kx"), F.round("y", 1).alias("ky")]
    order = F.struct("a_i", "b_i", "a_road_id", "b_road_id", "start", "x", "y", "a_asked", "b_asked")
    once = points.groupBy(*key).agg(F.min(order).alias("m")).select("request_id", "m.*")
    ranked = Window.partitionBy("request_id").orderBy("a_i", "b_i", "a_road_id", "b_road_id", "start", "x", "y")
    out = once.withColumns({"hit": F.row_number().over(ranked), "n_intersections": F.count("*").over(Window.partitionBy("request_id"))})
    if limit is not None:
        out = out.where(F.col("hit") <= limit)
    out = crs.bng_to_wgs84(out, "x", "y", "lat", "lon")
    return out.select(
        "request_id", "hit", F.col("a_asked").alias("name_a"), F.col("b_asked").alias("name_b"), "x", "y",
        F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n_intersections",
    )


def roads_nearby(points: DataFrame, roads: DataFrame, half_side: float = NEARBY_M) -> DataFrame:
    """point_id, name: distinct named roads whose box meets the square around a point.

    `points` has point_id, x, y; `roads` has name, minx..maxy. A road is known by its name in each
    cell before points are joined, so many pieces of one road in a cell count once there.
    """
    size = half_side
    named = roads.where(F.length(F.trim("name")) > 0).withColumn("name", F.trim("name"))
    inside = with_box_cells(named, ["minx", "miny", "maxx", "maxy"], size)
    x0, x1, y0, y1 = F.col("x") - half_side, F.col("x") + half_side, F.col("y") - half_side, F.col("y") + half_side
    squares = points.select("point_id", x0.alias("px0"), y0.alias("py0"), x1.alias("px1"), y1.alias("py1"))
    squares = with_box_cells(squares, ["px0", "py0", "px1", "py1"], size)
    meets = ~geo.bbox_disjoint(
        [F.col(c) for c in ("minx", "miny", "maxx", "maxy")], [F.col(c) for c in ("px0", "py0", "px1", "py1")]
    )
    return squares.join(inside, ["cx", "cy"]).where(meets).select("point_id", "name").distinct()


def road_overlap(requests: DataFrame, nearby: DataFrame) -> DataFrame:
    """request_id, n_matched, n_total, roads_present of the roads a document names.

    `requests` has request_id and names; `nearby` has request_id and name. Equal names (after
    normalising) are found by an equality join; only what is left is scored.
    """
    asked = requests.select("request_id", F.posexplode("names").alias("i", "asked")).withColumn(
        "norm", tx.normalise_road(F.col("asked"))
    )
    around = nearby.select("request_id", tx.normalise_road(F.col("name")).alias("ref")).where("ref <> ''").distinct()
    totals = requests.select("request_id", F.greatest(F.size("names"), F.lit(0)).alias("n_total"))
    present = nearby.select("request_id").distinct().withColumn("_present", F.lit(True))
    equal = asked.where("norm <> ''").join(
        around, (asked["request_id"] == around["request_id"]) & (asked["norm"] == around["ref"]), "left_semi"
    )
    rest = asked.where("norm <> ''").join(equal.select("request_id", "i"), ["request_id", "i"], "left_anti")
    texts = rest.join(around, "request_id").select("norm", "ref").distinct()
    alike = texts.where(token_set_ratio_udf("norm", "ref") >= ROAD_CUTOFF)
    scored = rest.join(around, "request_id").join(alike, ["norm", "ref"], "left_semi").select("request_id", "i")
    hits = equal.select("request_id", "i").unionByName(scored.distinct())
    counted = hits.groupBy("request_id").agg(F.count("*").alias("_n"))
    return totals.join(counted, "request_id", "left").join(present, "request_id", "left").select(
        "request_id",
        F.coalesce("_n", F.lit(0)).cast("int").alias("n_matched"),
        "n_total",
        (F.coalesce("_present", F.lit(False)) & (F.col("n_total") > 0)).alias("roads_present"),
    )


# Painting order, line widths at zoom 17 (fill, casing) and colours by road class.
CLASS_ORDER = {
    "Motorway": 0, "A Road": 1, "B Road": 2, "Minor Road": 3, "Local Street": 4, "Alley": 5,
    "Pedestrianised Street": 5,
}
WIDTHS = {
    "Motorway": (6.0, 8.0), "A Road": (4.0, 6.0), "B Road": (3.0, 5.0), "Minor Road": (2.0, 3.0),
    "Local Street": (1.5, 2.5), "Alley": (1.0, 1.5), "Pedestrianised Street": (1.0, 1.5),
}
DEFAULT_WIDTH = (1.5, 2.5)
LAYER_DEFAULTS = {"roads_local": "Local Street", "roads_regional": "B Road", "roads_national": "A Road"}
ROAD_COLOURS = {"Motorway": "180,200,255", "A Road": "200,220,255"}
DEFAULT_COLOUR = "255,255,255"


def _by_class(values: dict, default) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("cls")), F.lit(default))


def paint_table(layers: DataFrame, zoom: Column) -> DataFrame:
    """Add cls, paint_order, fill_width, casing_width and colour to merged road layers."""
    defaults = F.create_map(*[F.lit(x) for kv in LAYER_DEFAULTS.items() for x in kv])
    styled = layers.withColumn("cls", F.coalesce("type", F.try_element_at(defaults, F.col("layer"))))
    scale = F.pow(F.lit(2.0), zoom - 17)

    def width(i: int) -> Column:
        raw = _by_class({k: v[i] for k, v in WIDTHS.items()}, DEFAULT_WIDTH[i])
        return F.greatest(F.lit(1), (raw * scale).cast("int"))

    return styled.withColumns(
        {
            "paint_order": _by_class(CLASS_ORDER, 4),
            "fill_width": width(0), "casing_width": width(1),
            "colour": _by_class(ROAD_COLOURS, DEFAULT_COLOUR),
        }
    )


def road_index(roads: DataFrame) -> DataFrame:
    """name_lc, tile, box, centre, class and points (0.1 m) of every named road."""
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    boxed = roads.where((F.length(F.trim("name")) > 0) & (F.size("points") > 0)).select(
        F.lower(F.trim("name")).alias("name_lc"), F.trim("name").alias("name"), "tile",
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
        F.coalesce("cls", F.lit("")).alias("cls"),
        F.transform("points", lambda p: F.struct(F.bround(p["x"], 1).alias("x"), F.bround(p["y"], 1).alias("y"))).alias(
            "points"
        ),
    )
    return boxed.withColumns(
        {"cx": (F.col("minx") + F.col("maxx")) / 2, "cy": (F.col("miny") + F.col("maxy")) / 2}
    )


