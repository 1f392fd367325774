"""Overlay of polygons by vertical slabs.

Between two neighbouring breakpoints (corners and crossings) no two edges cross, so the edges of a
slab have one order from bottom to top. Walking up that order and keeping track of which polygons
are open gives every area of the overlay; even-odd counting covers holes, parts and rings that
cross themselves.

A union's work is keyed by (geometry, strip), a strip being a vertical band of the x range. An overlay's
is keyed by cells: the pair is cut at quantiles of its corners' x, and each of these columns at
quantiles of its own pieces' y. A cell is closed along the rows' borders wherever a polygon is open
there, so it is a small overlay of its own and areas add up over cells. Edges of a cell are shuffled
once: the crossing join, the slab window and the slab join all keep that partitioning.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import geo
from sitewise.functions.geometry import edges
from sitewise.operators.polygon import area_centroid

STRIP_EDGES = 32  # edges a strip or a cell is meant to hold
WHOLE = 2 * STRIP_EDGES  # pairs with no more corners need no cells


def _oriented(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Edges as (g, ax, ay, bx, by) from left to right."""
    flip = F.col("x1") < F.col("x0")
    return df.select(
        *keep,
        F.when(flip, F.col("x1")).otherwise(F.col("x0")).alias("ax"),
        F.when(flip, F.col("y1")).otherwise(F.col("y0")).alias("ay"),
        F.when(flip, F.col("x0")).otherwise(F.col("x1")).alias("bx"),
        F.when(flip, F.col("y0")).otherwise(F.col("y1")).alias("by"),
    )


def layer_edges(layers: DataFrame, keys: Sequence[str], owner: str, geom: str) -> DataFrame:
    """keys, g, _n, _min, _max and oriented edges of one geometry per row.

    `_n`, `_min`, `_max` (edge count and x range over all owners of a key) must be on the rows.
    """
    rows = edges(layers, [*keys, owner, "_n", "_min", "_max"], geom)
    rows = rows.withColumn("eid", F.struct("part", "ring", "pos"))
    # Vertical edges bound no slab.
    return _oriented(rows.withColumnRenamed(owner, "g").where("x0 <> x1"), [*keys, "g", "eid", "_n", "_min", "_max"])


def _y_at(p: str, x: Column) -> Column:
    """Height of edge `p` at x; the end points are met exactly."""
    ax, ay, bx, by = (F.col(f"{p}{c}") for c in ("ax", "ay", "bx", "by"))
    inner = ay + (by - ay) * ((x - ax) / F.nullif(bx - ax, F.lit(0.0)))
    return F.when(x == ax, ay).when(x == bx, by).otherwise(inner)


def slab_edges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, strip, g, eid, xl, xr, yl, yr: each edge cut to the slabs it spans.

    `rows` comes from layer_edges; any number of owners g may share a key.
    """
    keys = list(keys)
    by = [*keys, "strip"]
    strips = F.greatest(F.lit(1), F.ceil(F.col("_n") / STRIP_EDGES)).cast("int")
    rows = rows.withColumn("_s", strips)
    rows = rows.withColumn("_w", (F.col("_max") - F.col("_min")) / F.col("_s"))

    def strip_of(x: Column) -> Column:
        raw = F.floor((x - F.col("_min")) / F.nullif(F.col("_w"), F.lit(0.0))).cast("int")
        return F.greatest(F.lit(0), F.least(raw, F.col("_s") - 1))

    rows = rows.withColumn("strip", F.explode(F.sequence(strip_of(F.col("ax")), strip_of(F.col("bx")))))
    start = F.when(F.col("strip") == 0, F.col("_min")).otherwise(F.col("_min") + F.col("strip") * F.col("_w"))
    end = F.when(F.col("strip") == F.col("_s") - 1, F.col("_max")).otherwise(
        F.col("_min") + (F.col("strip") + 1) * F.col("_w")
    )
    return _slabs(rows.withColumns({"lo": F.greatest("ax", start), "hi": F.least("bx", end)}).where("lo < hi"), by)


def _slabs(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, g, eid, xl, xr, yl, yr of pieces (lo to hi of an edge) that lie in one strip or cell each."""
    columns = ["g", "eid", "ax", "ay", "bx", "by", "lo", "hi"]
    rows = rows.select(*by, *columns).repartition(*by)
    # All three readers of the shuffled edges ask for the same columns, so it is read, not redone.
    a = rows.select(*by, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rows.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(c).alias(f"b_{c}") for c in columns])
    same = functools.reduce(lambda p, q: p & q, [F.col(c) == F.col(f"_{c}") for c in by])
    order_a, order_b = F.struct("a_g", "a_eid"), F.struct("b_g", "b_eid")
    meet = (F.col("a_lo") < F.col("b_hi")) & (F.col("b_lo") < F.col("a_hi"))
    level = (F.greatest("a_ay", "a_by") >= F.least("b_ay", "b_by")) & (
        F.greatest("b_ay", "b_by") >= F.least("a_ay", "a_by")
    )
    itself = order_a == order_b
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    # Joins by hint: the planner takes exploded edges for few bytes and would send whole tables to the driver.
    pairs = a.join(b.hint("merge"), same & (itself | ((order_a < order_b) & meet & level)))
    pairs = pairs.select(*by, "a_lo", "a_hi", itself.alias("itself"), lo.alias("lo"), hi.alias("hi"),
                         (_y_at("a_", lo) - _y_at("b_", lo)).alias("d0"),
                         (_y_at("a_", hi) - _y_at("b_", hi)).alias("d1"))
    cross = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("d0") / F.nullif(F.col("d0") - F.col("d1"), F.lit(0.0)))
    breaks = pairs.where(F.col("itself") | (F.col("d0") * F.col("d1") < 0)).select(
        *by, F.explode(F.when(F.col("itself"), F.array("a_lo", "a_hi")).otherwise(F.array(cross))).alias("xl")
    )
    following = F.lead("xl").over(Window.partitionBy(*by).orderBy("xl"))
    slabs = breaks.withColumn("xr", following).where("xr > xl")
    cut = rows.join(slabs.hint("merge"), by).where("lo <= xl AND hi >= xr")
    return cut.select(
        *by, "g", "eid", "xl", "xr", _y_at("", F.col("xl")).alias("yl"), _y_at("", F.col("xr")).alias("yr")
    )


def _pair_edges(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    points = F.flatten(F.flatten(F.concat(F.col(a), F.col(b))))
    xs = F.transform(points, lambda p: p["x"])
    layers = pairs.select(
        key, F.explode(F.array(F.struct(F.lit(0).alias("g"), F.col(a).alias("geom")),
                               F.struct(F.lit(1).alias("g"), F.col(b).alias("geom")))).alias("_l"),
        F.size(points).alias("_n"), F.array_min(xs).alias("_min"), F.array_max(xs).alias("_max"),
    )
    return layer_edges(layers.select(key, "_l.*", "_n", "_min", "_max"), [key], "g", "geom")


def _quantiles(values: Column, parts: Column) -> Column:
    """Distinct inner values of an array at every share 1/parts, without its least."""
    n = F.size(values)
    ordered = F.filter(F.array_sort(values), lambda v, i: (i * parts) % n < parts)
    return F.array_except(F.array_distinct(ordered), F.array(F.array_min(values)))


def _pieces(pairs: DataFrame, key: str, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Edges cut at the columns of their pair, and upright edges with their column.

    Pieces have key, strip, g, eid, the edge, lo, hi, left and right (sides of the column; NULL right
    in the last); upright edges have key, strip, g, x, y0, y1.
    """
    flat = F.flatten(F.flatten(F.concat(F.col(a), F.col(b))))
    # A column of its own, so that no lambda works the corners out again for every one of them.
    pairs = pairs.select(key, a, b, F.transform(flat, lambda p: p["x"]).alias("_xs"))
    n = F.size("_xs")
    parts = F.ceil(F.sqrt(n / F.lit(STRIP_EDGES)))
    about = [_quantiles(F.col("_xs"), parts).alias("_cuts"), F.array_min("_xs").alias("_min")]
    owners = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(c).alias("geom")) for g, c in enumerate((a, b))]))
    layers = pairs.select(key, owners.alias("_l"), *about).select(key, "_l.*", "_cuts", "_min")
    keep = [key, "g", "_cuts", "_min"]
    rows = edges(layers, keep).withColumn("eid", F.struct("part", "ring", "pos"))
    rows = _oriented(rows, [*keep, "eid"])
    first = F.size(F.filter("_cuts", lambda c: c <= F.col("ax")))
    rows = rows.withColumns({
        "_first": first, "_inner": F.filter("_cuts", lambda c: (c > F.col("ax")) & (c < F.col("bx"))),
    })
    side = F.coalesce(F.get("_cuts", F.col("strip") - 1), F.col("_min"))
    stops = F.concat(F.array("ax"), "_inner", F.array("bx"))
    spans = F.transform(F.sequence(F.lit(0), F.size("_inner")), lambda k: F.struct(
        (F.col("_first") + k).alias("strip"), F.get(stops, k).alias("lo"), F.get(stops, k + 1).alias("hi")))
    cut = rows.where("ax < bx").withColumn("_p", F.explode(spans)).select("*", "_p.*")
    cut = cut.select(key, "strip", "g", "eid", "ax", "ay", "bx", "by", "lo", "hi",
                     side.alias("left"), F.get("_cuts", F.col("strip")).alias("right"))
    upright = rows.where("ax = bx").withColumn("strip", F.col("_first"))
    # At a column's left side the pieces that start there tell which polygons are open.
    upright = upright.where(F.col("ax") > side)
    return cut, upright.select(
        key, "strip", "g", F.col("ax").alias("x"), F.least("ay", "by").alias("y0"), F.greatest("ay", "by").alias("y1"))


def _row_cuts(cut: DataFrame, uprights: DataFrame, by: list[str]) -> DataFrame:
    """by, rows: heights between corners at which a column is cut, one for every STRIP_EDGES pieces."""
    ends = cut.select(*by, F.explode(F.array("yl", "yr")).alias("y")).unionByName(
        uprights.select(*by, F.explode(F.array("y0", "y1")).alias("y")))
    heights = ends.groupBy(*by, "y").agg(F.count("*").alias("n"))
    up = Window.partitionBy(*by).orderBy("y")
    done = F.sum("n").over(up)
    full = F.floor(done / (2 * STRIP_EDGES)) > F.floor((done - F.col("n")) / (2 * STRIP_EDGES))
    heights = heights.withColumns({"_full": full, "_next": F.lead("y").over(up)})
    middle = (F.col("y") + F.col("_next")) / 2
    # A cut at no corner's height: every edge passes it or stays clear of it.
    good = F.col("_full") & (middle > F.col("y")) & (middle < F.col("_next"))
    return heights.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(good, middle))).alias("rows"))


def _borders(toggles: DataFrame, pieces: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Flat pieces along the rows' borders where a polygon is open there; each one closes the cell on either side.

    What is open at the left end of a border is the parity of the pieces that start at the column's left side in
    the rows below it, a running sum over rows; edges that pass the border change it from there on.
    """
    levels = cuts.select(*by, "left", "right", F.posexplode("rows").alias("j", "c")).withColumn("row", F.col("j") + 1)
    both = levels.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1))))
    starts = pieces.where("lo = left").groupBy(*by, "g", "row").agg(F.count("*").alias("n"))
    ladder = both.select(*by, "g", "row", "left", "right", "c", F.lit(0).alias("n")).unionByName(
        starts, allowMissingColumns=True)
    below = Window.partitionBy(*by, "g").orderBy("row").rangeBetween(Window.unboundedPreceding, -1)
    ladder = ladder.withColumn("n", F.coalesce(F.sum("n").over(below), F.lit(0))).where("c IS NOT NULL")
    passing = toggles.where("x > left").select(*by, "g", "row", "left", "right", "c", "x")
    events = passing.unionByName(ladder.where("n % 2 = 1").select(*by, "g", "row", "left", "right", "c", F.col("left").alias("x")))
    along = Window.partitionBy(*by, "g", "row").orderBy("x")
    spans = events.withColumns({
        "_k": F.row_number().over(along), "hi": F.coalesce(F.lead("x").over(along), "right")
    }).where("_k % 2 = 1 AND x < hi")
    eid = F.struct(F.lit(-1).alias("part"), F.col("row").alias("ring"), F.col("_k").alias("pos"))
    sides = F.explode(F.array(F.col("row") - 1, F.col("row")))
    return spans.select(
        *by, sides.alias("row"), "g", eid.alias("eid"), F.col("x").alias("ax"), F.col("c").alias("ay"), F.col("hi").alias("bx"),
        F.col("c").alias("by"), F.col("x").alias("lo"), "hi")


def cell_pieces(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, strip, row, g, eid, the edge, lo, hi: closed pieces of both geometries by cell.

    A column has about the root of the pair's corners times that of STRIP_EDGES, and what passes through; a task
    sorts their heights. A geometry is one row, so that is less than what one task held before.
    """
    by = [key, "strip"]
    out = [*by, "row", "g", "eid", "ax", "ay", "bx", "by", "lo", "hi"]
    cut, uprights = _pieces(pairs, key, a, b)
    cut = cut.withColumns({"yl": _y_at("", F.col("lo")), "yr": _y_at("", F.col("hi"))})
    sides = cut.groupBy(*by).agg(F.min("left").alias("left"), F.coalesce(F.min("right"), F.max("hi")).alias("right"))
    cuts = sides.join(_row_cuts(cut, uprights, by), by)
    cut = cut.drop("left", "right").join(cuts, by)
    least, most = F.least("yl", "yr"), F.greatest("yl", "yr")
    cut = cut.withColumns({
        "_low": F.size(F.filter("rows", lambda c: c < least)),
        "_cross": F.filter("rows", lambda c: (c > least) & (c < most)),
    })
    rising = F.col("yr") >= F.col("yl")
    reach = F.size("_cross")
    # The heights in the order in which the piece meets them, each with the x of the meeting.
    met = F.when(rising, F.col("_cross")).otherwise(F.reverse("_cross"))
    at = F.transform(met, lambda c: F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("lo") + (
        F.col("hi") - F.col("lo")) * ((c - F.col("yl")) / F.nullif(F.col("yr") - F.col("yl"), F.lit(0.0))))))
    cut = cut.withColumn("_stops", F.concat(F.array("lo"), at, F.array("hi")))
    spans = F.transform(F.sequence(F.lit(0), reach), lambda k: F.struct(
        (F.col("_low") + F.when(rising, k).otherwise(reach - k)).alias("row"),
        F.get("_stops", k).alias("lo"), F.get("_stops", k + 1).alias("hi"), (k > 0).alias("_entered")))
    pieces = cut.withColumn("_p", F.explode(spans)).drop("lo", "hi").select("*", "_p.*")
    # A piece that follows another one of its edge has passed the border between their rows.
    border = F.when(rising, F.col("row")).otherwise(F.col("row") + 1)
    entered = pieces.where("_entered").withColumn("_b", border).select(
        *by, "g", F.col("_b").alias("row"), "left", "right", F.get("rows", F.col("_b") - 1).alias("c"), F.col("lo").alias("x"))
    walls = uprights.join(cuts, by).select(*by, "g", "left", "right", "x", "y0", "y1", F.posexplode("rows").alias("j", "c"))
    walls = walls.where("y0 < c AND c < y1").select(
        *by, "g", (F.col("j") + 1).alias("row"), "left", "right", "c", "x")
    pieces = pieces.where("lo < hi")
    closing = _borders(entered.unionByName(walls), pieces, cuts, by)
    return pieces.select(*out).unionByName(closing.select(*out))


def overlay_areas(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, area_a, area_b, area_both, area_any of the two geometries of each row; `key` is unique.

    Whether any pair is large enough for cells is looked up first, with one scan of the pairs: the stages that
    cut cells cost more than the rest of the work where all pairs are small.
    """
    cell = ["_key", "strip", "row"]
    corners = F.size(F.flatten(F.flatten(F.concat(F.col(a), F.col(b)))))
    named = pairs.select(F.col(key).alias("_key"), a, b)
    large = named.where(corners > WHOLE)
    some = not large.isEmpty()
    small = named.where(corners <= WHOLE) if some else named
    pieces = slab_edges(_pair_edges(small, "_key", a, b), ["_key"]).withColumn("row", F.lit(0))
    if some:
        pieces = pieces.unionByName(_slabs(cell_pieces(large, "_key", a, b), cell))
    pieces = pieces.withColumn("ym", (F.col("yl") + F.col("yr")) / 2)
    order = Window.partitionBy(*cell, "xl").orderBy("ym", "g", "eid")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    open_a = F.sum(F.when(F.col("g") == 0, 1).otherwise(0)).over(upto) % 2 == 1
    open_b = F.sum(F.when(F.col("g") == 1, 1).otherwise(0)).over(upto) % 2 == 1
    pieces = pieces.withColumns({"rise": F.lead("ym").over(order) - F.col("ym"), "ia": open_a, "ib": open_b})
    size = F.col("rise") * (F.col("xr") - F.col("xl"))

    def total(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, size)), F.lit(0.0))

    return pieces.groupBy(F.col("_key").alias(key)).agg(
        total(F.col("ia")).alias("area_a"), total(F.col("ib")).alias("area_b"),
        total(F.col("ia") & F.col("ib")).alias("area_both"), total(F.col("ia") | F.col("ib")).alias("area_any"),
    )


def score_pairs(pairs: DataFrame, key: str, truth: str, predicted: str) -> DataFrame:
    """Add iou, precision, recall, centroid_distance_m and repaired to truth/prediction pairs.

    A pair with a missing geometry keeps NULL measures.
    """
    both = pairs.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    areas = overlay_areas(both.select(key, truth, predicted), key, truth, predicted)

    def share(whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col("area_both"), F.col(whole)), F.lit(0.0))

    measured = pairs.withColumns({"_t": area_centroid(F.col(truth)), "_p": area_centroid(F.col(predicted))})
    measured = measured.join(areas.hint("merge"), key, "left")
    # Ring areas and even-odd areas differ only where a ring crosses itself.
    off = F.greatest(F.abs(F.col("_t.area") - F.col("area_a")), F.abs(F.col("_p.area") - F.col("area_b")))
    found = F.col("area_any").isNotNull()
    distance = geo.haversine_m(F.col("_t.c.y"), F.col("_t.c.x"), F.col("_p.c.y"), F.col("_p.c.x"))
    return measured.select(
        *pairs.columns,
        F.when(found, share("area_any")).alias("iou"),
        F.when(found, share("area_b")).alias("precision"),
        F.when(found, share("area_a")).alias("recall"),
        distance.alias("centroid_distance_m"),
        (off > F.col("area_any") * 1e-9).alias("repaired"),
    )
