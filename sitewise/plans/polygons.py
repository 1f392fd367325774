"""Queries of the polygon family: overlay, measures, union and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.evaluate import scores as sc
from sitewise.functions import geometry, geo
from sitewise.functions import text as tx
from sitewise.functions.geometry import bounds, edges, multi_of_ring
from sitewise.operators import masks, overlay, reproject, union
from sitewise.operators.polygon import area, centroid, nearest_part_error_km, span_m
from sitewise.plans import sqlgeo
from sitewise.plans.bindings import Inputs
from sitewise.plans.registry import query
from sitewise.session import spread


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


MASKS_PER_TASK, RUNS_PER_TASK = 1 << 15, 1 << 20  # a mask of these queries has some 30 to 60 runs


def quad_pairs(i: Inputs, degrees: bool = False, unit: float = 1.0, per_task: int = 0):
    """case_id, truth, predicted and the binding's columns; optionally on a small box of degrees, or spread."""
    q = i.bind("case_quad")
    if per_task:
        q = spread(q, "case_id", rows_per_task=per_task)

    def quad(ox, oy):
        w, h, s = F.col("w"), F.col("h"), F.col("skew")
        corners = ((ox, oy), (ox + w, oy), (ox + w + s, oy + h), (ox + s, oy + h))
        if degrees:
            corners = tuple((x / 1000 - 2, y / 1000 + 52) for x, y in corners)
        corners = tuple((x / unit, y / unit) for x, y in corners)
        return multi_of_ring(*corners)

    tx_, ty_ = F.col("tx"), F.col("ty")
    return q.select(
        *q.columns, quad(tx_, ty_).alias("truth"), quad(tx_ + F.col("dx"), ty_ + F.col("dy")).alias("predicted")
    )


_OVERLAP = """
    ov AS (SELECT *, w * h AS one, greatest(0, w - abs(dx - skew * dy / h)) * greatest(0, h - abs(dy)) AS shared FROM case_quad)"""
_CENTRES = """
    ce AS (SELECT *, (tx + (w + skew) / 2) / 1000 - 2 AS lon1, (ty + h / 2) / 1000 + 52 AS lat1,
                  (tx + dx + (w + skew) / 2) / 1000 - 2 AS lon2, (ty + dy + h / 2) / 1000 + 52 AS lat2 FROM ov)"""


@query("polygon_overlay", "case_quad", sql=f"""WITH {_OVERLAP}
    SELECT case_id, round(shared / (2 * one - shared), 10) AS iou, round(shared / one, 10) AS precision, round(shared / one, 10) AS recall,
        round({sqlgeo.haversine_km('(ty + h / 2) / 1024', '(tx + (w + skew) / 2) / 1024', '(ty + dy + h / 2) / 1024', '(tx + dx + (w + skew) / 2) / 1024')} * 1000, 3)
        AS centroid_distance_m, false AS repaired FROM ov""")
def polygon_overlay(i: Inputs):
    """Scores of every pair against the closed form; 1024 units make a degree, so corners are exact."""
    scored = overlay.score_pairs(quad_pairs(i, unit=1024.0), "case_id", "truth", "predicted")
    return scored.select("case_id", _r("iou", 10), _r("precision", 10), _r("recall", 10), _r("centroid_distance_m", 3), "repaired")


_REPORT_SQL = f"""WITH {_OVERLAP}, {_CENTRES},
    sc AS (SELECT concat('C', CAST(case_id AS STRING)) AS folder, CASE WHEN dy < 4 THEN shared / (2 * one - shared) ELSE 0 END AS v FROM ce),
    s AS (SELECT trim(replace(lower(trim(colour)), '?', '')) AS colour, trim(replace(lower(trim(quality)), '?', '')) AS quality,
                 trim(replace(lower(trim(complexity)), '?', '')) AS complexity, v FROM case_label JOIN sc USING (folder)),
    u AS (SELECT 'total' AS dimension, 'all' AS bucket, v FROM s UNION ALL SELECT 'colour', colour, v FROM s
          UNION ALL SELECT 'quality', quality, v FROM s UNION ALL SELECT 'complexity', complexity, v FROM s)
    SELECT dimension, bucket, count(*) AS n, round(avg(v), 6) AS mean_iou, round(100.0 * count(*) FILTER (WHERE v >= 0.8) / count(*), 6) AS pct_ge_08,
        true AS covered FROM u GROUP BY 1, 2"""


@query("boundary_report", "case_quad", "case_label", sql=_REPORT_SQL)
def boundary_report(i: Inputs):
    """Predicted against true boundaries by document attribute; cases without a prediction score 0."""
    pairs = quad_pairs(i, True).select(
        "case_id", "truth", F.when(F.col("dy") < 4, F.col("predicted")).alias("predicted")
    )
    scored = overlay.score_pairs(pairs, "case_id", "truth", "predicted")
    # Nine decimals: far finer than any report, and free of the last bits of the slab sums.
    scores = scored.select(F.concat(F.lit("C"), F.col("case_id").cast("string")).alias("folder"), F.round("iou", 9).alias("iou"))
    table = sc.attribute_breakdown(i.bind("case_label"), scores)
    return table.select("dimension", "bucket", "n", _r("mean_iou"), _r("pct_ge_08"), "covered")


@query("polygon_centroid", "case_quad", sql="""
    SELECT case_id, round(tx + (w + skew) / 2, 6) AS x, round(ty + h / 2, 6) AS y, round(w * h, 6) AS area,
        tx AS minx, ty AS miny, tx + w + skew AS maxx, ty + h AS maxy FROM case_quad""")
def polygon_centroid(i: Inputs):
    q = quad_pairs(i).select("case_id", centroid(F.col("truth")).alias("c"), area(F.col("truth")).alias("area"), bounds(F.col("truth")).alias("b"))
    return q.select("case_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), _r("area"), "b.*")


@query("nearest_part", "case_quad", sql=f"""WITH {_OVERLAP}, {_CENTRES}
    SELECT case_id, round(least({sqlgeo.haversine_km('CAST(52.5 AS DOUBLE)', 'CAST(-1.5 AS DOUBLE)', 'lat1', 'lon1')},
        {sqlgeo.haversine_km('CAST(52.5 AS DOUBLE)', 'CAST(-1.5 AS DOUBLE)', 'lat2', 'lon2')}), 6) AS err_km FROM ce""")
def nearest_part(i: Inputs):
    """Error of a pick against the nearest part of a two-part truth."""
    parts = quad_pairs(i, True).select("case_id", F.concat("truth", "predicted").alias("geom"))
    err = nearest_part_error_km(F.lit(52.5), F.lit(-1.5), F.col("geom"))
    return parts.select("case_id", F.round(err, 6).alias("err_km"))


def _corner_sql() -> str:
    corners = (("tx", "ty"), ("tx + w", "ty"), ("tx + w + skew", "ty + h"), ("tx + skew", "ty + h"))
    return " UNION ALL ".join(
        f"SELECT case_id, {k} AS k, ({x}) / 1000 - 2 AS lon, ({y}) / 1000 + 52 AS lat FROM case_quad" for k, (x, y) in enumerate(corners)
    )


@query("polygon_span", "case_quad", sql=f"""WITH v AS ({_corner_sql()})
    SELECT a.case_id, round(max({sqlgeo.haversine_km('a.lat', 'a.lon', 'b.lat', 'b.lon')}) * 1000, 3) AS span_m
    FROM v a JOIN v b ON a.case_id = b.case_id AND a.k < b.k GROUP BY 1""")
def polygon_span(i: Inputs):
    """Widest distance over the hull's corners."""
    return span_m(quad_pairs(i, True).select("case_id", F.col("truth").alias("geom"))).select("case_id", _r("span_m", 3))


@query("polygon_union", "case_quad", sql=f"""WITH {_OVERLAP}
    SELECT case_id, round(2 * one - shared, 5) AS area, CAST(CASE WHEN shared > 0 THEN 1 ELSE 2 END AS INT) AS n_parts FROM ov
    WHERE (abs(dx - skew * dy / h) < w AND abs(dy) < h) OR abs(dx - skew * dy / h) > w OR abs(dy) > h""")
def polygon_union(i: Inputs):
    """Union of two boundaries per case; pairs that only touch have no defined number of parts."""
    pairs = quad_pairs(i)
    shift = F.abs(F.col("dx") - F.col("skew") * F.col("dy") / F.col("h"))
    clear = ((shift < F.col("w")) & (F.abs("dy") < F.col("h"))) | (shift > F.col("w")) | (F.abs("dy") > F.col("h"))
    layers = F.explode(F.array(*[F.struct(F.lit(k).alias("g"), F.col(c).alias("geom")) for k, c in enumerate(("truth", "predicted"))]))
    parts = pairs.where(clear).select("case_id", layers.alias("_l")).select("case_id", "_l.*")
    merged = union.union_geometries(parts, "case_id", "g")
    return merged.select("case_id", F.round(area(F.col("geom")), 5).alias("area"), F.size("geom").alias("n_parts"))


@query("geometry_changed", "case_quad", sql="SELECT case_id, dx <> 0 OR dy <> 0 AS changed FROM case_quad")
def geometry_changed(i: Inputs):
    return quad_pairs(i).select("case_id", tx.changed(F.col("truth"), F.col("predicted")).alias("changed"))


@query("geojson_roundtrip", "case_quad", sql="""
    SELECT case_id, '' AS reason, 1 AS n_polygons, round(w * h, 5) AS area FROM case_quad""")
def geojson_roundtrip(i: Inputs):
    """Geometry to GeoJSON text and back."""
    docs = quad_pairs(i).select("case_id", geometry.to_geojson(F.col("truth")).alias("doc"))
    back = docs.withColumn("geom", geometry.parse_geometry(F.col("doc")))
    return back.select(
        "case_id", geometry.format_reason(F.col("doc")).alias("reason"), F.size("geom").alias("n_polygons"),
        F.round(area(F.col("geom")), 5).alias("area"),
    )


_MERGED = """
    st AS (SELECT mask_id, which, row_no, x_start, max(x_end) AS x_end FROM mask_run GROUP BY 1, 2, 3, 4),
    mk AS (SELECT *, CASE WHEN x_start <= max(x_end) OVER (PARTITION BY mask_id, which, row_no ORDER BY x_start
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM st),
    il AS (SELECT *, sum(fresh) OVER (PARTITION BY mask_id, which, row_no ORDER BY x_start) AS island FROM mk),
    mr AS (SELECT mask_id, which, row_no, min(x_start) AS s, max(x_end) AS e FROM il GROUP BY mask_id, which, row_no, island)"""


@query("mask_confusion", "mask_run", sql="""WITH
    px AS (SELECT DISTINCT mask_id, which, row_no, unnest(range(x_start, x_end)) AS x FROM mask_run),
    pp AS (SELECT mask_id, row_no, x, max(CASE WHEN which = 'pred' THEN 1 ELSE 0 END) AS p, max(CASE WHEN which = 'gt' THEN 1 ELSE 0 END) AS g FROM px GROUP BY 1, 2, 3),
    c AS (SELECT mask_id, CAST(sum(p * g) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS n_pred, CAST(sum(g) AS BIGINT) AS n_gt FROM pp GROUP BY 1),
    k AS (SELECT *, coalesce(tp * 1.0 / nullif(n_pred, 0), 0) AS pr, coalesce(tp * 1.0 / nullif(n_gt, 0), 0) AS rc FROM c)
    SELECT mask_id, tp, n_pred, n_gt, round(coalesce(tp * 1.0 / nullif(n_pred + n_gt - tp, 0), 0), 6) AS iou, round(pr, 6) AS precision, round(rc, 6) AS recall,
        round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1, round(coalesce(2.0 * tp / nullif(n_pred + n_gt, 0), 0), 6) AS dice FROM k""")
def mask_confusion(i: Inputs):
    c = masks.mask_confusion(i.bind("mask_run"))
    return c.select("mask_id", "tp", "n_pred", "n_gt", *[_r(n) for n in ("iou", "precision", "recall", "f1", "dice")])


@query("mask_confusion_by_shape", "mask_run", sql="""WITH
    px AS (SELECT DISTINCT mask_id, which, row_no, unnest(range(x_start, x_end)) AS x FROM mask_run),
    pp AS (SELECT mask_id, row_no, x, max(CASE WHEN which = 'pred' THEN 1 ELSE 0 END) AS p, max(CASE WHEN which = 'gt' THEN 1 ELSE 0 END) AS g FROM px GROUP BY 1, 2, 3),
    c AS (SELECT mask_id, CAST(sum(p * g) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS n_pred, CAST(sum(g) AS BIGINT) AS n_gt FROM pp GROUP BY 1),
    k AS (SELECT *, coalesce(tp * 1.0 / nullif(n_pred, 0), 0) AS pr, coalesce(tp * 1.0 / nullif(n_gt, 0), 0) AS rc FROM c)
    SELECT mask_id, CASE WHEN mask_id % 3 <> 0 THEN tp END AS tp, n_pred, n_gt, CASE WHEN mask_id % 3 <> 0 THEN round(coalesce(tp * 1.0 / nullif(n_pred + n_gt - tp, 0), 0), 6) END AS iou FROM k""")
def mask_confusion_by_shape(i: Inputs):
    """Scores of masks of which every third pair has unlike shapes."""
    runs = i.bind("mask_run")
    unlike = (F.col("mask_id") % 3 == 0) & (F.col("which") == "gt")
    pairs = runs.select("mask_id").distinct().withColumn("which", F.explode(F.array(F.lit("pred"), F.lit("gt"))))
    shapes = pairs.select("mask_id", "which", F.lit(256).alias("height"), F.when(unlike, 255).otherwise(256).alias("width"))
    return masks.mask_confusion(runs, shapes).select("mask_id", "tp", "n_pred", "n_gt", _r("iou"))


@query("merged_runs", "mask_run", sql=f"WITH {_MERGED} SELECT mask_id, which, row_no, s AS x_start, e AS x_end FROM mr")
def merged_runs(i: Inputs):
    keys = ["mask_id", "which", "row_no"]
    return masks.merge_runs(spread(i.bind("mask_run"), *keys, rows_per_task=RUNS_PER_TASK), keys)


@query("polygon_fill", "case_quad", sql="""WITH
    r AS (SELECT case_id, tx, w, skew, h, ty, CAST(unnest(range(CAST(ty AS BIGINT), CAST(ty + h AS BIGINT))) AS INT) AS row_no FROM case_quad),
    o AS (SELECT *, tx + skew * (row_no + 0.5 - ty) / h AS l FROM r)
    SELECT case_id, row_no, CAST(ceil(l - 0.5) AS INT) AS x_start, CAST(floor(l + w - 0.5) + 1 AS INT) AS x_end FROM o""")
def polygon_fill(i: Inputs):
    """Polygon to mask runs."""
    sides = edges(quad_pairs(i).select("case_id", F.col("truth").alias("geom")), ["case_id"])
    return masks.fill_polygons(sides, ["case_id"])


@query("mask_outlines", "case_quad", sql="SELECT case_id AS mask_id, 1 AS n_parts, true AS inside FROM case_quad")
def mask_outlines(i: Inputs):
    """Masks traced and projected through an affine; the outline must lie in the mask's own tile box."""
    q = quad_pairs(i, per_task=MASKS_PER_TASK)
    sides = edges(q.select("case_id", F.col("truth").alias("geom")), ["case_id"])
    runs = masks.fill_polygons(sides, ["case_id"]).withColumnRenamed("case_id", "mask_id")
    rings = masks.trace_outlines(runs)
    affines = q.select(
        F.col("case_id").alias("mask_id"), *[F.lit(v).alias(n) for n, v in zip(("a00", "a01", "a02", "a10", "a11", "a12"), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))],
        F.lit(17).alias("zoom"), F.lit(65000).alias("tx_min"), F.lit(43000).alias("ty_min"), "tx", "ty", "w", "h", "skew",
    )
    shapes = masks.project_outlines(rings, affines).withColumn("b", bounds(F.col("geom")))
    zoom, x0, y0 = F.lit(17), F.lit(65000), F.lit(43000)
    joined = shapes.join(affines.select("mask_id", "tx", "ty", "w", "h", "skew").hint("merge"), "mask_id")
    ok = (
        (F.col("b.minx") >= geo.pixel_lon(F.col("tx") - 1, zoom, x0)) & (F.col("b.maxx") <= geo.pixel_lon(F.col("tx") + F.col("w") + F.col("skew"), zoom, x0))
        & (F.col("b.maxy") <= geo.pixel_lat(F.col("ty") - 1, zoom, y0)) & (F.col("b.miny") >= geo.pixel_lat(F.col("ty") + F.col("h"), zoom, y0))
    )
    return joined.select("mask_id", F.size("geom").alias("n_parts"), ok.alias("inside"))


@query("outline_fill", sql="""
    SELECT c_custkey AS mask_id, CAST((20 + c_custkey % 9) * (24 + c_custkey % 7) AS BIGINT) AS n_pixels FROM customer""")
def outline_fill(i: Inputs):
    """Drawn frames filled to regions: one frame per customer on a 60 x 70 page."""
    c = spread(i.table("customer").select("c_custkey"), "c_custkey", rows_per_task=MASKS_PER_TASK).select(
        F.col("c_custkey").alias("mask_id"), (20 + F.col("c_custkey") % 9).cast("int").alias("h"),
        (24 + F.col("c_custkey") % 7).cast("int").alias("w"), F.lit(60).alias("height"), F.lit(70).alias("width"),
    )
    rows = c.withColumn("row_no", F.explode(F.sequence(F.lit(15), F.col("h") + 14)))
    edge_row = (F.col("row_no") == 15) | (F.col("row_no") == F.col("h") + 14)
    full = F.array(F.struct(F.lit(20).alias("s"), (F.col("w") + 20).alias("e")))
    ends = F.array(F.struct(F.lit(20).alias("s"), F.lit(21).alias("e")), F.struct((F.col("w") + 19).alias("s"), (F.col("w") + 20).alias("e")))
    runs = rows.select("mask_id", "height", "width", "row_no", F.explode(F.when(edge_row, full).otherwise(ends)).alias("_r"))
    runs = runs.select("mask_id", "height", "width", "row_no", F.col("_r.s").alias("x_start"), F.col("_r.e").alias("x_end"))
    filled = masks.fill_outlines(runs)
    return filled.groupBy("mask_id").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("n_pixels"))


def _grid_corner_sql() -> str:
    corners = (("tx", "ty"), ("tx + w", "ty"), ("tx + w + skew", "ty + h"), ("tx + skew", "ty + h"), ("tx", "ty"))
    return " UNION ALL ".join(
        f"SELECT case_id, {k} AS pos, 400000 + 100 * ({x}) AS e, 200000 + 100 * ({y}) AS n FROM case_quad"
        for k, (x, y) in enumerate(corners)
    )


def _grid_quads(i: Inputs):
    """The true boundaries on grid metres."""
    q = i.bind("case_quad")
    x, y, w, h, s = F.col("tx"), F.col("ty"), F.col("w"), F.col("h"), F.col("skew")
    corners = ((x, y), (x + w, y), (x + w + s, y + h), (x + s, y + h))
    return q.select("case_id", multi_of_ring(*[(400000 + 100 * a, 200000 + 100 * b) for a, b in corners]).alias("geom"))


@query("reprojected_bounds", "case_quad", sql=f"""WITH f AS ({_grid_corner_sql()}), {sqlgeo.bng_to_wgs84('f', 'm')}
    SELECT case_id, round(min(lon), 5) AS minx, round(min(lat), 5) AS miny, round(max(lon), 5) AS maxx, round(max(lat), 5) AS maxy FROM m GROUP BY 1""")
def reprojected_bounds(i: Inputs):
    """Bounds in degrees of boundaries on the grid, over all their corners."""
    b = reproject.reprojected_bounds(_grid_quads(i), "case_id", reproject.grid_to_degrees)
    return b.select("case_id", *[_r(c, 5) for c in ("minx", "miny", "maxx", "maxy")])


@query("geometry_pixels", "case_quad", sql=f"""WITH f AS ({_grid_corner_sql()}), {sqlgeo.bng_to_wgs84('f', 'm')},
    c AS (SELECT case_id, pos, (6378137 * radians(lon) + 250000) / 500000 * 1024 AS px,
                 (1 - (6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) - 6700000) / 500000) * 1024 AS py FROM m)
    SELECT case_id, CAST(pos AS INT) AS pos, round(px, 2) AS px, round(py, 2) AS py FROM c""")
def geometry_pixels(i: Inputs):
    """Corners of boundaries on a canvas with given Mercator bounds."""
    canvas = {"xmin": -250000.0, "ymin": 6700000.0, "xmax": 250000.0, "ymax": 7200000.0, "cw": 1024.0, "ch": 1024.0}
    q = _grid_quads(i).withColumns({k: F.lit(v) for k, v in canvas.items()})
    p = reproject.geometry_pixels(q, "case_id", ["xmin", "ymin", "xmax", "ymax"], ["cw", "ch"])
    return p.select("case_id", "pos", _r("px", 2), _r("py", 2))
