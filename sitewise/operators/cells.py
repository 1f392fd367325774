"""Grid cells: spatial joins as equality joins on a cell, with an exact check after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def with_point_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"cx": cell(F.col(x), size), "cy": cell(F.col(y), size)})


def with_box_cells(df: DataFrame, box: Sequence[str | Column], size: float) -> DataFrame:
    """One row per cell that the box minx, miny, maxx, maxy touches."""
    minx, miny, maxx, maxy = (F.col(b) if isinstance(b, str) else b for b in box)
    df = df.withColumn("cx", F.explode(F.sequence(cell(minx, size), cell(maxx, size))))
    return df.withColumn("cy", F.explode(F.sequence(cell(miny, size), cell(maxy, size))))


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, size: float, x: str = "x", y: str = "y"
) -> DataFrame:
    """point_id, polygon_id of every point inside a polygon (`geom`), boundary not guaranteed.

    Candidates come from cells of the polygon's box. The crossing test joins each candidate with
    the edges of that polygon in its own row of cells only, so neither a large polygon nor a dense
    cell is ever held by one task.
    """
    from sitewise.functions.geometry import bounds, edges

    boxes = polygons.select(polygon_id, bounds(F.col("geom")).alias("_b")).select(polygon_id, "_b.*")
    boxes = with_box_cells(boxes, ["minx", "miny", "maxx", "maxy"], size)
    spots = with_point_cell(points.select(point_id, F.col(x).alias("px"), F.col(y).alias("py")), "px", "py", size)
    inside_box = F.col("px").between(F.col("minx"), F.col("maxx")) & F.col("py").between(F.col("miny"), F.col("maxy"))
    near = spots.join(boxes, ["cx", "cy"]).where(inside_box).select(point_id, polygon_id, "px", "py", "cy")
    sides = edges(polygons, [polygon_id]).where("y0 <> y1")
    sides = sides.withColumn(
        "cy", F.explode(F.sequence(cell(F.least("y0", "y1"), size), cell(F.greatest("y0", "y1"), size)))
    )
    straddles = (F.col("y0") > F.col("py")) != (F.col("y1") > F.col("py"))
    at = F.col("x0") + (F.col("py") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(
        F.col("y1") - F.col("y0"), F.lit(0.0)
    )
    crossed = near.join(sides, [polygon_id, "cy"]).where(straddles & (F.col("px") < at))
    odd = crossed.groupBy(point_id, polygon_id).agg(F.count("*").alias("_n")).where(F.col("_n") % 2 == 1)
    return odd.select(point_id, polygon_id)
