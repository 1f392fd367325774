"""Search plan of a match: scale and zoom settings, tile grids and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import geo

# Canonical map scales, the modal one, and the grid and window limits.
SCALES = (1250, 2500, 5000, 10000, 15000, 25000)
MODAL_SCALE = 2500
STRETCH = (0.85, 1.15)
GRID_LIMITS = (3, 17)
MIN_MARGIN = 2
WINDOW_TARGET = 100
MIN_STRIDE = 32


def spread_maps(maps: DataFrame) -> DataFrame:
    """The maps dealt to all shuffle partitions: a map is a few bytes in a file and hundreds of windows or tiles."""
    return maps.repartition(int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "map_id")


def search_configs(maps: DataFrame, dpi: int = 200) -> DataFrame:
    """map columns plus pos, zoom, mpp. `maps` has map_id, scale (NULL = unknown) and lat.

    A known scale tries its best zoom and both neighbours, then two stretched scales. An unknown
    one tries each canonical scale that opens a new zoom, then the stretched modal scale.
    """
    lat = F.col("lat")
    # Columns of their own, so that no branch or lambda works a zoom out again.
    canonical = [geo.map_mpp(F.lit(s), dpi) for s in SCALES]
    rows = maps.withColumn("_mpp", geo.map_mpp(F.col("scale"), dpi))
    rows = rows.withColumns({"_best": geo.best_zoom(F.col("_mpp"), lat)} | {
        f"_z{i}": geo.best_zoom(value, lat) for i, value in enumerate(canonical)})
    mpp, best = F.col("_mpp"), F.col("_best")

    def config(zoom: Column, value: Column) -> Column:
        return F.struct(zoom.cast("int").alias("zoom"), value.cast("double").alias("mpp"))

    zooms = F.array_sort(
        F.array_distinct(F.array(best, F.greatest(F.lit(15), best - 1), F.least(F.lit(19), best + 1)))
    )
    known = F.concat(
        F.transform(zooms, lambda z: config(z, mpp)), F.array(*[config(best, mpp * s) for s in STRETCH])
    )
    fresh = []
    for i, value in enumerate(canonical):
        opened = F.lit(True)
        for earlier in range(i):
            opened = opened & (F.col(f"_z{earlier}") != F.col(f"_z{i}"))
        fresh.append(F.when(opened, config(F.col(f"_z{i}"), value)))
    modal = SCALES.index(MODAL_SCALE)
    unknown = F.concat(
        F.array_compact(F.array(*fresh)), F.array(*[config(F.col(f"_z{modal}"), canonical[modal] * s) for s in STRETCH])
    )
    chosen = F.when(F.col("scale").isNull(), unknown).otherwise(known)
    return rows.select(*maps.columns, F.posexplode(chosen).alias("pos", "_c")).select(
        *maps.columns, "pos", "_c.zoom", "_c.mpp"
    )


def _odd(n: Column) -> Column:
    return n + F.when(n % 2 == 0, 1).otherwise(0)


def tile_grids(configs: DataFrame) -> DataFrame:
    """Add ratio, the resized map size, tiles_x, tiles_y and the grid origin; infeasible rows go.

    Needs height, width (pixels of the map), lat, lon, sigma_m, zoom, mpp.
    """
    tile = geo.tile_mpp(F.col("lat"), F.col("zoom"))
    df = configs.withColumn("ratio", F.col("mpp") / tile)
    df = df.where(geo.resize_feasible(F.col("ratio"), F.col("height"), F.col("width")))
    margin = F.greatest(F.lit(MIN_MARGIN), F.ceil(F.col("sigma_m") / (256 * tile))).cast("int")
    df = df.withColumns({
        "map_h": (F.col("height") * F.col("ratio")).cast("int"),
        "map_w": (F.col("width") * F.col("ratio")).cast("int"),
        "margin": margin,
    })

    def tiles(size: str) -> Column:
        need = F.ceil(F.col(size) / 256).cast("int") + 2 * F.col("margin")
        return _odd(F.greatest(F.lit(GRID_LIMITS[0]), F.least(F.lit(GRID_LIMITS[1]), need)))

    df = df.withColumns({"tiles_x": tiles("map_w"), "tiles_y": tiles("map_h")})
    df = df.where((F.col("map_h") < F.col("tiles_y") * 256) & (F.col("map_w") < F.col("tiles_x") * 256))
    return df.withColumns({
        "tx_min": geo.tile_x(F.col("lon"), F.col("zoom")) - F.floor(F.col("tiles_x") / 2).cast("int"),
        "ty_min": geo.tile_y(F.col("lat"), F.col("zoom")) - F.floor(F.col("tiles_y") / 2).cast("int"),
    })


def grid_bounds(zoom: Column, tx: Column, ty: Column, nx: Column, ny: Column) -> Column:
    """Mercator box of a tile grid from its four edges."""
    first = geo.tile_bounds(zoom, tx, ty)
    return F.struct(
        first["xmin"].alias("xmin"), geo.tile_bounds(zoom, tx, ty + ny - 1)["ymin"].alias("ymin"),
        geo.tile_bounds(zoom, tx + nx - 1, ty)["xmax"].alias("xmax"), first["ymax"].alias("ymax"),
    )


def search_windows(grids: DataFrame) -> DataFrame:
    """One row per window: window_x, window_y on the canvas of each grid."""
    free_x = F.col("tiles_x") * 256 - F.col("map_w")
    free_y = F.col("tiles_y") * 256 - F.col("map_h")
    target = F.sqrt(F.greatest(F.lit(1), free_x * free_y) / WINDOW_TARGET).cast("int")

    def step(free: Column) -> Column:
        return F.greatest(F.lit(MIN_STRIDE), F.least(F.col("_target"), F.greatest(F.lit(1), free)))

    df = grids.withColumns({"_fx": free_x, "_fy": free_y, "_target": target})
    df = df.withColumn("window_y", F.explode(F.sequence(F.lit(0), F.col("_fy"), step(F.col("_fy")))))
    df = df.withColumn("window_x", F.explode(F.sequence(F.lit(0), F.col("_fx"), step(F.col("_fx")))))
    return df.drop("_fx", "_fy", "_target")


def tiles_of_grid(grids: DataFrame) -> DataFrame:
    """One row per tile of a grid: tile_x, tile_y and its Mercator bounds."""
    df = grids.withColumn("tile_x", F.explode(F.sequence(F.col("tx_min"), F.col("tx_min") + F.col("tiles_x") - 1)))
    df = df.withColumn("tile_y", F.explode(F.sequence(F.col("ty_min"), F.col("ty_min") + F.col("tiles_y") - 1)))
    return df.withColumn("bounds", geo.tile_bounds(F.col("zoom"), F.col("tile_x"), F.col("tile_y")))


def first_per_zoom(configs: DataFrame) -> DataFrame:
    order = Window.partitionBy("map_id", "zoom").orderBy("pos")
    return configs.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
