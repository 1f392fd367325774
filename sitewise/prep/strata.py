"""Stratified subset: allocation with a floor, and a reproducible draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import text as tx


def clean_cases(labels: DataFrame) -> DataFrame:
    """folder, stratum of the well traced cases."""
    return labels.where(tx.well_traced(F.col("shape_matches"))).select(
        F.trim("folder").alias("folder"), tx.stratum(F.col("quality"), F.col("complexity")).alias("stratum")
    )


def populations(clean: DataFrame) -> DataFrame:
    return clean.groupBy("stratum").agg(F.count("*").alias("population"))


def allocate(pops: DataFrame, n_total: int, floor: int = 2) -> DataFrame:
    """stratum, population, alloc: a floor each, the rest in proportion, remainders by size then name.

    Raises in the plan if the total cannot be met. Works on one row per stratum.
    """
    every = Window.partitionBy("_all")
    rows = pops.withColumn("_all", F.lit(0)).withColumn("base", F.least(F.lit(floor), F.col("population")))
    rows = rows.withColumns({
        "used": F.sum("base").over(every), "people": F.sum("population").over(every),
        "cap": F.col("population") - F.col("base"),
    })
    fits = (F.col("people") >= n_total) & (F.col("used") <= n_total)
    rows = rows.withColumn(
        "used", F.when(fits, F.col("used")).otherwise(F.raise_error(F.lit("the subset size does not fit the strata")))
    )
    share = F.try_divide(F.col("cap"), F.sum("cap").over(every))
    rows = rows.withColumn("raw", F.coalesce((n_total - F.col("used")) * share, F.lit(0.0)))
    rows = rows.withColumn("alloc", F.col("base") + F.least(F.floor("raw"), F.col("cap")))
    rows = rows.withColumn("left", n_total - F.sum("alloc").over(every))
    room = F.col("alloc") < F.col("population")
    place = F.row_number().over(
        Window.partitionBy("_all", "_room").orderBy(F.desc(F.col("raw") - F.floor("raw")), "stratum")
    )
    rows = rows.withColumn("_room", room).withColumn("_place", place)
    top_up = F.when(room & (F.col("_place") <= F.col("left")), 1).otherwise(0)
    return rows.select("stratum", "population", (F.col("alloc") + top_up).cast("bigint").alias("alloc"))


def draw_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key))


def sample(clean: DataFrame, alloc: DataFrame, seed: int, at_most: int) -> DataFrame:
    """folder, stratum: per stratum the `alloc` first folders in hash order.

    No stratum gets more than the subset size `at_most`, so that constant cuts each stratum before
    the shuffle and the exact allocation cuts what is left.
    """
    order = Window.partitionBy("stratum").orderBy(draw_key(seed, F.col("folder")), "folder")
    top = clean.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= at_most)
    return top.join(alloc.select("stratum", "alloc"), "stratum").where("rn <= alloc").select("folder", "stratum")


def subset_document(subset: DataFrame, config: dict[str, str]) -> DataFrame:
    """One JSON text: the provenance block and the chosen cases (a subset is small by design)."""
    cases = F.array_sort(F.collect_list(F.struct("folder", "stratum"))).alias("cases")
    block = F.create_map(*[F.lit(x) for kv in config.items() for x in kv]).alias("config")
    return subset.agg(cases).select(F.to_json(F.struct(block, "cases")).alias("value"))
