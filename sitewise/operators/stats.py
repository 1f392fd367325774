"""Order statistics and running totals that never put one whole group into one task."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The approximate pass is off by at most 1/ACCURACY of the rows; the band is wider than that. A group of
# fewer than 1/BAND rows takes all its values as the band.
ACCURACY = 10_000
BAND = 2.5e-4
# Parts into which a round of refinement cuts the range of values that is still open.
PARTS = 1024
STATS = ("n", "mean", "std", "min", "max", "median", "upper_median")


def _holds(first: Column, end: Column, n: Column) -> tuple[Column, Column]:
    """Whether the lower and the upper middle rank of n lie in [first, end)."""
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    return (first <= low) & (low < end), (first <= high) & (high < end)


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool, how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL; the other columns of both sides must differ in name."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(F.broadcast(named) if small else named, on, how).drop(*[f"_r_{k}" for k in keys])


def _middles(placed: DataFrame, by: list[str], n_values: int, rounds: int, small: bool) -> DataFrame:
    """by, _low<i>, _high<i>: the values at both middle ranks of every metric, from counted values.

    Each round sums the counts of at most PARTS equal parts of the open range, which fixes the part that
    holds a middle rank and the rows before it; only the values in that part go on.
    """
    cell = [*by, "_metric", "_cell"]
    rest = placed.withColumns({"_cell": F.lit(0).cast("bigint"), "_base": F.lit(0).cast("bigint")})
    for _ in range(rounds):
        share = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        inside = F.when(F.col("_v") == F.col("_hi"), PARTS - 1).otherwise(
            F.least(F.coalesce(F.floor(share * PARTS), F.lit(0)), F.lit(PARTS - 1))
        )
        rest = rest.withColumn(
            "_part", F.when(F.col("_side") == 0, inside).otherwise(F.col("_side") * (2 * PARTS)).cast("bigint")
        )
        sums = rest.groupBy(*cell, "_base", "_n", "_part").agg(
            F.sum("_c").alias("_size"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
        )
        upto = F.col("_base") + F.sum("_size").over(Window.partitionBy(*cell).orderBy("_part"))
        ends = sums.withColumn("_end", upto)
        low, high = _holds(F.col("_end") - F.col("_size"), F.col("_end"), F.col("_n"))
        chosen = ends.where(low | high).select(
            *cell, "_part", (F.col("_end") - F.col("_size")).alias("_start"), "_min", "_max"
        )
        rest = _same_keys(rest, chosen, [*cell, "_part"], small).select(
            *by, "_metric", "_side", "_v", "_c", "_n", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"),
            (F.col("_cell") * (4 * PARTS + 1) + F.col("_part")).alias("_cell"), F.col("_start").alias("_base"),
        )
    end = F.col("_base") + F.sum("_c").over(Window.partitionBy(*cell).orderBy("_v"))
    ranked = rest.withColumn("_end", end)
    low, high = _holds(F.col("_end") - F.col("_c"), F.col("_end"), F.col("_n"))
    return ranked.groupBy(*by).agg(*[
        F.max(F.when((F.col("_metric") == i) & here, F.col("_v"))).alias(f"{name}{i}")
        for i in range(n_values) for name, here in (("_low", low), ("_high", high))
    ])


def value_summaries(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], extra: Sequence[Column] = (), rounds: int = 1
) -> DataFrame:
    """keys, <name>_<stat> for every value and each of STATS, and the `extra` aggregates: one row per key.

    Values are taken as doubles and the medians are exact. The rows are scanned twice, for all values
    together: an aggregate with an approximate quantile of bounded size brackets each middle, then rows below
    and above the bracket and the distinct values in it are counted. Those counts are refined in `rounds`
    rounds of PARTS equal parts, and a sort sees the distinct values of one part. Parts are equal in range, not
    in rows: values that crowd in one part, or a bracket that ends at infinity, call for more rounds. NULL values are
    left out (a key without any has n 0 and NULL statistics), a NULL key is a key, infinity and NaN are the
    largest values; an empty table gives no row, or one with n 0 if there are no keys.
    """
    by = list(keys) or ["_all"]
    named = {f"_m{i}": c.cast("double") for i, c in enumerate(values.values())}
    rows = df.withColumns(named if keys else named | {"_all": F.lit(0)})
    aggregates = [*extra]
    for i, name in enumerate(values):
        c = f"_m{i}"
        band = F.percentile_approx(c, [0.5 - BAND, 0.5 + BAND], ACCURACY)
        whole = F.array(F.min(c), F.max(c))
        aggregates += [
            F.count(c).alias(f"{name}_n"), F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"),
            F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"),
            F.when(F.count(c) * BAND < 1, whole).otherwise(band).alias(f"_band{i}"),
        ]
    first = rows.groupBy(*by).agg(*aggregates) if keys else rows.agg(F.lit(0).alias("_all"), *aggregates)
    bands = first.select(*by, F.array(*[
        F.struct(F.col(f"_band{i}")[0].alias("_lo"), F.col(f"_band{i}")[1].alias("_hi"), F.col(f"{name}_n").alias("_n"))
        for i, name in enumerate(values)
    ]).alias("_bands"))

    def place(i: int) -> Column:
        v, b = F.col(f"_m{i}"), F.col("_bands")[i]
        side = F.when(v < b["_lo"], -1).when(v > b["_hi"], 1).when(v.isNotNull(), 0)
        return F.struct(
            F.lit(i).alias("_metric"), side.alias("_side"), F.when(side == 0, v).alias("_v"),
            b["_lo"].alias("_lo"), b["_hi"].alias("_hi"), b["_n"].alias("_n"),
        )

    counted = ["_metric", "_side", "_v", "_lo", "_hi", "_n"]
    placed = (
        _same_keys(rows.select(*by, *named), bands, by, not keys)
        .select(*by, F.explode(F.array(*[place(i) for i in range(len(values))])).alias("_p"))
        .select(*by, "_p.*").where(F.col("_side").isNotNull())
        .groupBy(*by, *counted).agg(F.count("*").alias("_c"))
    )
    middles = _middles(placed, by, len(values), rounds, not keys)
    out = _same_keys(first, middles, by, not keys, "left")
    for i, name in enumerate(values):
        out = out.withColumns({
            f"{name}_median": (F.col(f"_low{i}") + F.col(f"_high{i}")) / 2, f"{name}_upper_median": F.col(f"_high{i}")
        })
    helpers = [f"{h}{i}" for h in ("_band", "_low", "_high") for i in range(len(values))]
    return out.drop("_all", *helpers)


def value_summary(df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = ()) -> DataFrame:
    """STATS of `value` per key, plus `extra` aggregates; see value_summaries."""
    table = value_summaries(df, keys, {"_value": F.col(value)}, extra)
    return table.withColumnsRenamed({f"_value_{s}": s for s in STATS})


def bucketed_rank(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], bucket: Column, name: str = "rank"
) -> DataFrame:
    """row_number per partition as BIGINT, in two levels.

    `bucket` must grow with the order, e.g. a key prefix or a value divided by a step: rows are
    ranked inside their bucket and the sizes of the earlier buckets are added, so a hot partition
    is spread over as many tasks as it has buckets.
    """
    rows = df.withColumn("_bucket", bucket)
    by = [*partition_by, "_bucket"]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(
        Window.partitionBy(*partition_by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(*by, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))
    ranked = rows.withColumn("_inside", inside).join(offsets, by)
    return ranked.withColumn(name, F.col("_inside").cast("bigint") + F.col("_before")).drop(
        "_bucket", "_inside", "_before"
    )


def running_totals(
    df: DataFrame, partition_by: Sequence[str], order_by: str, totals: dict[str, Column], step: int = 1 << 16
) -> DataFrame:
    """Cumulative sums (row included) along a unique integer order column, in two levels."""
    rows = df.withColumns({f"_v_{k}": c for k, c in totals.items()}).withColumn(
        "_bucket", F.floor(F.col(order_by) / step)
    )
    by = [*partition_by, "_bucket"]
    sums = rows.groupBy(*by).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in totals])
    earlier = Window.partitionBy(*partition_by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in totals])
    inside = Window.partitionBy(*by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_i_{k}": F.sum(f"_v_{k}").over(inside) for k in totals}).join(offsets, by)
    out = rows.withColumns({k: F.col(f"_i_{k}") + F.col(f"_o_{k}") for k in totals})
    return out.drop("_bucket", *[f"_{p}_{k}" for k in totals for p in "vio"])
