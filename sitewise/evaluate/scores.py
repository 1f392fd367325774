"""From per-page and per-case scores to the tables of a run."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import text as tx
from sitewise.operators.stats import value_summaries, value_summary

# Buckets of each document attribute and rate thresholds.
BUCKETS = {"colour": ("white", "yellow"), "quality": ("good", "bad"), "complexity": ("easy", "medium", "hard")}
RATES = (0.5, 0.7, 0.8, 0.9)
CHANGE_EPSILON = 1e-9
INFINITY = float("inf")


def pct(condition: Column) -> Column:
    """Share of rows in percent; NULL counts as no."""
    return F.avg(F.when(condition, 100.0).otherwise(0.0))


def honest(iou: Column) -> Column:
    """A missing score counts as 0."""
    return F.coalesce(iou, F.lit(0.0))


def missed(distance: Column) -> Column:
    """A missing distance counts as infinitely far."""
    return F.coalesce(distance, F.lit(INFINITY))


def worker_first(iou: str = "iou", err: str = "err_m") -> tuple[Column, Column]:
    """Score before the revision: the first one where it was kept, else the final one."""
    first = F.col("worker_first_iou")
    return (
        F.when(first.isNull(), F.col(iou)).otherwise(first),
        F.when(first.isNull(), F.col(err)).otherwise(F.col("worker_first_err_m")),
    )


def pages_to_cases(pages: DataFrame, values: Sequence[str], page: str = "page_id", extra: Sequence[Column] = ()) -> DataFrame:
    """case_id, n_pages and the mean of each value over the pages of a case.

    Means are rounded to nine decimals, so that a threshold does not hang on summing order.
    """
    return pages.groupBy(tx.page_case(F.col(page)).alias("case_id")).agg(
        F.count("*").alias("n_pages"), *[F.round(F.avg(v), 9).alias(v) for v in values], *extra
    )


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows with a value, the last per key by `order`."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max_by(value, F.struct(*order, value)).alias(value)
    )


def headline(
    cases: DataFrame, keys: Sequence[str] = (), iou: str = "iou", distance: str = "distance", span: str = "span",
    total: bool = False,
) -> DataFrame:
    """n_cases, pct_grt_0, mean_iou, median_iou, pct_grt_08, median_distance_m, acc_01d.

    Missing scores count as 0 and missing distances as infinitely far. With `total`, one more row with NULL
    keys holds all cases.
    """
    rows = cases.select(
        *keys, honest(F.col(iou)).alias("v"), missed(F.col(distance)).alias("d"), F.col(span).alias("s")
    )
    by = list(keys)
    if total and keys:
        rows = rows.withColumn("_total", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns(
            {k: F.when(~F.col("_total"), F.col(k)) for k in keys}
        )
        by = ["_total", *by]
    return value_summaries(
        rows, by, {"v": F.col("v"), "d": F.col("d")},
        [pct(F.col("v") > 0).alias("pct_grt_0"), pct(F.col("v") >= 0.8).alias("pct_grt_08"),
         pct(F.col("d") <= 0.1 * F.col("s")).alias("acc_01d")],
    ).select(*keys, F.col("v_n").alias("n_cases"), "pct_grt_0", F.col("v_mean").alias("mean_iou"),
             F.col("v_median").alias("median_iou"), "pct_grt_08", F.col("d_median").alias("median_distance_m"), "acc_01d")


def long_values(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """keys, metric, value rows of several measures."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), c.cast("double").alias("value")) for k, c in values.items()])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*")


def aggregate_stats(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """One row per measure: n, mean, median, std (population), min, max."""
    wide = value_summaries(df, [], values)
    names = ("n", "mean", "median", "std", "min", "max")
    lines = F.array(*[
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{s}").alias(s) for s in names]) for m in values
    ])
    return wide.select(F.explode(lines).alias("_l")).select("_l.*")


def run_summary(results: DataFrame) -> DataFrame:
    """One row: counts by outcome, and statistics per block.

    Crashed rows and rows without a polygon score 0 in the overall block; the second block holds
    produced polygons only.
    """
    crashed = F.col("status") == "crashed"
    produced = ~crashed & F.col("iou").isNotNull()
    values = {
        "iou": F.when(crashed, 0.0).otherwise(honest(F.col("iou"))),
        "ok_iou": F.when(produced, F.col("iou")),
        "ok_precision": F.when(produced, F.col("prec")),
        "ok_recall": F.when(produced, F.col("rec")),
        "ok_distance": F.when(produced, F.col("err_m")),
    }
    counts = [
        F.count("*").alias("total"), F.count_if(produced).alias("polygons_produced"),
        F.count_if(~crashed & F.col("iou").isNull()).alias("no_polygon"), F.count_if(crashed).alias("crashed"),
    ]
    names = ("n", "mean", "median", "std", "min", "max")
    return value_summaries(results, [], values, counts).select(
        "total", "polygons_produced", "no_polygon", "crashed",
        *[f"{m}_{s}" for m in values for s in names if (m, s) != ("iou", "n")],
    )


def fold_table(pages: DataFrame, values: Sequence[str]) -> DataFrame:
    """Per fold: n and mean of case means; then one row (fold NULL) with mean and std over folds."""
    cases = pages_to_cases(pages, values, extra=[F.max("fold").alias("fold")])
    folds = cases.groupBy("fold").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
    folds = folds.select("fold", "n", *values, *[F.lit(None).cast("double").alias(f"{v}_std") for v in values])
    over = folds.groupBy().agg(
        F.sum("n").alias("n"),
        *[F.coalesce(F.avg(v), F.lit(0.0)).alias(v) for v in values],
        *[F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"{v}_std") for v in values],
    )
    return folds.unionByName(over.withColumn("fold", F.lit(None).cast("int")))


def threshold_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, mean, upper median and the share of values from each rate on."""
    rates = [F.avg(F.when(F.col(value) >= r, 1.0).otherwise(0.0)).alias(f"ge_{int(r * 100)}") for r in RATES]
    present = df.where(F.col(value).isNotNull())
    return value_summary(present, keys, value, rates).select(
        *keys, "n", "mean", F.col("upper_median").alias("median"), *[f"ge_{int(r * 100)}" for r in RATES]
    )


def distance_summary(df: DataFrame, keys: Sequence[str], value_m: str) -> DataFrame:
    """keys, n, mean, upper median, min, max in km and the share below 500 m and 1 km."""
    rates = [pct(F.col(value_m) < 500).alias("pct_lt_500m"), pct(F.col(value_m) < 1000).alias("pct_lt_1km")]
    s = value_summary(df.where(F.col(value_m).isNotNull()), keys, value_m, rates)
    return s.select(
        *keys, "n", (F.col("mean") / 1000).alias("mean_km"), (F.col("upper_median") / 1000).alias("upper_median_km"),
        (F.col("min") / 1000).alias("min_km"), (F.col("max") / 1000).alias("max_km"),
        F.col("median").alias("median_m"), "pct_lt_500m", "pct_lt_1km",
    )


def method_comparison(pages: DataFrame) -> DataFrame:
    """method, n, mean, median, pct_ge_05, pct_ge_08 and the place by mean; place 1 wins.

    Rows without a score are left out, the last row of a page wins, pages become cases first.
    """
    last = last_rows(pages, ["method", "page_id"], ["s1", "s2", "s3", "s4"], "iou")
    cases = last.groupBy("method", tx.page_case(F.col("page_id")).alias("case_id")).agg(
        F.round(F.avg("iou"), 9).alias("iou")
    )
    stats = value_summary(
        cases, ["method"], "iou", [pct(F.col("iou") >= 0.5).alias("pct_ge_05"), pct(F.col("iou") >= 0.8).alias("pct_ge_08")]
    )
    place = F.row_number().over(Window.orderBy(F.desc(F.round("mean", 9)), "method"))
    return stats.select("method", "n", "mean", "median", "pct_ge_05", "pct_ge_08", place.alias("place"))


def revision_delta(cases: DataFrame) -> DataFrame:
    """One row: n_cases, n_changed, mean before and after the revision, and their difference."""
    before, _ = worker_first()
    rows = cases.select(honest(before).alias("b"), honest(F.col("iou")).alias("a"))
    return rows.agg(
        F.count("*").alias("n_cases"), F.count_if(F.abs(F.col("a") - F.col("b")) > CHANGE_EPSILON).alias("n_changed"),
        F.avg("b").alias("mean_before"), F.avg("a").alias("mean_after"),
    ).withColumn("delta", F.col("mean_after") - F.col("mean_before"))


def revised_cases(cases: DataFrame) -> DataFrame:
    before, _ = worker_first()
    rows = cases.select("case_id", honest(before).alias("before"), honest(F.col("iou")).alias("after"))
    return rows.where(F.abs(F.col("after") - F.col("before")) > CHANGE_EPSILON)


def run_rates(rows: DataFrame) -> DataFrame:
    """One row: n, honest mean, upper median and rates, valid and schema-failure percent."""
    values = rows.select(
        honest(F.col("iou")).alias("v"), F.col("valid_pred").alias("ok"), F.col("schema_failure").alias("bad")
    )
    s = value_summary(
        values, [], "v",
        [F.avg(F.when(F.col("v") >= r, 1.0).otherwise(0.0)).alias(f"ge_{int(r * 100)}") for r in (0.5, 0.8)]
        + [pct(F.col("ok")).alias("valid_rate"), pct(F.col("bad")).alias("schema_fail_rate")],
    )
    return s.select("n", "mean", F.col("upper_median").alias("median"), "ge_50", "ge_80", "valid_rate", "schema_fail_rate")


def attribute_breakdown(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """dimension, bucket, n, mean_iou, pct_ge_08, covered: the total and every attribute bucket.

    `covered` tells whether the buckets of the dimension hold every scored case. Cases are counted
    once at the finest grain; the breakdowns are taken from those few rows.
    """
    dims = list(BUCKETS)
    scored = labels.join(scores, "folder").select(
        *[tx.normalise_label(F.col(d)).alias(d) for d in dims], honest(F.col("iou")).alias("v")
    )
    fine = scored.groupBy(*dims).agg(
        F.count("*").alias("n"), F.sum("v").alias("s"), F.count_if(F.col("v") >= 0.8).alias("high")
    )
    cells = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("bucket")),
                    *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("bucket")) for d in dims])
    rows = fine.select("n", "s", "high", F.explode(cells).alias("_c")).select("_c.*", "n", "s", "high")
    table = rows.groupBy("dimension", "bucket").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("high").alias("high")
    )
    known = functools.reduce(
        lambda a, b: a | b, [(F.col("dimension") == d) & F.col("bucket").isin(*b) for d, b in BUCKETS.items()],
        F.col("dimension") == "total",
    )
    missing = F.sum(F.when(known, 0).otherwise(F.col("n"))).over(Window.partitionBy("dimension"))
    return table.withColumn("covered", missing == 0).where(known).select(
        "dimension", "bucket", "n", (F.col("s") / F.col("n")).alias("mean_iou"),
        (100.0 * F.col("high") / F.col("n")).alias("pct_ge_08"), "covered",
    )


def accuracy_split(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """split (overall, upright, rotated), n, n_correct, accuracy; overall counts every label."""
    joined = labels.join(predictions, "case_id", "left")
    hit = F.coalesce(F.col("pred") == F.col("truth"), F.lit(False))
    seen = F.col("pred").isNotNull()
    splits = F.array(
        F.struct(F.lit("overall").alias("split"), F.lit(True).alias("counted")),
        F.struct(F.when(F.col("truth") == 0, "upright").otherwise("rotated").alias("split"), seen.alias("counted")),
    )
    rows = joined.select(hit.alias("hit"), F.explode(splits).alias("_s")).where("_s.counted")
    return rows.groupBy("_s.split").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_correct")).withColumn(
        "accuracy", F.col("n_correct") / F.col("n")
    )


def error_auc(
    errors: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float], buckets: int = 1024
) -> DataFrame:
    """keys, threshold, auc: area under recall over error, from 0 to each threshold, divided by it.

    The i-th smallest of n errors has recall i/n, with trapezoids between neighbours. Equal values
    are counted first; the distinct ones are then ranked inside fixed value buckets, and only the
    bucket totals are accumulated per key, so no key is ever sorted as a whole.
    """
    by = list(keys) or ["_all"]
    top = float(max(thresholds))
    rows = errors if keys else errors.withColumn("_all", F.lit(0))
    bucket = F.least(F.floor(F.col(value) / F.lit(top / buckets)), F.lit(buckets)).cast("int")
    # Errors from the largest threshold on only add to the total.
    kept = F.when(F.col(value) < top, F.col(value))
    counts = rows.select(*by, bucket.alias("_b"), kept.alias("_v")).groupBy(*by, "_b", "_v").agg(F.count("*").alias("c"))
    sums = counts.groupBy(*by, "_b").agg(F.sum("c").alias("c"), F.max("_v").alias("m"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_b", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.max("m").over(earlier), F.lit(0.0)).alias("_prev"),
        F.sum("c").over(Window.partitionBy(*by)).alias("total"),
    )
    order = Window.partitionBy(*by, "_b").orderBy("_v")
    ranked = counts.join(offsets, [*by, "_b"]).withColumns({
        "upto": F.sum("c").over(order) + F.col("_before"), "prev": F.coalesce(F.lag("_v").over(order), F.col("_prev"))
    })
    # From the previous value the curve rises to the first equal error; further ones add no width.
    before = F.col("upto") - F.col("c")
    strip = (F.col("_v") - F.col("prev")) * (before + before + 1) / 2 / F.col("total")
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    below = F.col("_v") < F.col("threshold")
    areas = ranked.withColumn("strip", strip).withColumn("threshold", levels).groupBy(*by, "threshold").agg(
        F.coalesce(F.sum(F.when(below, F.col("strip"))), F.lit(0.0)).alias("area"),
        F.coalesce(F.max(F.when(below, F.col("_v"))), F.lit(0.0)).alias("last"),
        F.coalesce(F.max(F.when(below, F.col("upto") / F.col("total"))), F.lit(0.0)).alias("recall"),
    )
    tail = (F.col("threshold") - F.col("last")) * F.col("recall")
    return areas.select(*keys, "threshold", ((F.col("area") + tail) / F.col("threshold")).alias("auc"))


def distance_precision(errors: DataFrame, item: str, value: str, threshold: float) -> DataFrame:
    """One row: mean over items of the share of errors below the threshold; empty items count 0."""
    items = errors.groupBy(item).agg(
        F.coalesce(F.try_divide(F.count_if(F.col(value) < threshold), F.count(value)), F.lit(0.0)).alias("p")
    )
    return items.agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("precision"))


def last_of_identifier(rows: DataFrame, identifier: str, seq: str) -> DataFrame:
    """Rows of repeated identifiers: the last one stays."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(identifier).agg(F.max_by(row, F.col(seq)).alias("_r")).select("_r.*")


def fuse_views(views: DataFrame) -> DataFrame:
    """image_id, raw_class, confidence, rotation, abstained from class probabilities per view.

    `views` has image_id, view (quarter turns), cls, p. A class seen in a turned view belongs to
    the class that many turns further; below one half the answer is no rotation.
    """
    aligned = F.pmod(F.col("cls") + F.col("view"), F.lit(4))
    fused = views.groupBy("image_id", aligned.alias("cls")).agg((F.sum("p") / 4).alias("p"))
    # Rounded so that the larger of two equal sums does not hang on summing order.
    best = fused.groupBy("image_id").agg(
        F.max_by(F.struct("cls", "p"), F.struct(F.round("p", 9).alias("p"), (-F.col("cls")).alias("c"))).alias("b")
    )
    sure = F.round(F.col("b.p"), 9) >= 0.5
    return best.select(
        "image_id", F.col("b.cls").alias("raw_class"), F.col("b.p").alias("confidence"),
        F.when(sure, F.col("b.cls") * 90).otherwise(0).alias("rotation"), (~sure).alias("abstained"),
    )
