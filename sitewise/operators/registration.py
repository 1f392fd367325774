"""Robust similarity fit of point pairs, per match and without any large group in one task.

Two-point models are drawn by hash, so that a rerun draws the same, in rounds that grow: a match
stays open until its models are as many as the inlier share found so far asks for, up to
MAX_MODELS or all its pairs of points. Matches of at most PART points are dealt and sorted once
and tried in Arrow batches, many at a time. For larger ones inliers per model are a plain count with
partial sums, and the final least-squares fit over the inliers of the best model is a closed form of sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions import geo
from sitewise.operators.stats import bucketed_rank
from sitewise.session import checkpoint_dir

THRESHOLD_PX = 10.0
MIN_POINTS = 4
MAX_MODELS = 2000
ROUNDS = (16, 48, 192, 512, 1232)  # models per round, MAX_MODELS in all
CONFIDENCE = 0.999
PART = 1024  # points of a match that are tried together; a match of many points is many parts
TASK_POINTS = 250_000  # points in one task; tasks are as many as all points ask for
SLAB = 1 << 16  # residuals held at a time, unless one model has more
SEED = 42
MODEL = ("a", "b", "tx", "ty")


def _pair(n: Column, pairs: Column, model: Column, seed: int, max_models: int) -> tuple[Column, Column]:
    """Ranks (from 0) of a model's two points: every pair once where there are few, else two drawn ones."""
    # Pairs in order (0,1) (0,2) (1,2) (0,3) ...: the later rank is the root of the pair's number.
    root = F.floor((F.sqrt(8.0 * model + 1) + 1) / 2)
    each = model - F.floor(root * (root - 1) / 2)
    first = F.pmod(F.xxhash64(F.lit(seed), "match_id", model, F.lit(0)), n)
    step = F.pmod(F.xxhash64(F.lit(seed), "match_id", model, F.lit(1)), n - 1) + 1
    all_of_them = pairs <= max_models
    return F.when(all_of_them, each).otherwise(first), F.when(all_of_them, root).otherwise((first + step) % n)


def _models(ranked: DataFrame, asked: DataFrame, seed: int, max_models: int) -> DataFrame:
    """match_id, model, n_points, a, b, tx, ty: x' = a x - b y + tx, y' = b x + a y + ty.

    ranked: points with _rank; asked: match_id, n_points, pairs, model.
    """
    p, q = _pair(F.col("n_points"), F.col("pairs"), F.col("model"), seed, max_models)
    ranks = asked.withColumns({"_p": p, "_q": q})
    one = F.struct("x0", "y0", "x1", "y1")
    for side in ("p", "q"):
        points = ranked.select("match_id", F.col("_rank").alias(f"_{side}"), one.alias(side))
        ranks = ranks.join(points, ["match_id", f"_{side}"])
    ux, uy = F.col("q.x0") - F.col("p.x0"), F.col("q.y0") - F.col("p.y0")
    vx, vy = F.col("q.x1") - F.col("p.x1"), F.col("q.y1") - F.col("p.y1")
    norm = ux * ux + uy * uy
    a, b = F.try_divide(ux * vx + uy * vy, norm), F.try_divide(ux * vy - uy * vx, norm)
    fitted = ranks.select("match_id", "model", "n_points", "p", a.alias("a"), b.alias("b")).where("a IS NOT NULL AND (a <> 0 OR b <> 0)")
    return fitted.select(
        "match_id", "model", "n_points", "a", "b",
        (F.col("p.x1") - F.col("a") * F.col("p.x0") + F.col("b") * F.col("p.y0")).alias("tx"),
        (F.col("p.y1") - F.col("b") * F.col("p.x0") - F.col("a") * F.col("p.y0")).alias("ty"),
    )


def _tasks(spark: SparkSession, points: int) -> int:
    """Tasks for so many points, so that what one of them holds doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points // TASK_POINTS))


def _best_models(points: DataFrame, sizes: DataFrame, tasks: int, limit: Column, seed: int, rounds: Sequence[int]) -> DataFrame:
    """match_id and the model with most inliers; ties go to the one drawn first."""
    checkpoint_dir(points.sparkSession)
    draw = F.xxhash64(F.lit(seed), "match_id", "idx")
    usable = points.join(sizes.select("match_id"), "match_id", "left_semi").withColumn("_draw", draw)
    usable = usable.withColumn("_bucket", F.shiftright("_draw", 58)).repartition(tasks, "match_id", "_bucket")
    ranked = bucketed_rank(usable, ["match_id"], [F.col("_draw"), F.col("idx")], F.col("_bucket"), "_rank")
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1).withColumn("_part", F.floor(F.col("_rank") / PART)).drop("_draw")
    # Points times models is far more work than the points' bytes tell, so their spread is set here.
    ranked = ranked.repartition(tasks, "match_id", "_part").checkpoint()
    max_models, done = sum(rounds), 0
    pairs = F.floor(F.col("n_points") * (F.col("n_points") - 1) / 2)
    best = sizes.select("match_id", "n_points", pairs.alias("pairs"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(
        "struct<a:double,b:double,tx:double,ty:double>").alias("_m"))
    for size in rounds:
        share = F.col("n") / F.col("n_points")
        needed = F.when(share >= 1, 1.0).when(share > 0, F.log(F.lit(1 - CONFIDENCE)) / F.log1p(-share * share))
        needed = F.least(F.coalesce(needed, F.lit(float(max_models))), F.col("pairs"))
        open_ = best.where(needed > done)
        if done and open_.isEmpty():
            break
        number = F.explode(F.sequence(F.lit(done), F.lit(done + size - 1)).cast("array<bigint>")).alias("model")
        drawn = open_.select("match_id", "n_points", "pairs", number)
        # Where all pairs are taken there are no more models than pairs.
        models = _models(ranked, drawn.where((F.col("pairs") > max_models) | (F.col("model") < F.col("pairs"))), seed, max_models)
        parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_points") - 1) / PART))).alias("_part")
        models = models.select("*", parts)
        votes = ranked.join(models, ["match_id", "_part"]).where(_residual2("") <= limit).groupBy("match_id", "model").agg(
            F.count("*").alias("n"), *[F.first(c).alias(c) for c in MODEL]
        )
        found = votes.groupBy("match_id").agg(
            F.max("n").alias("_n"), F.max_by(F.struct(*MODEL), F.struct("n", (-F.col("model")).alias("m"))).alias("_found")
        )
        better = F.coalesce(F.col("_n") > F.col("n"), F.lit(False))
        best = best.join(found, "match_id", "left").select(
            "match_id", "n_points", "pairs", F.when(better, F.col("_n")).otherwise(F.col("n")).alias("n"),
            F.when(better, F.col("_found")).otherwise(F.col("_m")).alias("_m"),
        ).checkpoint()
        done += size
    return best.where("_m IS NOT NULL").select("match_id", "_m.*")


def _residual2(m: str) -> Column:
    a, b, tx, ty = (F.col(f"{m}{c}") for c in ("a", "b", "tx", "ty"))
    ex = a * F.col("x0") - b * F.col("y0") + tx - F.col("x1")
    ey = b * F.col("x0") + a * F.col("y0") + ty - F.col("y1")
    return ex * ex + ey * ey


def fit_similarity(
    points: DataFrame, threshold: float = THRESHOLD_PX, seed: int = SEED, rounds: Sequence[int] = ROUNDS
) -> DataFrame:
    """match_id, a00..a12, n_inliers, n_points; `points` has match_id, idx, x0, y0, x1, y1.

    Matches with fewer than four points, or without a usable model, give no row. Matches are counted first,
    which sets the number of tasks and tells whether any has more than PART points.
    """
    points = points.where("match_id IS NOT NULL").select("match_id", "idx", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    sizes = points.groupBy("match_id").agg(F.count("*").alias("n_points"))
    # Points of matches too small to fit are dealt with the others, so they count too.
    n, is_large = F.col("n_points"), F.col("n_points") > max(PART, MIN_POINTS - 1)
    in_whole, in_large = (c or 0 for c in sizes.agg(F.sum(F.when(~is_large, n)), F.sum(F.when(is_large, n))).first())
    spark = points.sparkSession
    if not in_large:
        return _fit_whole(points, _tasks(spark, in_whole), threshold, seed, rounds)
    large = sizes.where(is_large)
    whole = _fit_whole(points.join(large, "match_id", "left_anti"), _tasks(spark, in_whole), threshold, seed, rounds)
    return whole.unionByName(_fit_parts(points, large, _tasks(spark, in_large), threshold, seed, rounds))


def _votes(xy: np.ndarray, model: np.ndarray, limit: float) -> np.ndarray:
    """Inliers (matches x models) of xy (4 x matches x points) under model (4 x matches x models)."""
    _, matches, models = model.shape
    points = xy.shape[2]
    across, down = max(1, min(models, SLAB // points)), max(1, SLAB // (models * points))
    out = np.zeros((matches, models), np.int64)
    for i in range(0, matches, down):
        x0, y0, x1, y1 = xy[:, i : i + down, None, :]
        for j in range(0, models, across):
            a, b, tx, ty = model[:, i : i + down, j : j + across, None]
            ex, ey = a * x0 - b * y0 + tx - x1, b * x0 + a * y0 + ty - y1
            out[i : i + down, j : j + across] = (ex * ex + ey * ey <= limit).sum(axis=2)
    return out


def _draws(keys: np.ndarray, models: range, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of both points of each match's models: the draws of _pair, keys being xxhash64(seed, match_id)."""
    signed = np.empty((2, len(keys), len(models)), np.int64)
    for i, key in enumerate(keys.astype(np.uint64).tolist()):
        made = [xxhash.xxh64_intdigest(m.to_bytes(8, "little"), key) for m in models]
        for last in range(2):
            tail = last.to_bytes(4, "little")
            signed[last, i] = np.array([xxhash.xxh64_intdigest(tail, h) for h in made], np.uint64).view(np.int64)
    first = signed[0] % n
    return first, (first + signed[1] % (n - 1) + 1) % n


def _fit_alike(xy: np.ndarray, keys: np.ndarray, limit: float, rounds: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b, tx, ty as 4 x matches, inliers per match) of matches of one size: xy is 4 x matches x points in rank order."""
    _, matches, n = xy.shape
    pairs, max_models, done = n * (n - 1) // 2, sum(rounds), 0
    best, model = np.zeros(matches, np.int64), np.full((4, matches), np.nan)
    for size in rounds:
        share = best / n
        needed = np.where(share > 0, np.log(1 - CONFIDENCE) / np.log1p(-np.where((share > 0) & (share < 1), share, 0.5) ** 2), max_models)
        needed = np.minimum(np.where(share >= 1, 1.0, needed), pairs)
        at = np.flatnonzero(needed > done)
        numbers = range(done, min(done + size, pairs) if pairs <= max_models else done + size)
        if not len(at) or not len(numbers):
            break
        if pairs <= max_models:
            m = np.array(numbers)
            q = np.floor((np.sqrt(8.0 * m + 1) + 1) / 2).astype(np.int64)
            p, q = (np.broadcast_to(r, (len(at), len(m))) for r in (m - q * (q - 1) // 2, q))
        else:
            p, q = _draws(keys[at], numbers, n)
        (px, py, pu, pv), (qx, qy, qu, qv) = ([np.take_along_axis(c, r, axis=1) for c in xy[:, at]] for r in (p, q))
        ux, uy, vx, vy = qx - px, qy - py, qu - pu, qv - pv
        norm = ux * ux + uy * uy
        a, b = (ux * vx + uy * vy) / norm, (ux * vy - uy * vx) / norm
        a[(norm == 0) | ((a == 0) & (b == 0))] = np.nan  # no model, so no inliers
        drawn = np.array([a, b, pu - a * px + b * py, pv - b * px - a * py])
        votes = _votes(xy[:, at], drawn, limit)
        top = votes.argmax(axis=1)  # of equal models the first
        n_top, each = votes[np.arange(len(at)), top], np.arange(len(at))
        better = n_top > best[at]
        best[at[better]] = n_top[better]
        model[:, at[better]] = drawn[:, each[better], top[better]]
        done += size
    return model, best


def _refit(xy: np.ndarray, model: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Least squares (a, b, tx, ty as 4 x matches) over the inliers of each match's model, and their number."""
    a, b, tx, ty = model[:, :, None]
    x0, y0, x1, y1 = xy
    ex, ey = a * x0 - b * y0 + tx - x1, b * x0 + a * y0 + ty - y1
    near = ex * ex + ey * ey <= limit
    count = near.sum(axis=1)
    means = np.where(near, xy, 0).sum(axis=2) / count
    dx, dy, du, dv = np.where(near, xy - means[:, :, None], 0)
    var = (dx * dx + dy * dy).sum(axis=1)
    var[var == 0] = np.nan
    a, b = (dx * du + dy * dv).sum(axis=1) / var, (dx * dv - dy * du).sum(axis=1) / var
    return np.array([a, b, means[2] - a * means[0] + b * means[1], means[3] - b * means[0] - a * means[1]]), count


def _fit_whole(points: DataFrame, tasks: int, threshold: float, seed: int, rounds: Sequence[int]) -> DataFrame:
    """fit_similarity of matches of at most PART points: one shuffle and one sort."""
    limit = threshold * threshold

    def fit(ids: pa.Array, keys: np.ndarray, xy: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        lengths = ends - starts
        for n in np.unique(lengths[lengths >= MIN_POINTS]).tolist():
            first = starts[lengths == n]
            alike = xy[:, first[:, None] + np.arange(n)]
            with np.errstate(all="ignore"):
                model, best = _fit_alike(alike, keys[first], limit, rounds)
                (a, b, tx, ty), count = _refit(alike, model, limit)
            ok = np.flatnonzero((best > 0) & ~np.isnan(a) & ~np.isnan(b))
            columns = [a, -b, tx, b, a, ty, count]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first[ok])), *[pa.array(c[ok]) for c in columns], pa.array(np.full(len(ok), n))],
                ["match_id", "a00", "a01", "a02", "a10", "a11", "a12", "n_inliers", "n_points"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            yield from some(now, cut := last(now))
            held = now.slice(cut)
        if held is not None:
            yield from some(held, held.num_rows)

    def bounds(ids: pa.Array) -> np.ndarray:
        """Places where a match begins."""
        new = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        return np.append(0, np.flatnonzero(new) + 1)

    def last(table: pa.Table) -> int:
        return int(bounds(table["match_id"].combine_chunks())[-1])

    def some(table: pa.Table, upto: int) -> Iterator[pa.RecordBatch]:
        if upto:
            part = table.slice(0, upto)
            ids = part["match_id"].combine_chunks()
            starts = bounds(ids)
            xy = np.array([part[c].to_numpy() for c in ("x0", "y0", "x1", "y1")], np.float64)
            yield from fit(ids, part["_key"].to_numpy(), xy, starts, np.append(starts[1:], upto))

    dealt = points.repartition(tasks, "match_id")
    dealt = dealt.withColumns({"_key": F.xxhash64(F.lit(seed), "match_id"), "_draw": F.xxhash64(F.lit(seed), "match_id", "idx")})
    ranked = dealt.sortWithinPartitions("match_id", "_draw", "idx").select("match_id", "_key", "x0", "y0", "x1", "y1")
    id_type = points.schema["match_id"].dataType.simpleString()
    doubles = ", ".join(f"{c} double" for c in AFFINE)
    return ranked.mapInArrow(run, f"match_id {id_type}, {doubles}, n_inliers long, n_points long")


def _fit_parts(points: DataFrame, sizes: DataFrame, tasks: int, threshold: float, seed: int, rounds: Sequence[int]) -> DataFrame:
    """fit_similarity of the matches of `sizes` (match_id, n_points), none of them in one task."""
    limit = F.lit(threshold * threshold)
    best = _best_models(points, sizes, tasks, limit, seed, rounds)
    inliers = points.join(best, "match_id").where(_residual2("") <= limit)
    sums = inliers.groupBy("match_id").agg(
        F.count("*").alias("n_inliers"),
        *[F.avg(c).alias(f"m_{c}") for c in ("x0", "y0", "x1", "y1")],
        F.avg(F.col("x0") * F.col("x0") + F.col("y0") * F.col("y0")).alias("s00"),
        F.avg(F.col("x0") * F.col("x1") + F.col("y0") * F.col("y1")).alias("sdot"),
        F.avg(F.col("x0") * F.col("y1") - F.col("y0") * F.col("x1")).alias("scross"),
    )
    mx0, my0, mx1, my1 = (F.col(f"m_{c}") for c in ("x0", "y0", "x1", "y1"))
    var = F.col("s00") - mx0 * mx0 - my0 * my0
    a = F.try_divide(F.col("sdot") - mx0 * mx1 - my0 * my1, var)
    b = F.try_divide(F.col("scross") - mx0 * my1 + my0 * mx1, var)
    fitted = sums.withColumns({"_a": a, "_b": b}).where("_a IS NOT NULL")
    return fitted.join(sizes, "match_id").select(
        "match_id",
        F.col("_a").alias("a00"), (-F.col("_b")).alias("a01"), (mx1 - F.col("_a") * mx0 + F.col("_b") * my0).alias("a02"),
        F.col("_b").alias("a10"), F.col("_a").alias("a11"), (my1 - F.col("_b") * mx0 - F.col("_a") * my0).alias("a12"),
        "n_inliers", "n_points",
    )


AFFINE = ["a00", "a01", "a02", "a10", "a11", "a12"]


def candidate_rows(fits: DataFrame, windows: DataFrame, min_inliers: int = 5) -> DataFrame:
    """Fits that pass the gate, with the map-to-canvas affine, its centre and mean scale.

    `windows` has match_id, window_x, window_y, ratio, height, width, zoom, tx_min, ty_min.
    """
    kept = fits.where(F.col("n_inliers") >= min_inliers).join(windows, "match_id")
    raw = [F.col(c) for c in AFFINE]
    kept = kept.withColumn("avg_scale", geo.affine_scale(raw))
    whole = geo.affine_window(raw, F.col("window_x"), F.col("window_y"), F.col("ratio"))
    kept = kept.withColumns(dict(zip(AFFINE, whole)))
    cx, cy = geo.affine_apply([F.col(c) for c in AFFINE], F.col("width") / 2, F.col("height") / 2)
    return kept.withColumns({
        "center_lat": geo.pixel_lat(cy, F.col("zoom"), F.col("ty_min")),
        "center_lon": geo.pixel_lon(cx, F.col("zoom"), F.col("tx_min")),
    })


def inliers_of(points: DataFrame, fits: DataFrame, threshold: float = THRESHOLD_PX) -> DataFrame:
    """match_id, x, y: source points that the fitted affine maps within the threshold."""
    joined = points.join(fits.select("match_id", *AFFINE), "match_id")
    ex, ey = geo.affine_apply([F.col(c) for c in AFFINE], F.col("x0"), F.col("y0"))
    near = F.pow(ex - F.col("x1"), 2) + F.pow(ey - F.col("y1"), 2) <= threshold * threshold
    return joined.where(near).select("match_id", F.col("x0").alias("x"), F.col("y0").alias("y"))
