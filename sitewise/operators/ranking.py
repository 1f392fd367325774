"""Ranking, verification and commit of competing match attempts.

Every choice of one row per group is an aggregate (max_by / min_by), which combines on the map
side; every top-k is a row_number cut, which Spark also applies before the shuffle. A case that
holds a large share of all attempts therefore reaches the next stage as a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import geo
from sitewise.functions import text as tx
from sitewise.operators.stats import running_totals

TOP_BUCKETS = 5
TOP_REVIEW = 3
ATTEMPT_BUDGET = 5
RETRY_BUDGET = 2
PICK_RADIUS_M = 100.0
PICK_LIMIT_KM = 5.0
CONSENSUS_M = 500.0
MIN_INLIERS = 5


def _pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by `order` (ascending)."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r"))
    return best.select("_r.*")


def usable_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("has_valid_affine") & (F.col("n_inliers") >= MIN_INLIERS))


def best_per_bucket(attempts: DataFrame) -> DataFrame:
    """Best attempt per case, centre and zoom; on equal metric the earlier one stays.

    `first_seq` is the place of the bucket, i.e. its first attempt.
    """
    keys = ["case_id", "center", "zoom"]
    row = F.struct(*[F.col(c) for c in attempts.columns])
    best = attempts.groupBy(*keys).agg(
        F.min_by(row, F.struct((-F.col("n_inliers")).alias("m"), "seq")).alias("_r"), F.min("seq").alias("first_seq")
    )
    return best.select("_r.*", "first_seq")


def top_buckets(best: DataFrame, k: int = TOP_BUCKETS) -> DataFrame:
    """The k best buckets per case, then `score` = metric x quadrants / 4 and its rank.

    Equal metrics keep the order in which the buckets were opened.
    """
    by_metric = Window.partitionBy("case_id").orderBy(F.desc("n_inliers"), "first_seq")
    top = best.withColumn("metric_rank", F.row_number().over(by_metric)).where(F.col("metric_rank") <= k)
    covered = F.when(F.col("quadrants") < 0, 4).otherwise(F.col("quadrants"))
    scored = top.withColumn("score", F.col("n_inliers") * (covered / 4.0))
    by_score = Window.partitionBy("case_id").orderBy(F.desc("score"), "metric_rank")
    return scored.withColumn("score_rank", F.row_number().over(by_score))


def road_boost(ranked: DataFrame) -> DataFrame:
    """Winner per case after score x (1 + matched/total)^2; neutral without roads nearby.

    `ranked` carries n_road_matched, n_roads and roads_present; `overridden` tells a changed winner.
    """
    has_signal = (F.col("n_roads") > 0) & F.col("roads_present")
    ratio = F.coalesce(F.try_divide(F.col("n_road_matched"), F.col("n_roads")), F.lit(0.0))
    boost = F.when(has_signal, F.pow(1 + ratio, F.lit(2.0))).otherwise(F.lit(1.0))
    boosted = ranked.withColumn("boosted", F.col("score") * boost)
    winner = _pick(boosted, ["case_id"], [-F.col("boosted"), F.col("score_rank")])
    return winner.withColumn("overridden", F.col("score_rank") != 1)


def road_agreement(n_matched: Column, n_total: Column, roads_present: Column) -> Column:
    """Share of the named roads found; 0.5 where there is nothing to test."""
    neutral = (n_total == 0) | ~roads_present
    return F.when(neutral, F.lit(0.5)).otherwise(F.try_divide(n_matched, n_total))


def road_verdict(n_matched: Column, n_total: Column, roads_present: Column) -> Column:
    return (
        F.when(n_total == 0, "nothing to test: the map names no roads")
        .when(~roads_present,
              "nothing to test: no named roads around this place")
        .when(n_matched == 0, F.format_string(
            "none of %d named roads is here, though others are: the area may be wrong", n_total))
        .otherwise(F.format_string("%d of %d named roads are here", n_matched, n_total))
    )


def match_reward(avg_scale: Column, reader_scale: Column, n_matched: Column, n_total: Column, present: Column,
                 has_centre: Column) -> Column:
    """Both axes as a map: axis -> (score, verdict)."""
    scale = F.struct(geo.scale_consistency(avg_scale).alias("score"),
                     geo.scale_verdict(avg_scale, reader_scale).alias("verdict"))
    roads = F.struct(
        F.when(has_centre, road_agreement(n_matched, n_total, present)).otherwise(F.lit(0.5)).alias("score"),
        F.when(has_centre, road_verdict(n_matched, n_total, present))
        .otherwise(F.lit("nothing to test: no centre")).alias("verdict"),
    )
    return F.create_map(F.lit("scale_consistency"), scale, F.lit("road_name_agreement"), roads)


def review_set(attempts: DataFrame, committed: DataFrame) -> DataFrame:
    """The three strongest attempts per case plus every committed one, flagged."""
    by_inliers = Window.partitionBy("case_id").orderBy(F.desc("n_inliers"), "seq")
    top = attempts.withColumn("rn", F.row_number().over(by_inliers)).where(F.col("rn") <= TOP_REVIEW).drop("rn")
    chosen = attempts.join(committed.select("case_id", "seq"), ["case_id", "seq"], "left_semi")
    shown = top.unionByName(chosen).dropDuplicates(["case_id", "seq"])
    marks = committed.select("case_id", "seq", F.lit(True).alias("_c"))
    return shown.join(marks, ["case_id", "seq"], "left").withColumn(
        "committed", F.coalesce("_c", F.lit(False))
    ).drop("_c")


def commit_groups(commits: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per case and area group: the last commit that had a valid affine.

    `commits` has case_id, commit_seq, seq (the attempt); unknown attempts are dropped.
    """
    valid = attempts.where("has_valid_affine")
    row = F.struct("seq", "n_inliers", "commit_seq")
    last = commits.join(valid, ["case_id", "seq"]).groupBy("case_id", "area_group").agg(
        F.max_by(row, F.col("commit_seq")).alias("_r")
    )
    return last.select("case_id", "area_group", "_r.*")


def switch_commit(committed: DataFrame, directives: DataFrame, attempts: DataFrame) -> DataFrame:
    """Replace one group's commit per directive (case_id, seq); unusable attempts change nothing."""
    usable = attempts.where(F.col("has_valid_affine") & F.coalesce(F.col("has_geometry"), F.lit(False)))
    new = directives.join(usable, ["case_id", "seq"]).select(
        "case_id", "area_group", "seq", "n_inliers", F.lit(None).cast("bigint").alias("commit_seq")
    )
    kept = committed.join(new.select("case_id", "area_group"), ["case_id", "area_group"], "left_anti")
    return kept.unionByName(new)


def commit_totals(committed: DataFrame) -> DataFrame:
    """case_id, n_groups, total_inliers, primary_seq: the strongest commit, the earlier on ties."""
    return committed.groupBy("case_id").agg(
        F.count("*").alias("n_groups"),
        F.sum("n_inliers").alias("total_inliers"),
        F.min_by("seq", F.struct((-F.col("n_inliers")).alias("m"), "area_group")).alias("primary_seq"),
    )


def primary_pages(pages: DataFrame) -> DataFrame:
    """doc_id, area_group, page: clearest drawing first, then the widest view, then page order."""
    clarity = F.array_position(F.array(*map(F.lit, ("clear", "ambiguous", "none"))), F.col("boundary_clarity"))
    width = F.array_position(F.array(*map(F.lit, ("wide", "medium", "close"))), F.col("detail_level"))
    matches = pages.where("category = 'match'")
    return matches.groupBy("doc_id", "area_group").agg(
        F.min_by("page", F.struct(clarity.alias("c"), width.alias("w"), "page")).alias("page")
    )


def choose_attempt(attempts: DataFrame) -> DataFrame:
    """Attempt to commit per case and group: a strong one first, else inliers, scale, road share."""
    strong = (
        (tx.inlier_tier(F.col("n_inliers")) == "STRONG")
        & (tx.scale_tier(F.col("scale_score")) == "GOOD")
        & tx.road_tier(F.col("road_score")).isin("STRONG", "NEUTRAL")
    )
    order = [
        F.when(strong, 0).otherwise(1), F.when(strong, F.col("seq")).otherwise(F.lit(0)), -F.col("n_inliers"),
        -F.col("scale_score"), -F.col("road_score"), F.col("seq"),
    ]
    return _pick(attempts.where("has_valid_affine"), ["case_id", "area_group"], order)


def budgeted_attempts(calls: DataFrame) -> DataFrame:
    """Attempts within the budget: five per case, two more after each retry before them.

    `calls` has case_id, seq, is_attempt, is_retry.
    """
    totals = {
        "n_attempts": F.when(F.col("is_attempt"), 1).otherwise(0),
        "n_retries": F.when(F.col("is_retry"), 1).otherwise(0),
    }
    counted = running_totals(calls, ["case_id"], "seq", totals)
    allowed = F.col("n_attempts") <= ATTEMPT_BUDGET + RETRY_BUDGET * F.col("n_retries")
    return counted.where(F.col("is_attempt") & allowed)


def first_calls(calls: DataFrame) -> DataFrame:
    """First call per case and fingerprint; `calls` has case_id, seq, fingerprint."""
    return _pick(calls, ["case_id", "fingerprint"], [F.col("seq")])


def nearest_proposal(attempts: DataFrame, proposals: DataFrame) -> DataFrame:
    """case_id, seq, center_id, distance_m, accepted: the nearest proposed centre within 100 m.

    A case without proposals accepts any coordinate.
    """
    away = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    # Repeated proposals of one spot count once.
    centres = proposals.groupBy("case_id", F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(
        F.min("center_id").alias("center_id")
    )
    rows = attempts.join(centres, "case_id", "left").withColumn("d", away)
    best = F.min(F.struct("d", "center_id")).alias("_b")
    return rows.groupBy("case_id", "seq").agg(best).select(
        "case_id", "seq", F.col("_b.center_id").alias("center_id"), F.col("_b.d").alias("distance_m"),
        (F.col("_b.d").isNull() | (F.col("_b.d") <= PICK_RADIUS_M)).alias("accepted"),
    )


TOOL_RETURN = (
    "struct<lat:double,lon:double,hits:array<struct<lat:double,lon:double>>,"
    "intersections:array<struct<lat:double,lon:double>>>"
)


def returned_points(returns: DataFrame) -> DataFrame:
    """case_id, lat, lon of every coordinate in the JSON a tool gave back."""
    parsed = returns.select("case_id", F.from_json("content", TOOL_RETURN).alias("r"))
    own = F.array(F.struct("r.lat", "r.lon"))
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    every = F.concat(own, F.coalesce("r.hits", none), F.coalesce("r.intersections", none))
    spots = parsed.select("case_id", F.explode(every).alias("p")).select("case_id", "p.lat", "p.lon")
    return spots.where("lat IS NOT NULL AND lon IS NOT NULL")


def check_picks(picks: DataFrame, points: DataFrame) -> DataFrame:
    """case_id, min_km, accepted: a pick must lie within 5 km of some returned coordinate."""
    spots = points.select("case_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    away = geo.haversine_km(F.col("top_lat"), F.col("top_lon"), F.col("plat"), F.col("plon"))
    nearest = picks.join(spots, "case_id", "left").groupBy("case_id").agg(F.min(away).alias("min_km"))
    return nearest.withColumn("accepted", F.col("min_km").isNull() | (F.col("min_km") <= PICK_LIMIT_KM))


# Rank, radius and confidence of a single signal; radii sit inside the stated ranges.
SIGNALS = {
    "postcode": (1, 300, "high"), "grid_ref": (2, 300, "high"), "intersect": (3, 300, "high"),
    "place": (4, 800, "med"), "road": (5, 1500, "med"), "area": (6, 2500, "low"),
}
CONSENSUS_SIGMA = 200


def consensus(signals: DataFrame) -> DataFrame:
    """case_id, lat, lon, sigma_m, confidence, consensus from candidate coordinates.

    `signals` has case_id, seq, source, lat, lon. Two coordinates within 500 m of each other make a
    tight consensus. Cells are small enough that two points of one cell always agree; only points
    alone in their cell are compared with the neighbouring cells, so a dense spot costs one count.
    """
    # A cell's diagonal stays below 500 m: latitude steps of 350 m, longitude steps of at most that.
    step = 350.0 / 111_320.0
    row = F.floor(F.col("lat") / step)
    cells = signals.withColumns({"cy": row, "cx": F.floor(F.col("lon") / step)})
    by = ["case_id", "cx", "cy"]
    sizes = cells.groupBy(*by).agg(F.count("*").alias("_n"))
    sized = cells.join(sizes, by)
    alone = sized.where("_n = 1")
    # At 60 degrees north a longitude step shrinks to half, so four steps reach 500 m there.
    around = alone.select(
        "case_id", "seq", "lat", "lon", F.explode(F.sequence(F.col("cx") - 6, F.col("cx") + 6)).alias("cx"), "cy"
    ).withColumn("cy", F.explode(F.sequence(F.col("cy") - 2, F.col("cy") + 2)))
    others = cells.select(*by, F.col("seq").alias("oseq"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    near = around.join(others, by).where(
        (F.col("seq") != F.col("oseq"))
        & (geo.haversine_m(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) <= CONSENSUS_M)
    )
    # Both ends of an agreeing pair agree, also the one that sits in a dense cell.
    agreeing = near.select("case_id", "seq").unionByName(sized.where("_n > 1").select("case_id", "seq")).distinct()
    marked = signals.join(agreeing.withColumn("_agree", F.lit(True)), ["case_id", "seq"], "left")
    agree = F.coalesce("_agree", F.lit(False))
    table = F.create_map(*[
        x for k, (r, s, c) in SIGNALS.items()
        for x in (F.lit(k), F.struct(F.lit(r).alias("r"), F.lit(s).alias("s"), F.lit(c).alias("c")))
    ])
    rule = F.try_element_at(table, F.col("source"))
    marked = marked.withColumns({"agree": agree, "rule": rule})
    best = F.min_by(F.struct("lat", "lon", "agree", "rule"), F.struct(~F.col("agree"), F.col("rule.r"), "seq")).alias("b")
    picked = marked.groupBy("case_id").agg(best)
    return picked.select(
        "case_id", "b.lat", "b.lon",
        F.when(F.col("b.agree"), CONSENSUS_SIGMA).otherwise(F.col("b.rule.s")).alias("sigma_m"),
        F.when(F.col("b.agree"), "high").otherwise(F.col("b.rule.c")).alias("confidence"),
        F.col("b.agree").alias("consensus"),
    )


def quadrant_coverage(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, quadrants: quarters of the map with an inlier; `points` has x, y, width, height."""
    east, south = F.col("x") >= F.col("width") / 2, F.col("y") >= F.col("height") / 2
    quarter = F.pow(F.lit(2), east.cast("int") + 2 * south.cast("int")).cast("int")
    return points.groupBy(*keys).agg(F.bit_count(F.bit_or(quarter)).cast("int").alias("quadrants"))
