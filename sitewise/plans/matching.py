"""Queries of the matching family: search plan, registration, ranking and commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.evaluate import scores as sc
from sitewise.evaluate import telemetry as tm
from sitewise.functions import crs, geo
from sitewise.operators import ranking, registration, search_plan
from sitewise.plans.bindings import Inputs
from sitewise.plans.registry import query


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


_BEST = """
    bk AS (SELECT *, row_number() OVER (PARTITION BY case_id, center, zoom ORDER BY n_inliers DESC, seq) AS rn,
                  min(seq) OVER (PARTITION BY case_id, center, zoom) AS first_seq FROM (SELECT * FROM attempt WHERE has_valid_affine AND n_inliers >= 5)),
    bb AS (SELECT * FROM bk WHERE rn = 1)"""
_TOP = _BEST + """,
    mt AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY case_id ORDER BY n_inliers DESC, first_seq) AS metric_rank FROM bb),
    t5 AS (SELECT *, n_inliers * (quadrants / 4.0::DOUBLE) AS score FROM (SELECT * REPLACE (CASE WHEN quadrants > 4 THEN 4 ELSE quadrants END AS quadrants) FROM mt WHERE metric_rank <= 5)),
    ts AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, metric_rank) AS score_rank FROM t5)"""


@query("best_per_bucket", "attempt", sql=f"WITH {_BEST} SELECT case_id, center, zoom, seq, n_inliers, first_seq FROM bb")
def best_per_bucket(i: Inputs):
    best = ranking.best_per_bucket(ranking.usable_attempts(i.bind("attempt")))
    return best.select("case_id", "center", "zoom", "seq", "n_inliers", "first_seq")


def _top(i: Inputs):
    attempts = i.bind("attempt").withColumn("quadrants", F.least("quadrants", F.lit(4)))
    return ranking.top_buckets(ranking.best_per_bucket(ranking.usable_attempts(attempts)))


@query("top5_rerank", "attempt", sql=f"""WITH {_TOP}
    SELECT case_id, seq, CAST(metric_rank AS INT) AS metric_rank, round(score, 6) AS score, CAST(score_rank AS INT) AS score_rank FROM ts""")
def top5_rerank(i: Inputs):
    return _top(i).select("case_id", "seq", "metric_rank", _r("score"), "score_rank")


@query("road_boost", "attempt", sql=f"""WITH {_TOP},
    bo AS (SELECT *, score * CASE WHEN zoom <> 16 THEN (1 + n_road_matched / 4.0::DOUBLE) ^ 2 ELSE 1 END AS boosted FROM ts),
    w AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY boosted DESC, score_rank) AS rn FROM bo)
    SELECT case_id, seq, round(boosted, 6) AS boosted, score_rank <> 1 AS overridden FROM w WHERE rn = 1""")
def road_boost(i: Inputs):
    """Winner after the road check; no roads are known at zoom 16."""
    ranked = _top(i).withColumns({"n_roads": F.lit(4), "roads_present": F.col("zoom") != 16})
    return ranking.road_boost(ranked).select("case_id", "seq", _r("boosted"), "overridden")


@query("match_reward", "attempt", sql="""
    SELECT seq, round(least(avg_scale, 1 / avg_scale) ^ 2, 6) AS scale_score,
        CASE WHEN seq % 7 = 0 THEN 0.5::DOUBLE WHEN n_road_matched = 0 AND zoom <> 16 THEN 0.0::DOUBLE WHEN zoom = 16 THEN 0.5::DOUBLE ELSE n_road_matched / 4.0::DOUBLE END AS road_score,
        CASE WHEN seq % 7 = 0 THEN 'nothing to test: no centre' WHEN zoom = 16 THEN 'nothing to test: no named roads around this place'
             WHEN n_road_matched = 0 THEN 'none of 4 named roads is here, though others are: the area may be wrong'
             ELSE concat(CAST(n_road_matched AS STRING), ' of 4 named roads are here') END AS road_verdict,
        CAST(NULL AS DOUBLE) AS missing_axis FROM attempt""")
def match_reward(i: Inputs):
    """Both consistency axes of every attempt, read back from the reward map."""
    from sitewise.functions.text import axis_field

    reward = ranking.match_reward(
        F.col("avg_scale"), F.lit("1:1250"), F.col("n_road_matched"), F.lit(4), F.col("zoom") != 16, F.col("seq") % 7 != 0
    )
    rows = i.bind("attempt").select("seq", reward.alias("reward"))
    return rows.select(
        "seq", F.round(axis_field(F.col("reward"), "scale_consistency", "score"), 6).alias("scale_score"),
        axis_field(F.col("reward"), "road_name_agreement", "score").alias("road_score"),
        axis_field(F.col("reward"), "road_name_agreement", "verdict").alias("road_verdict"),
        axis_field(F.col("reward"), "unknown_axis", "score").alias("missing_axis"),
    )


_COMMITS = """
    cm AS (SELECT case_id, seq, seq * 7 % 1000003 AS commit_seq FROM attempt WHERE center = 'click'),
    cg AS (SELECT a.case_id, a.area_group, a.seq, a.n_inliers, commit_seq, row_number() OVER (PARTITION BY a.case_id, a.area_group ORDER BY commit_seq DESC) AS rn
           FROM cm JOIN attempt a ON a.case_id = cm.case_id AND a.seq = cm.seq WHERE has_valid_affine),
    cl AS (SELECT * EXCLUDE (rn) FROM cg WHERE rn = 1)"""


def _committed(i: Inputs):
    commits = i.bind("attempt").where("center = 'click'").select("case_id", "seq", (F.col("seq") * 7 % 1000003).alias("commit_seq"))
    return ranking.commit_groups(commits, i.bind("attempt"))


@query("review_set", "attempt", sql=f"""WITH {_COMMITS},
    tp AS (SELECT case_id, seq FROM (SELECT case_id, seq, row_number() OVER (PARTITION BY case_id ORDER BY n_inliers DESC, seq) AS rn FROM attempt) WHERE rn <= 3),
    al AS (SELECT case_id, seq FROM tp UNION SELECT case_id, seq FROM cl)
    SELECT al.case_id, al.seq, cl.seq IS NOT NULL AS committed FROM al LEFT JOIN cl ON al.case_id = cl.case_id AND al.seq = cl.seq""")
def review_set(i: Inputs):
    return ranking.review_set(i.bind("attempt"), _committed(i)).select("case_id", "seq", "committed")


@query("commit_groups", "attempt", sql=f"WITH {_COMMITS} SELECT case_id, area_group, seq, n_inliers, commit_seq FROM cl")
def commit_groups(i: Inputs):
    return _committed(i)


_SWITCH = _COMMITS + """,
    dr AS (SELECT case_id, max(seq) AS seq FROM attempt GROUP BY case_id),
    nw AS (SELECT a.case_id, a.area_group, a.seq, a.n_inliers FROM dr JOIN attempt a ON a.case_id = dr.case_id AND a.seq = dr.seq WHERE has_valid_affine AND zoom <> 15),
    sw AS (SELECT cl.case_id, cl.area_group, cl.seq, cl.n_inliers FROM cl LEFT JOIN nw ON cl.case_id = nw.case_id AND cl.area_group = nw.area_group WHERE nw.seq IS NULL
           UNION ALL SELECT * FROM nw)"""


def _switched(i: Inputs):
    attempts = i.bind("attempt").withColumn("has_geometry", F.col("zoom") != 15)
    directives = attempts.groupBy("case_id").agg(F.max("seq").alias("seq"))
    return ranking.switch_commit(_committed(i), directives, attempts)


@query("switch_commit", "attempt", sql=f"WITH {_SWITCH} SELECT * FROM sw")
def switch_commit(i: Inputs):
    """One group per case moved to the case's last attempt, where that one is usable."""
    return _switched(i).select("case_id", "area_group", "seq", "n_inliers")


@query("commit_totals", "attempt", sql=f"""WITH {_SWITCH},
    p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n_inliers DESC, area_group) AS rn FROM sw)
    SELECT case_id, count(*) AS n_groups, CAST(sum(n_inliers) AS BIGINT) AS total_inliers, max(CASE WHEN rn = 1 THEN seq END) AS primary_seq FROM p GROUP BY case_id""")
def commit_totals(i: Inputs):
    return ranking.commit_totals(_switched(i))


@query("choose_attempt", "attempt", sql="""WITH
    a AS (SELECT *, least(avg_scale, 1 / avg_scale) ^ 2 AS ss, n_road_matched / 4.0::DOUBLE AS rs FROM attempt WHERE has_valid_affine),
    b AS (SELECT *, n_inliers >= 100 AND ss >= 0.8 AND (rs >= 0.6 OR rs = 0.5) AS strong FROM a),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id, area_group ORDER BY NOT strong, CASE WHEN strong THEN seq ELSE 0 END,
              n_inliers DESC, ss DESC, rs DESC, seq) AS rn FROM b)
    SELECT case_id, area_group, seq FROM r WHERE rn = 1""")
def choose_attempt(i: Inputs):
    attempts = i.bind("attempt").withColumns(
        {"scale_score": geo.scale_consistency(F.col("avg_scale")), "road_score": F.col("n_road_matched") / 4}
    )
    return ranking.choose_attempt(attempts).select("case_id", "area_group", "seq")


@query("attempt_budget", "attempt", sql="""WITH
    c AS (SELECT case_id, seq, center <> 'error' AS is_attempt, sum(CASE WHEN center <> 'error' THEN 1 ELSE 0 END) OVER w AS n,
                 sum(CASE WHEN center = 'error' THEN 1 ELSE 0 END) OVER w AS r FROM attempt WINDOW w AS (PARTITION BY case_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT case_id, seq FROM c WHERE is_attempt AND n <= 5 + 2 * r""")
def attempt_budget(i: Inputs):
    calls = i.bind("attempt").select(
        "case_id", "seq", (F.col("center") != "error").alias("is_attempt"), (F.col("center") == "error").alias("is_retry")
    )
    return ranking.budgeted_attempts(calls).select("case_id", "seq")


@query("metric_lines", "attempt", sql="""
    SELECT case_id, seq, concat('  cand ', CAST(seq AS STRING), '  group ', CAST(area_group AS STRING), '  page ', CAST(zoom AS STRING), '  n_inliers=', CAST(n_inliers AS STRING),
        '  road_name_agreement=', printf('%.2f', n_road_matched / 4.0::DOUBLE), ' (v)  scale_consistency=?', CASE WHEN has_valid_affine THEN '' ELSE '  [COMMITTED]' END) AS line FROM attempt""")
def metric_lines(i: Inputs):
    rows = i.bind("attempt").withColumns({
        "road_score": F.col("n_road_matched") / 4, "scale_score": F.lit(None).cast("double"), "road_verdict": F.lit("v"),
        "page": F.col("zoom"), "committed": ~F.col("has_valid_affine"),
    })
    return tm.metric_lines(rows)


_MAPS = """SELECT c_custkey AS map_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST((c_custkey % 8 + 1) * 1250 AS INT) END AS scale,
    CAST(50 + c_custkey % 90 / 10.0 AS DOUBLE) AS lat, CAST(-4 + c_custkey % 50 / 10.0 AS DOUBLE) AS lon, CAST(600 + c_custkey % 7 * 100 AS INT) AS height, CAST(800 + c_custkey % 5 * 100 AS INT) AS width,
    CAST(200 + c_custkey % 3 * 400 AS DOUBLE) AS sigma_m FROM customer"""


def _maps(i: Inputs):
    return i.spark.sql(_MAPS.replace("FROM customer", "FROM {customer}"), customer=i.table("customer"))


def _zoom_sql(mpp: str) -> str:
    return f"CAST(greatest(15, least(19, round_even(log2(156543.03::DOUBLE * cos(radians(lat)) / ({mpp})), 0))) AS INT)"


_CONFIGS = f"""
    mp AS ({_MAPS}),
    kn AS (SELECT *, 25.4::DOUBLE / 200 / 1000 * scale AS m0 FROM mp WHERE scale IS NOT NULL),
    kb AS (SELECT *, {_zoom_sql('m0')} AS z FROM kn),
    kz AS (SELECT map_id, height, width, lat, lon, sigma_m, m0 AS mpp, z AS best, unnest(list_sort(list_distinct([z, greatest(15, z - 1), least(19, z + 1)]))) AS zoom FROM kb),
    un AS (SELECT mp.*, sc, 25.4::DOUBLE / 200 / 1000 * sc AS mpp FROM mp, (VALUES (1250), (2500), (5000), (10000), (15000), (25000)) s(sc) WHERE scale IS NULL),
    uz AS (SELECT *, {_zoom_sql('mpp')} AS zoom FROM un),
    uf AS (SELECT *, row_number() OVER (PARTITION BY map_id, zoom ORDER BY sc) AS rn FROM uz),
    st AS (SELECT unnest([0.85::DOUBLE, 1.15::DOUBLE]) AS f),
    cf AS (SELECT map_id, zoom, mpp, lat, lon, height, width, sigma_m FROM kz
           UNION ALL SELECT map_id, z, m0 * f, lat, lon, height, width, sigma_m FROM kb, st
           UNION ALL SELECT map_id, zoom, mpp, lat, lon, height, width, sigma_m FROM uf WHERE rn = 1
           UNION ALL SELECT map_id, zoom, mpp * f, lat, lon, height, width, sigma_m FROM uz, st WHERE sc = 2500)"""
_GRIDS = _CONFIGS + """,
    g0 AS (SELECT *, 156543.03::DOUBLE * cos(radians(lat)) / 2.0::DOUBLE ^ zoom AS tm FROM cf),
    g1 AS (SELECT *, mpp / tm AS ratio FROM g0),
    g2 AS (SELECT *, CAST(trunc(height * ratio) AS INT) AS map_h, CAST(trunc(width * ratio) AS INT) AS map_w, greatest(2, CAST(ceil(sigma_m / (256 * tm)) AS INT)) AS margin
           FROM g1 WHERE ratio BETWEEN 0.3 AND 3 AND trunc(height * ratio) >= 64 AND trunc(width * ratio) >= 64),
    g3 AS (SELECT *, greatest(3, least(17, CAST(ceil(map_w / 256.0) AS INT) + 2 * margin)) AS nx, greatest(3, least(17, CAST(ceil(map_h / 256.0) AS INT) + 2 * margin)) AS ny FROM g2),
    g4 AS (SELECT * REPLACE (CASE WHEN nx % 2 = 0 THEN nx + 1 ELSE nx END AS nx, CASE WHEN ny % 2 = 0 THEN ny + 1 ELSE ny END AS ny) FROM g3),
    gr AS (SELECT * FROM g4 WHERE map_h < ny * 256 AND map_w < nx * 256)"""


@query("search_configs", sql=f"WITH {_CONFIGS} SELECT map_id, zoom, round(mpp, 9) AS mpp FROM cf")
def search_configs(i: Inputs):
    return search_plan.search_configs(_maps(i)).select("map_id", "zoom", _r("mpp", 9))


def _grids(i: Inputs):
    return search_plan.tile_grids(search_plan.search_configs(search_plan.spread_maps(_maps(i))))


@query("tile_grids", sql=f"""WITH {_GRIDS}
    SELECT map_id, zoom, round(mpp, 9) AS mpp, map_h, map_w, nx AS tiles_x, ny AS tiles_y,
        CAST(trunc((lon + 180) / 360 * 2.0::DOUBLE ^ zoom) AS INT) - nx // 2 AS tx_min,
        CAST(trunc((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2.0::DOUBLE ^ zoom) AS INT) - ny // 2 AS ty_min FROM gr""")
def tile_grids(i: Inputs):
    return _grids(i).select("map_id", "zoom", _r("mpp", 9), "map_h", "map_w", "tiles_x", "tiles_y", "tx_min", "ty_min")


@query("search_windows", sql=f"""WITH {_GRIDS},
    f AS (SELECT *, nx * 256 - map_w AS fx, ny * 256 - map_h AS fy FROM gr),
    t AS (SELECT *, CAST(trunc(sqrt(greatest(1, CAST(fx AS DOUBLE) * fy) / 100)) AS INT) AS tg FROM f),
    s AS (SELECT *, greatest(32, least(tg, greatest(1, fx))) AS sx, greatest(32, least(tg, greatest(1, fy))) AS sy FROM t)
    SELECT map_id, zoom, round(mpp, 9) AS mpp, count(*) AS n_windows, CAST(max(x) AS INT) AS last_x, CAST(max(y) AS INT) AS last_y
    FROM (SELECT *, unnest(range(0, fx + 1, sx)) AS x FROM (SELECT *, unnest(range(0, fy + 1, sy)) AS y FROM s)) GROUP BY map_id, zoom, mpp""")
def search_windows(i: Inputs):
    """Windows per search setting."""
    w = search_plan.search_windows(_grids(i).withColumn("mpp", F.round("mpp", 9)))
    return w.groupBy("map_id", "zoom", "mpp").agg(
        F.count("*").alias("n_windows"), F.max("window_x").alias("last_x"), F.max("window_y").alias("last_y")
    )


@query("grid_tiles", sql=f"""WITH {_GRIDS} SELECT map_id, zoom, round(mpp, 9) AS mpp, CAST(nx * ny AS BIGINT) AS n_tiles FROM gr""")
def grid_tiles(i: Inputs):
    tiles = search_plan.tiles_of_grid(_grids(i).withColumn("mpp", F.round("mpp", 9)))
    return tiles.groupBy("map_id", "zoom", "mpp").agg(F.count("*").alias("n_tiles"))


@query("tile_roundtrip", "point", sql="""WITH
    t AS (SELECT point_id, CAST(trunc((lon + 180) / 360 * 131072) AS INT) AS tile_x,
                 CAST(trunc((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 131072) AS INT) AS tile_y, lat FROM point)
    SELECT point_id, tile_x, tile_y, round((tile_x * 256 + 128) / (131072.0::DOUBLE * 256) * 360 - 180, 6) AS lon,
        round(degrees(atan(sinh(pi() * (1 - 2 * (tile_y * 256 + 128) / (131072.0::DOUBLE * 256))))), 6) AS lat,
        round(156543.03 * cos(radians(lat)) / 131072, 6) AS mpp FROM t""")
def tile_roundtrip(i: Inputs):
    """Point to tile and back to the tile's middle."""
    z = F.lit(17)
    t = i.bind("point").select(
        "point_id", geo.tile_x(F.col("lon"), z).alias("tile_x"), geo.tile_y(F.col("lat"), z).alias("tile_y"),
        geo.tile_mpp(F.col("lat"), z).alias("mpp"),
    )
    return t.select(
        "point_id", "tile_x", "tile_y", F.round(geo.pixel_lon(F.lit(128), z, F.col("tile_x")), 6).alias("lon"),
        F.round(geo.pixel_lat(F.lit(128), z, F.col("tile_y")), 6).alias("lat"), _r("mpp"),
    )


@query("tile_bounds", "point", sql="""WITH
    t AS (SELECT point_id, CAST(trunc((lon + 180) / 360 * 131072) AS INT) AS x, CAST(trunc((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 131072) AS INT) AS y FROM point),
    b AS (SELECT *, 2 * 20037508.342789244::DOUBLE / 131072 AS s FROM t)
    SELECT point_id, round(-20037508.342789244::DOUBLE + x * s, 3) AS xmin, round(20037508.342789244::DOUBLE - y * s, 3) AS ymax,
        round(-20037508.342789244::DOUBLE + x * s + s, 3) AS xmax, round(20037508.342789244::DOUBLE - y * s - s, 3) AS ymin, true AS covered FROM b""")
def tile_bounds(i: Inputs):
    """Mercator box of a point's tile; its grid box must cover the point."""
    z = F.lit(17)
    box = geo.tile_bounds(z, geo.tile_x(F.col("lon"), z), geo.tile_y(F.col("lat"), z))
    t = i.bind("point").select("point_id", "lat", "lon", box.alias("b")).select("point_id", "lat", "lon", "b.*")
    t = crs.mercator_box_to_bng(t, ["xmin", "ymin", "xmax", "ymax"], ["g0", "g1", "g2", "g3"])
    t = crs.wgs84_to_bng(t, "lat", "lon", "e", "n")
    covered = F.col("e").between(F.col("g0"), F.col("g2")) & F.col("n").between(F.col("g1"), F.col("g3"))
    return t.select("point_id", *[_r(c, 3) for c in ("xmin", "ymin", "xmax", "ymax")], covered.alias("covered"))


_ANGLE, _SCALE = "(vec_id % 12) * 0.5", "(0.6 + (vec_id % 9) / 10.0)"


def _keypoints(i: Inputs):
    """Point pairs of every vector under a known similarity; every eighth pair is an outlier."""
    e = i.table("embeddings").select(
        F.col("vec_id").alias("match_id"), F.posexplode(F.sequence(F.lit(0), F.lit(62), F.lit(2))).alias("idx", "p"), "embedding",
        F.expr(f"CAST({_ANGLE} AS DOUBLE)").alias("t"), F.expr(f"CAST({_SCALE} AS DOUBLE)").alias("s"),
    )
    x, y = F.get("embedding", F.col("p")).cast("double") * 1000, F.get("embedding", F.col("p") + 1).cast("double") * 1000
    e = e.withColumns({"x0": x, "y0": y})
    bad = F.when(F.col("idx") % 8 == 7, 700.0 + F.col("idx") * 300).otherwise(0.0)
    a, b = F.col("s") * F.cos("t"), F.col("s") * F.sin("t")
    return e.select(
        "match_id", "idx", "x0", "y0", (a * F.col("x0") - b * F.col("y0") + 100 + bad).alias("x1"),
        (b * F.col("x0") + a * F.col("y0") - 50 + bad * 2).alias("y1"),
    )


@query("similarity_fit", sql=f"""WITH t AS (SELECT vec_id AS match_id, CAST({_SCALE} AS DOUBLE) AS s, CAST({_ANGLE} AS DOUBLE) AS a FROM embeddings)
    SELECT match_id, round(s * cos(a), 4) AS a00, round(-s * sin(a), 4) AS a01, CAST(100 AS DOUBLE) AS a02, round(s * sin(a), 4) AS a10, round(s * cos(a), 4) AS a11,
        CAST(-50 AS DOUBLE) AS a12, CAST(28 AS BIGINT) AS n_inliers, CAST(32 AS BIGINT) AS n_points FROM t""")
def similarity_fit(i: Inputs):
    f = registration.fit_similarity(_keypoints(i))
    return f.select("match_id", *[F.round(F.round(c, 4) + 0.0, 4).alias(c) for c in registration.AFFINE], "n_inliers", "n_points")


@query("similarity_fit_shares", sql=f"""WITH t AS (SELECT vec_id AS match_id, CAST({_SCALE} AS DOUBLE) AS s, CAST({_ANGLE} AS DOUBLE) AS a FROM embeddings)
    SELECT match_id, round(s * cos(a), 4) AS a00, round(s * sin(a), 4) AS a10, CAST(5 + match_id % 24 AS BIGINT) AS n_inliers, CAST(32 AS BIGINT) AS n_points FROM t""")
def similarity_fit_shares(i: Inputs):
    """Matches whose inliers are 5 to 28 of 32 points; the others are moved by hash, 424 px at least."""
    p = _keypoints(i).where("idx < 32").drop("x1", "y1").join(
        i.table("embeddings").select(
            F.col("vec_id").alias("match_id"), F.expr(f"CAST({_ANGLE} AS DOUBLE)").alias("t"), F.expr(f"CAST({_SCALE} AS DOUBLE)").alias("s")
        ), "match_id",
    )
    a, b = F.col("s") * F.cos("t"), F.col("s") * F.sin("t")
    moved = lambda k: F.when(F.col("idx") < 5 + F.col("match_id") % 24, 0).otherwise(300 + F.pmod(F.xxhash64("match_id", "idx", F.lit(k)), F.lit(2000)))
    p = p.select(
        "match_id", "idx", "x0", "y0", (a * F.col("x0") - b * F.col("y0") + 100 + moved(0)).alias("x1"),
        (b * F.col("x0") + a * F.col("y0") - 50 + moved(1)).alias("y1"),
    )
    f = registration.fit_similarity(p)
    return f.select("match_id", *[F.round(F.round(c, 4) + 0.0, 4).alias(c) for c in ("a00", "a10")], "n_inliers", "n_points")


@query("quadrant_coverage", sql="""WITH
    p AS (SELECT vec_id AS match_id, embedding[2 * k + 1]::DOUBLE * 1000 + 200 AS x, embedding[2 * k + 2]::DOUBLE * 1000 + 200 AS y FROM embeddings, (SELECT unnest(range(0, 32)) AS k))
    SELECT match_id, CAST(count(DISTINCT CASE WHEN x >= 200 THEN 1 ELSE 0 END + CASE WHEN y >= 150 THEN 2 ELSE 0 END) AS INT) AS quadrants FROM p GROUP BY 1""")
def quadrant_coverage(i: Inputs):
    p = _keypoints(i).select(
        "match_id", (F.col("x0") + 200).alias("x"), (F.col("y0") + 200).alias("y"), F.lit(400).alias("width"), F.lit(300).alias("height")
    )
    return ranking.quadrant_coverage(p, ["match_id"])


@query("match_candidates")
def match_candidates(i: Inputs):
    """From point pairs to the winning candidate per map: fit, gate, rank, re-rank, road check."""
    points = _keypoints(i)
    fits = registration.fit_similarity(points)
    windows = i.table("embeddings").select(
        F.col("vec_id").alias("match_id"), (F.col("vec_id") % 10).alias("case_id"), F.col("label").cast("string").alias("center"),
        (F.col("vec_id") % 64 * 32).alias("window_x"), (F.col("vec_id") % 32 * 32).alias("window_y"), F.lit(0.9).alias("ratio"),
        F.lit(900).alias("height"), F.lit(1200).alias("width"), (15 + F.col("vec_id") % 5).cast("int").alias("zoom"),
        F.lit(65000).alias("tx_min"), F.lit(43000).alias("ty_min"),
    )
    spread = ranking.quadrant_coverage(
        registration.inliers_of(points, fits).select("match_id", "x", "y", F.lit(0).alias("width"), F.lit(0).alias("height")), ["match_id"]
    )
    rows = registration.candidate_rows(fits, windows).join(spread, "match_id", "left").withColumn(
        "quadrants", F.coalesce("quadrants", F.lit(4))
    ).withColumnRenamed("match_id", "seq")
    top = ranking.top_buckets(ranking.best_per_bucket(rows))
    checked = top.withColumns({"n_roads": F.lit(4), "n_road_matched": (F.col("seq") % 5).cast("int"), "roads_present": F.col("zoom") != 16})
    best = ranking.road_boost(checked)
    return best.select("case_id", "seq", "n_inliers", _r("avg_scale", 4), _r("center_lat"), _r("center_lon"), _r("boosted"), "overridden")


@query("view_fusion", sql="""WITH
    r AS (SELECT vec_id, v, c, abs(embedding[4 * v + c + 1]::DOUBLE) + 0.01 AS w FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS v), (SELECT unnest([0, 1, 2, 3]) AS c)),
    p AS (SELECT vec_id, v, c, w / sum(w) OVER (PARTITION BY vec_id, v) AS p FROM r),
    f AS (SELECT vec_id, (c + v) % 4 AS cls, sum(p) / 4 AS p FROM p GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, cls) AS rn FROM f)
    SELECT vec_id AS image_id, CAST(cls AS INT) AS raw_class, round(p, 6) AS confidence, CAST(CASE WHEN round(p, 9) >= 0.5 THEN cls * 90 ELSE 0 END AS INT) AS rotation,
        round(p, 9) < 0.5 AS abstained FROM b WHERE rn = 1""")
def view_fusion(i: Inputs):
    e = i.table("embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("view"))
    weights = F.transform(
        F.slice("embedding", F.col("view") * 4 + 1, F.lit(4)), lambda v: F.abs(v.cast("double")) + 0.01
    )
    e = e.select(F.col("vec_id").alias("image_id"), "view", weights.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda acc, v: acc + v)
    views = e.select("image_id", "view", total.alias("t"), F.posexplode("w").alias("cls", "v")).select(
        "image_id", "view", "cls", (F.col("v") / F.col("t")).alias("p")
    )
    return sc.fuse_views(views).select("image_id", F.col("raw_class").cast("int").alias("raw_class"), _r("confidence"), F.col("rotation").cast("int").alias("rotation"), "abstained")
