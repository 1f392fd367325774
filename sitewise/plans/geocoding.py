"""Queries of the geocoding family: places, postcodes, grid references, areas and roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import crs, geo, gridref
from sitewise.functions import text as tx
from sitewise.functions.geometry import multi_of_ring, point
from sitewise.operators import cells, geocode, ranking, roads, search
from sitewise.operators.polygon import check_in_area
from sitewise.plans import sqlgeo
from sitewise.plans.bindings import Inputs
from sitewise.plans.registry import query
from sitewise.plans.text import CANDIDATE_SQL, CONTEXT_SQL, admin_sql


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _places(i: Inputs):
    return search.prepare_places(i.bind("place"))


_PLACE_SQL = """
    g AS (SELECT *, lower(trim(name1)) AS name_lc, concat(lower(district_borough), chr(10), lower(county_unitary), chr(10)) AS admin FROM place)"""


@query("search_exact", "place", "name_query", sql=f"""WITH {CANDIDATE_SQL}, {_PLACE_SQL}
    SELECT query_id, cand_pos, row_id FROM cands JOIN g ON cand = name_lc""")
def search_exact(i: Inputs):
    return search.exact_pairs(i.bind("name_query"), _places(i))


@query("search_exact_classes", "place", "name_query", sql=f"""WITH {CANDIDATE_SQL}, {_PLACE_SQL},
    cl AS (SELECT name_lc, min(row_id) AS class_id, count(*) AS n_links FROM g GROUP BY 1)
    SELECT query_id, cand_pos, class_id, n_links FROM cands JOIN cl ON cand = name_lc""")
def search_exact_classes(i: Inputs):
    """Candidates against the classes of places of one name, whose members place_classes gives."""
    return search.exact_matches(i.bind("name_query"), _places(i))


@query("place_classes", "place", sql=f"""WITH {_PLACE_SQL[1:]}
    SELECT row_id, name_lc, min(row_id) OVER (PARTITION BY name_lc) AS class_id FROM g""")
def place_classes(i: Inputs):
    """Membership of the classes that search_exact_classes links."""
    return search.name_classes(_places(i))


@query("search_prefix", "place", "name_query", sql=f"""WITH {CANDIDATE_SQL}, {_PLACE_SQL},
    n AS (SELECT DISTINCT name_lc FROM g)
    SELECT query_id, name_lc, min(2 * cand_pos + CASE WHEN cand = name_lc THEN 0 ELSE 1 END) AS tier
    FROM cands JOIN n ON starts_with(name_lc, cand) GROUP BY 1, 2""")
def search_prefix(i: Inputs):
    """Names that a query candidate equals or begins, with the first tier each is met in."""
    return search.prefix_name_matches(i.bind("name_query"), _places(i)).select("query_id", "name_lc", "tier")


@query("search_context", "place", "name_query", sql=f"""WITH {CONTEXT_SQL}, {_PLACE_SQL},
    t AS (SELECT DISTINCT context, token FROM tokens), a AS (SELECT DISTINCT admin FROM g)
    SELECT DISTINCT context, admin FROM t JOIN a ON contains(admin, token)""")
def search_context(i: Inputs):
    """Admin texts that a context selects."""
    return search.context_pools(i.bind("name_query"), _places(i))


_SEARCH_SQL = f"""WITH {CANDIDATE_SQL}, {CONTEXT_SQL}, {_PLACE_SQL},
    tk AS (SELECT DISTINCT context, token FROM tokens), ad AS (SELECT DISTINCT admin FROM g),
    pool AS (SELECT DISTINCT context, admin FROM tk JOIN ad ON contains(admin, token)),
    live AS (SELECT DISTINCT context FROM pool),
    m AS (SELECT query_id, c.context, g.*, min(2 * cand_pos + CASE WHEN cand = name_lc THEN 0 ELSE 1 END) AS tier
          FROM cands c JOIN g ON starts_with(name_lc, cand) GROUP BY ALL),
    inside AS (SELECT m.* FROM m LEFT JOIN live ON m.context = live.context LEFT JOIN pool ON pool.context = m.context AND pool.admin = m.admin
               WHERE live.context IS NULL OR pool.admin IS NOT NULL),
    found AS (SELECT * FROM inside UNION ALL SELECT * FROM m WHERE query_id NOT IN (SELECT query_id FROM inside)),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, row_id) AS rn,
                 rank() OVER (PARTITION BY query_id ORDER BY tier) - 1 AS earlier FROM found),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, name_lc, round_even(easting / 100, 0), round_even(northing / 100, 0) ORDER BY rn) AS spot
          FROM o WHERE rn <= 15 AND earlier < 5),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS hit FROM k WHERE spot = 1)
    SELECT query_id, CAST(hit AS INT) AS hit, row_id, name1, district_borough FROM h WHERE hit <= 5"""


@query("place_search", "place", "name_query", sql=_SEARCH_SQL)
def place_search(i: Inputs):
    """Ranked hits by exact and prefix tiers, with the context and its fall-back."""
    hits = search.search(i.bind("name_query"), _places(i), k=5, fuzzy=False)
    return hits.select("query_id", "hit", "row_id", "name1", "district_borough")


@query("place_lookup")
def place_lookup(i: Inputs):
    """The whole place tool: all tiers, fuzzy included, coordinates added; 15 hits cut to 5."""
    queries = i.bind("name_query")
    asked = search.questions(queries)
    hits = search.answers(asked, _places(i), k=15).where("hit <= 5")
    named = crs.bng_to_wgs84(hits).select(
        "query_id", "hit", "row_id", tx.blank_to_null(F.col("name1")).alias("name"), F.lower("local_type").alias("type"),
        _r("lat"), _r("lon"), tx.blank_to_null(F.col("district_borough")).alias("admin_district"),
        tx.blank_to_null(F.col("county_unitary")).alias("county"),
    )
    return search.for_queries(queries, asked, named)


@query("search_fuzzy")
def search_fuzzy(i: Inputs):
    """Best names per candidate for queries without an exact or prefix match."""
    queries, places = i.bind("name_query"), _places(i)
    matched = search.prefix_name_matches(queries, places).select("query_id").distinct()
    left = queries.join(matched, "query_id", "left_anti").withColumn("context", F.lit(None).cast("string"))
    cands = search.candidates(left).withColumn("context", F.lit(None).cast("string"))
    names = places.groupBy("name_lc").agg(F.min("row_id").alias("pos")).withColumn("context", F.lit(None).cast("string"))
    return search.fuzzy_names(cands, names, 5).select("query_id", "cand_pos", "name_lc", _r("score", 4), "order")


@query("distinct_names", "place", sql="SELECT DISTINCT lower(trim(name1)) AS name_lc FROM place")
def distinct_names(i: Inputs):
    return _places(i).select("name_lc").distinct()


_POSTCODES = """
    ok AS (SELECT * FROM postcode WHERE NOT (easting = 0 AND northing = 0) AND quality <> 90),
    last AS (SELECT *, row_number() OVER (PARTITION BY postcode ORDER BY seq DESC) AS rn FROM ok),
    pc AS (SELECT * FROM last WHERE rn = 1),
    cd AS (SELECT code, name FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY sheet_rank DESC, seq DESC) AS rn FROM admin_code) WHERE rn = 1)"""


@query("postcode_table", "postcode", "admin_code", sql=f"WITH {_POSTCODES} SELECT postcode, easting, northing, district_code, 'ab' AS area FROM pc")
def postcode_table(i: Inputs):
    return geocode.clean_postcodes(i.bind("postcode"))


@query("admin_codes", "admin_code", sql="""
    SELECT code, name FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY sheet_rank DESC, seq DESC) AS rn FROM admin_code) WHERE rn = 1""")
def admin_codes(i: Inputs):
    return geocode.admin_codes(i.bind("admin_code"))


@query("postcode_lookup", "postcode", "admin_code", "postcode_query", sql=f"""WITH {_POSTCODES},
    c AS (SELECT query_id, upper(replace(trim(text), ' ', '')) AS t FROM postcode_query),
    n AS (SELECT query_id, CASE WHEN length(t) < 5 THEN t ELSE concat(left(t, CAST(length(t) - 3 AS BIGINT)), ' ', right(t, 3)) END AS postcode FROM c),
    f AS (SELECT query_id, n.postcode, cd.name AS admin_district, CAST(easting AS DOUBLE) AS e, CAST(northing AS DOUBLE) AS n
          FROM n JOIN pc ON n.postcode = pc.postcode LEFT JOIN cd ON cd.code = pc.district_code),
    {sqlgeo.bng_to_wgs84('f', 'w')}
    SELECT query_id, postcode, admin_district, round(lat, 6) AS lat, round(lon, 6) AS lon FROM w""")
def postcode_lookup(i: Inputs):
    postcodes = geocode.clean_postcodes(i.bind("postcode"))
    found = geocode.lookup_postcodes(i.bind("postcode_query"), postcodes, geocode.admin_codes(i.bind("admin_code")))
    return found.select("query_id", "postcode", "admin_district", _r("lat"), _r("lon"))


_GRID_SQL = """
    t AS (SELECT id, trim(regexp_replace(regexp_replace(replace(replace(upper(trim(grid_ref)), ',', ''), '  ', ' '), '\\s+[NSEW]{1,2}$', ''), '(\\d+)-\\d+', '\\1')) AS r FROM grid_text),
    s AS (SELECT id, r, left(r, 2) AS sq, trim(substr(r, 3)) AS rest FROM t),
    d AS (SELECT id, r, sq, CASE WHEN contains(rest, ' ') THEN split_part(rest, ' ', 1) ELSE left(rest, CAST(length(rest) // 2 AS BIGINT)) END AS ed,
                 CASE WHEN contains(rest, ' ') THEN split_part(rest, ' ', 2) ELSE substr(rest, length(rest) // 2 + 1, length(rest) // 2) END AS nd FROM s),
    b AS (SELECT id, CASE sq WHEN 'TG' THEN 600000 WHEN 'TQ' THEN 500000 WHEN 'TR' THEN 600000 WHEN 'TL' THEN 500000 WHEN 'TM' THEN 600000 END AS be,
                 CASE sq WHEN 'TG' THEN 300000 WHEN 'TQ' THEN 100000 WHEN 'TR' THEN 100000 WHEN 'TL' THEN 200000 WHEN 'TM' THEN 200000 END AS bn,
                 ed, nd, length(ed) + length(nd) >= 4 AS fine, sq FROM d),
    f AS (SELECT id, sq, be, bn, CASE WHEN fine THEN CAST(be + CAST(CASE WHEN length(ed) >= 5 THEN ed ELSE rpad(concat(ed, '5'), 5, '0') END AS INT) AS DOUBLE) END AS e,
                 CASE WHEN fine THEN CAST(bn + CAST(CASE WHEN length(nd) >= 5 THEN nd ELSE rpad(concat(nd, '5'), 5, '0') END AS INT) AS DOUBLE) END AS n FROM b)"""


@query("grid_ref", "grid_text", sql=f"""WITH {_GRID_SQL}, {sqlgeo.bng_to_wgs84('f', 'w')}
    SELECT id, e AS easting, n AS northing, round(CASE WHEN lat BETWEEN 49 AND 61 AND lon BETWEEN -8.5 AND 2 THEN lat END, 6) AS lat,
        round(CASE WHEN lat BETWEEN 49 AND 61 AND lon BETWEEN -8.5 AND 2 THEN lon END, 6) AS lon FROM w""")
def grid_ref(i: Inputs):
    refs = gridref.parse_grid_ref(i.bind("grid_text").select("id", "grid_ref"), "grid_ref")
    return gridref.geocode_grid_ref(refs, "grid_ref").select("id", "easting", "northing", _r("lat"), _r("lon"))


@query("grid_letters", "grid_text", sql=f"""WITH {_GRID_SQL} SELECT sq AS letters, be AS easting, bn AS northing, count(*) AS n FROM f GROUP BY ALL""")
def grid_letters(i: Inputs):
    """Squares in use with their origins, from the generated letter table."""
    used = i.bind("grid_text").groupBy(F.left("grid_ref", F.lit(2)).alias("letters")).agg(F.count("*").alias("n"))
    squares = gridref.grid_squares(i.spark)
    return used.join(F.broadcast(squares), "letters").select(
        "letters", F.col("easting").cast("int").alias("easting"), F.col("northing").cast("int").alias("northing"), "n"
    )


@query("easting_northing", "grid_text", sql=f"""WITH
    f AS (SELECT id, CAST(CAST(regexp_extract(text, '(\\d{{4,7}})\\s*E\\s*(\\d{{4,7}})\\s*N', 1) AS INT) AS DOUBLE) AS e,
                 CAST(CAST(regexp_extract(text, '(\\d{{4,7}})\\s*E\\s*(\\d{{4,7}})\\s*N', 2) AS INT) AS DOUBLE) AS n FROM grid_text),
    {sqlgeo.bng_to_wgs84('f', 'w')},
    k AS (SELECT id, e BETWEEN 60000 AND 700000 AND n BETWEEN 5000 AND 1280000 AND lat BETWEEN 49 AND 61 AND lon BETWEEN -8.5 AND 2 AS ok, lat, lon FROM w)
    SELECT id, round(CASE WHEN ok THEN lat END, 6) AS lat, round(CASE WHEN ok THEN lon END, 6) AS lon FROM k""")
def easting_northing(i: Inputs):
    found = gridref.parse_easting_northing(i.bind("grid_text").select("id", "text"), "text")
    return found.select("id", _r("lat"), _r("lon"))


@query("grid_roundtrip", "point", sql=f"""WITH f AS (SELECT point_id, easting AS e, northing AS n FROM point), {sqlgeo.bng_to_wgs84('f', 'w')}
    SELECT point_id, round(lat, 6) AS lat, round(lon, 6) AS lon, e AS easting, n AS northing,
        round(6378137 * radians(lon), 0) AS mercator_x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 0) AS mercator_y FROM w""")
def grid_roundtrip(i: Inputs):
    """Grid metres to degrees and back, and on to Mercator."""
    there = crs.bng_to_wgs84(i.bind("point").select("point_id", "easting", "northing"))
    back = crs.wgs84_to_bng(there.select("point_id", "lat", "lon"))
    return back.select(
        "point_id", _r("lat"), _r("lon"), F.round("easting", 2).alias("easting"), F.round("northing", 2).alias("northing"),
        F.round(crs.mercator_x(F.col("lon")), 0).alias("mercator_x"), F.round(crs.mercator_y(F.col("lat")), 0).alias("mercator_y"),
    )


_VARIANTS = f"""
    v0 AS (SELECT region_id, lower(name) AS l, {admin_sql('name')} AS nm FROM region_ring),
    v AS (SELECT region_id, 0 AS i, l AS key FROM v0 UNION ALL SELECT region_id, 1, nm FROM v0 WHERE nm <> ''
          UNION ALL SELECT region_id, 2, replace(l, ' (b)', '') FROM v0 WHERE contains(l, ' (b)')
          UNION ALL SELECT region_id, 3, trim(left(l, CAST(length(l) - 9 AS BIGINT))) FROM v0 WHERE ends_with(l, ' district')
          UNION ALL SELECT region_id, 4, trim(left(l, CAST(length(l) - 8 AS BIGINT))) FROM v0 WHERE ends_with(l, ' borough')),
    keys AS (SELECT key, region_id AS polygon_id, i FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY region_id, i) AS rn FROM v) WHERE rn = 1)"""


def _admin_names(i: Inputs):
    polygons = i.bind("region_ring").select(F.col("region_id").alias("polygon_id"), "name", F.lit(0).alias("layer_rank"))
    return geocode.admin_names(polygons)


@query("admin_variants", "region_ring", sql=f"WITH {_VARIANTS} SELECT key, polygon_id FROM keys")
def admin_variants(i: Inputs):
    return _admin_names(i).select("key", "polygon_id")


def _resolve_sql(source: str) -> str:
    return f"""
    qq AS (SELECT DISTINCT query, lower(trim(query)) AS q, {admin_sql('query')} AS qn FROM {source}),
    e AS (SELECT query, q, qn, (SELECT polygon_id FROM keys WHERE key = q) AS p1, (SELECT polygon_id FROM keys WHERE key = qn) AS p2 FROM qq),
    hit AS (SELECT query, polygon_id, row_number() OVER (PARTITION BY query ORDER BY length(key) DESC, polygon_id, i) AS rn
            FROM e, keys WHERE p1 IS NULL AND p2 IS NULL AND (contains(key, q) OR (qn <> '' AND contains(key, qn)) OR contains(q, key)
                               OR (qn <> '' AND contains(qn, key)))),
    res AS (SELECT e.query, coalesce(p1, p2, polygon_id) AS polygon_id, CASE WHEN p1 IS NOT NULL THEN 'exact' WHEN p2 IS NOT NULL THEN 'normalised'
                   WHEN polygon_id IS NOT NULL THEN 'overlap' END AS stage FROM e LEFT JOIN hit ON e.query = hit.query AND rn = 1)"""


@query("resolve_admin", "region_ring", "admin_text", sql=f"""WITH {_VARIANTS}, {_resolve_sql('admin_text')}
    SELECT query_id, t.query, polygon_id, stage FROM admin_text t JOIN res ON t.query = res.query""")
def resolve_admin(i: Inputs):
    return geocode.resolve_admin(i.bind("admin_text"), _admin_names(i))


_ALTERNATES = "SELECT query_id, concat('Atlantis|', CASE WHEN query_id % 2 = 0 THEN ' | Lemuria |' ELSE '' END, query, '|NATION_1') AS query FROM admin_text"


@query("resolve_alternates", "region_ring", "admin_text", sql=f"""WITH {_VARIANTS}, a AS ({_ALTERNATES}),
    x AS (SELECT query_id, unnest(string_split(query, '|')) AS raw, unnest(range(1, 9)) AS pos FROM a),
    y AS (SELECT query_id, pos, trim(raw) AS query FROM x WHERE raw IS NOT NULL AND trim(raw) <> ''), {_resolve_sql('y')},
    z AS (SELECT query_id, y.query AS matched_variant, polygon_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn
          FROM y JOIN res ON y.query = res.query WHERE polygon_id IS NOT NULL)
    SELECT query_id, matched_variant, polygon_id FROM z WHERE rn = 1""")
def resolve_alternates(i: Inputs):
    """First of several names that resolves."""
    asked = i.spark.sql(_ALTERNATES.replace("FROM admin_text", "FROM {admin_text}"), admin_text=i.bind("admin_text"))
    return geocode.resolve_alternates(asked, _admin_names(i))


def region_shapes(i: Inputs, degrees: bool = False):
    """region_id, geom of the areas; `degrees` maps metres onto a small box of degrees."""
    r = i.bind("region_ring")

    def corner(k: int):
        x, y = F.col(f"x{k}"), F.col(f"y{k}")
        return (x / 100000 - 6, y / 100000 + 49) if degrees else (x, y)

    return r.select("region_id", multi_of_ring(*[corner(k) for k in range(4)]).alias("geom"))


def _odd_sql(px: str, py: str, fx: str = "{0}", fy: str = "{0}") -> str:
    sides = []
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        xa, ya, xb, yb = fx.format(f"x{a}"), fy.format(f"y{a}"), fx.format(f"x{b}"), fy.format(f"y{b}")
        sides.append(
            f"CASE WHEN (({ya}) > {py}) <> (({yb}) > {py}) AND {px} < ({xa}) + ({py} - ({ya})) * (({xb}) - ({xa})) / nullif(({yb}) - ({ya}), 0) THEN 1 ELSE 0 END"
        )
    return "(" + " + ".join(sides) + ") % 2 = 1"


@query("points_in_region", "point", "region_ring", sql=f"""
    SELECT point_id, r.region_id FROM point p JOIN region_ring r ON {_odd_sql('easting', 'northing')}""")
def points_in_region(i: Inputs):
    return cells.points_in_polygons(
        i.bind("point"), region_shapes(i), "point_id", "region_id", 50_000.0, "easting", "northing"
    )


_DX, _DY = "{0} / 100000 - 6", "{0} / 100000 + 49"


def _near_sql() -> str:
    sides = []
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        xa, ya, xb, yb = (d.format(f"{c}{k}") for k in (a, b) for c, d in (("x", _DX), ("y", _DY)))
        sides.append(f"SELECT point_id, region_id, lat, lon, {xa} AS xa, {ya} AS ya, {xb} AS xb, {yb} AS yb FROM j")
    return f"""
    j AS (SELECT p.point_id, p.lat, p.lon, r.* FROM point p JOIN region_ring r USING (region_id)),
    side AS ({' UNION ALL '.join(sides)}),
    tt AS (SELECT *, greatest(0, least(1, ((lon - xa) * (xb - xa) + (lat - ya) * (yb - ya)) / ((xb - xa) ^ 2 + (yb - ya) ^ 2))) AS t FROM side),
    sp AS (SELECT *, xa + t * (xb - xa) AS nx, ya + t * (yb - ya) AS ny FROM tt),
    rk AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY (nx - lon) ^ 2 + (ny - lat) ^ 2) AS rn FROM sp),
    ins AS (SELECT point_id, {_odd_sql('lon', 'lat', _DX, _DY)} AS inside FROM j)"""


@query("area_check", "point", "region_ring", sql=f"""WITH {_near_sql()}
    SELECT rk.point_id, region_id, inside, CASE WHEN inside THEN 0.0::DOUBLE ELSE round({sqlgeo.haversine_km('lat', 'lon', 'ny', 'nx')}, 2) END AS distance_km
    FROM rk JOIN ins ON rk.point_id = ins.point_id WHERE rn = 1""")
def area_check(i: Inputs):
    """Is a point inside its area, and how far is it from the boundary?"""
    points = i.bind("point").select("point_id", "region_id", "lat", "lon")
    return check_in_area(points, region_shapes(i, True), "point_id", "region_id", 0.5)


@query("fallback_centre", "point", "region_ring", sql=f"""WITH
    c AS (SELECT region_id, (x0 + x1 + x2 + x3) / 4 AS mx, (y0 + y1 + y2 + y3) / 4 AS my, least(x0, x3) / 100000 - 6 AS x_lo, greatest(x1, x2) / 100000 - 6 AS x_hi,
                 least(y0, y1) / 100000 + 49 AS y_lo, greatest(y2, y3) / 100000 + 49 AS y_hi FROM region_ring),
    d AS (SELECT region_id, mx / 100000 - 6 AS lon, my / 100000 + 49 AS lat, x_hi - x_lo AS w, y_hi - y_lo AS h FROM c),
    s AS (SELECT region_id, lat, lon, greatest(2000, least(CAST(trunc(greatest(w * 111000 * cos(radians(lat)), h * 111000) / 2) AS INT), 50000)) AS sigma FROM d)
    SELECT point_id AS case_id, round(coalesce(s.lat, 54), 6) AS lat, round(coalesce(s.lon, -2), 6) AS lon, CAST(coalesce(sigma, 50000) AS INT) AS sigma_m,
        CASE WHEN sigma IS NULL THEN 'country_centroid' ELSE 'area_centroid' END AS source
    FROM point p LEFT JOIN s ON s.region_id = CASE WHEN point_id % 5 = 0 THEN NULL ELSE p.region_id END""")
def fallback_centre(i: Inputs):
    cases = i.bind("point").select(
        F.col("point_id").alias("case_id"), F.when(F.col("point_id") % 5 != 0, F.col("region_id")).alias("polygon_id")
    )
    shapes = region_shapes(i, True).withColumnRenamed("region_id", "polygon_id")
    return geocode.fallback_centre(cases, shapes).select("case_id", _r("lat"), _r("lon"), "sigma_m", "source")


@query("haversine_pairs", "point", sql=f"""
    SELECT a.point_id, round({sqlgeo.haversine_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 1000, 4) AS distance_m
    FROM point a JOIN point b ON b.point_id = a.point_id + 1""")
def haversine_pairs(i: Inputs):
    p = i.bind("point").select("point_id", "lat", "lon")
    q = p.select((F.col("point_id") - 1).alias("point_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    away = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return p.join(q, "point_id").select("point_id", F.round(away, 4).alias("distance_m"))


@query("nearest_centre", "point", sql=f"""WITH
    p AS (SELECT region_id AS case_id, point_id AS seq, lat, lon FROM point),
    c AS (SELECT region_id AS case_id, min(lat) AS lat, min(lon) AS lon, 1 AS center_id FROM point WHERE region_id <> 7 GROUP BY 1
          UNION ALL SELECT region_id, max(lat), max(lon), 2 FROM point WHERE region_id <> 7 GROUP BY 1),
    d AS (SELECT p.case_id, seq, center_id, {sqlgeo.haversine_km('p.lat', 'p.lon', 'c.lat', 'c.lon')} * 1000 AS d FROM p LEFT JOIN c ON p.case_id = c.case_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id, seq ORDER BY d, center_id) AS rn FROM d)
    SELECT case_id, seq, center_id, round(d, 4) AS distance_m, coalesce(d <= 100, true) AS accepted FROM r WHERE rn = 1""")
def nearest_centre(i: Inputs):
    """Attempts against the nearest proposed centre; each region proposes two."""
    p = i.bind("point").select(F.col("region_id").alias("case_id"), F.col("point_id").alias("seq"), "lat", "lon")
    named = p.where("case_id <> 7").groupBy("case_id")
    low = named.agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")).withColumn("center_id", F.lit(1))
    high = named.agg(F.max("lat").alias("lat"), F.max("lon").alias("lon")).withColumn("center_id", F.lit(2))
    found = ranking.nearest_proposal(p, low.unionByName(high))
    return found.select("case_id", "seq", "center_id", _r("distance_m", 4), "accepted")


@query("pick_check", "point", sql=f"""WITH
    t AS (SELECT point_id AS case_id, lat AS top_lat, lon AS top_lon FROM point),
    s AS (SELECT point_id AS case_id, lat + 0.01 AS plat, lon AS plon FROM point WHERE point_id % 3 = 0
          UNION ALL SELECT point_id, lat, -lon FROM point WHERE point_id % 3 <> 2),
    d AS (SELECT t.case_id, min({sqlgeo.haversine_km('top_lat', 'top_lon', 'plat', 'plon')}) AS km FROM t LEFT JOIN s ON t.case_id = s.case_id GROUP BY 1)
    SELECT case_id, round(km, 6) AS min_km, coalesce(km <= 5, true) AS accepted FROM d""")
def pick_check(i: Inputs):
    """Picks against every coordinate that the tools of the case gave back as JSON."""
    p = i.bind("point")
    picks = p.select(F.col("point_id").alias("case_id"), F.col("lat").alias("top_lat"), F.col("lon").alias("top_lon"))
    own = p.where("point_id % 3 <> 2").select(
        F.col("point_id").alias("case_id"), F.to_json(F.struct("lat", (-F.col("lon")).alias("lon"))).alias("content")
    )
    hit = F.array(F.struct((F.col("lat") + 0.01).alias("lat"), "lon"))
    hits = p.where("point_id % 3 = 0").select(
        F.col("point_id").alias("case_id"), F.to_json(F.struct(hit.alias("hits"), F.lit(True).alias("success"))).alias("content")
    )
    checked = ranking.check_picks(picks, ranking.returned_points(own.unionByName(hits)))
    return checked.select("case_id", _r("min_km"), "accepted")


_SIGNALS = """
    SELECT CAST(floor(c_custkey / 4.0) AS BIGINT) AS case_id, c_custkey AS seq,
        CASE c_nationkey % 6 WHEN 0 THEN 'postcode' WHEN 1 THEN 'grid_ref' WHEN 2 THEN 'intersect' WHEN 3 THEN 'place' WHEN 4 THEN 'road' ELSE 'area' END AS source,
        52 + CAST(floor(c_custkey / 4.0) AS BIGINT) % 1000 / 1000.0 + (c_custkey * 7 % 10) / 1000.0 AS lat,
        -1 + CAST(floor(c_custkey / 4.0) AS BIGINT) % 700 / 1000.0 + (c_custkey * 3 % 11) / 1000.0 AS lon
    FROM customer"""


@query("consensus", sql=f"""WITH s AS (SELECT case_id, seq, source, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({_SIGNALS})),
    a AS (SELECT s.*, EXISTS (SELECT 1 FROM s t WHERE t.case_id = s.case_id AND t.seq <> s.seq
              AND {sqlgeo.haversine_km('s.lat', 's.lon', 't.lat', 't.lon')} * 1000 <= 500) AS agree FROM s),
    r AS (SELECT a.*, row_number() OVER (PARTITION BY case_id ORDER BY NOT agree,
              CASE source WHEN 'postcode' THEN 1 WHEN 'grid_ref' THEN 2 WHEN 'intersect' THEN 3 WHEN 'place' THEN 4 WHEN 'road' THEN 5 ELSE 6 END, seq) AS rn FROM a)
    SELECT case_id, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN agree THEN 200 ELSE CASE source WHEN 'place' THEN 800 WHEN 'road' THEN 1500 WHEN 'area' THEN 2500 ELSE 300 END END AS sigma_m,
        CASE WHEN agree THEN 'high' ELSE CASE source WHEN 'place' THEN 'med' WHEN 'road' THEN 'med' WHEN 'area' THEN 'low' ELSE 'high' END END AS confidence,
        agree AS consensus FROM r WHERE rn = 1""")
def consensus(i: Inputs):
    """One pick per case from up to four signals."""
    s = i.spark.sql(_SIGNALS.replace("FROM customer", "FROM {customer}"), customer=i.table("customer"))
    s = s.withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})
    picked = ranking.consensus(s)
    return picked.select("case_id", _r("lat"), _r("lon"), "sigma_m", "confidence", "consensus")


def road_table(i: Inputs):
    """Indexed roads: one two-point line per row."""
    r = i.bind("road_line").select(
        "road_id", "site", "name", F.lit("TL").alias("tile"), F.lit("Local Street").alias("cls"),
        F.array(point(F.col("x0"), F.col("y0")), point(F.col("x1"), F.col("y1"))).alias("points"),
    )
    return r.select("road_id", "site").join(
        roads.road_index(r.withColumn("tile", F.col("road_id").cast("string"))).withColumn(
            "road_id", F.col("tile").cast("bigint")
        ), "road_id",
    )


_ROADS_SQL = """
    rd AS (SELECT *, lower(name) AS name_lc, least(x0, x1) AS minx, least(y0, y1) AS miny, greatest(x0, x1) AS maxx, greatest(y0, y1) AS maxy FROM road_line)"""


@query("road_index", "road_line", sql=f"""WITH {_ROADS_SQL}
    SELECT name_lc, count(*) AS n, round(min(minx), 1) AS minx, round(max(maxy), 1) AS maxy, round(avg((minx + maxx) / 2), 4) AS mean_cx FROM rd GROUP BY 1""")
def road_index(i: Inputs):
    """Roads by lower-cased name."""
    t = road_table(i)
    return t.groupBy("name_lc").agg(
        F.count("*").alias("n"), F.round(F.min("minx"), 1).alias("minx"), F.round(F.max("maxy"), 1).alias("maxy"),
        F.round(F.avg("cx"), 4).alias("mean_cx"),
    )


_ROAD_ASK = """SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN concat(' ', c_mktsegment) ELSE concat(c_mktsegment, ' rd') END AS query,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(floor(c_custkey / 64.0) AS BIGINT) END AS area_id FROM customer"""


@query("road_lookup", "road_line", sql=f"""WITH {_ROADS_SQL}, ask AS ({_ROAD_ASK}),
    k AS (SELECT query_id, area_id, 0 AS pos, trim(lower(query)) AS key FROM ask UNION ALL SELECT query_id, area_id, 1, concat(trim(lower(query)), ' road') FROM ask),
    f AS (SELECT query_id, road_id, (minx + maxx) / 2 AS cx, row_number() OVER (PARTITION BY query_id ORDER BY pos, road_id) AS rn
          FROM k JOIN rd ON key = name_lc WHERE area_id IS NULL OR area_id = CAST(floor(road_id / 64.0) AS BIGINT))
    SELECT query_id, CAST(rn AS INT) AS hit, road_id, cx FROM f WHERE rn <= 5""")
def road_lookup(i: Inputs):
    """First five roads of a name, in an area (eight sites each) where one is given."""
    asked = i.spark.sql(_ROAD_ASK.replace("FROM customer", "FROM {customer}"), customer=i.table("customer"))
    table = road_table(i).withColumn("area_id", F.floor(F.col("road_id") / 64.0))
    return roads.lookup_roads(asked, table, 5).select("query_id", "hit", "road_id", "cx")


def _site_requests(i: Inputs):
    """Per site: its first and last road name within the site's box."""
    t = road_table(i)
    return t.groupBy("site").agg(
        F.array(F.min("name"), F.max("name"), F.lit("Missing Lane")).alias("names"),
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    ).withColumnRenamed("site", "request_id")


_JUNCTION_SQL = f"""{_ROADS_SQL},
    q AS (SELECT site, min(name) AS na, max(name) AS nb, min(minx) AS bx0, min(miny) AS by0, max(maxx) AS bx1, max(maxy) AS by1 FROM rd GROUP BY site),
    pr AS (SELECT q.site, na, nb, a.x0 AS ax, a.y0 AS ay, a.x1 - a.x0 AS dx, a.y1 - a.y0 AS dy, b.x0 AS cx, b.y0 AS cy, b.x1 - b.x0 AS fx, b.y1 - b.y0 AS fy
           FROM q JOIN rd a ON a.name_lc IN (lower(na), concat(lower(na), ' road')) AND NOT (a.maxx < bx0 OR a.minx > bx1 OR a.maxy < by0 OR a.miny > by1)
                  JOIN rd b ON b.name_lc IN (lower(nb), concat(lower(nb), ' road')) AND NOT (b.maxx < bx0 OR b.minx > bx1 OR b.maxy < by0 OR b.miny > by1)
           WHERE abs(a.x0 - b.x0) < 1000 AND abs(a.y0 - b.y0) < 1000),
    tu AS (SELECT *, ((cx - ax) * fy - (cy - ay) * fx) / nullif(dx * fy - dy * fx, 0) AS t, ((cx - ax) * dy - (cy - ay) * dx) / nullif(dx * fy - dy * fx, 0) AS u,
                  dx * fy - dy * fx AS turn, ((cx - ax) * dx + (cy - ay) * dy) / nullif(dx * dx + dy * dy, 0) AS p,
                  ((cx + fx - ax) * dx + (cy + fy - ay) * dy) / nullif(dx * dx + dy * dy, 0) AS s FROM pr),
    pt AS (SELECT *, CASE WHEN turn <> 0 AND t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN t
                          WHEN turn = 0 AND (cx - ax) * dy - (cy - ay) * dx = 0 AND greatest(0, least(p, s)) <= least(1, greatest(p, s))
                          THEN (greatest(0, least(p, s)) + least(1, greatest(p, s))) / 2 END AS w FROM tu)"""


@query("road_crossings", "road_line", sql=f"""WITH {_JUNCTION_SQL}
    SELECT DISTINCT site AS request_id, na AS name_a, nb AS name_b, round(ax + w * dx, 1) AS x, round(ay + w * dy, 1) AS y FROM pt WHERE w IS NOT NULL""")
def road_crossings(i: Inputs):
    """Junctions of two roads of every site."""
    asked = _site_requests(i).withColumn("names", F.slice("names", 1, 2))
    met = roads.junctions(asked, road_table(i), 100.0)
    return met.select("request_id", "name_a", "name_b", _r("x", 1), _r("y", 1))


@query("roads_missing", "road_line", sql=f"""WITH {_ROADS_SQL},
    q AS (SELECT site, min(name) AS na, max(name) AS nb, min(minx) AS bx0, min(miny) AS by0, max(maxx) AS bx1, max(maxy) AS by1 FROM rd GROUP BY site),
    ask AS (SELECT q.site, unnest([q.na, q.nb, CASE WHEN q.site % 3 = 0 THEN 'Missing Lane' WHEN q.site % 3 = 1 THEN f.nb END]) AS asked, q.bx0, q.by0, q.bx1, q.by1
            FROM q LEFT JOIN q f ON f.site = q.site + 1)
    SELECT site AS request_id, asked FROM ask WHERE asked IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM rd WHERE name_lc IN (trim(lower(asked)), concat(trim(lower(asked)), ' road'))
            AND NOT (maxx < bx0 OR minx > bx1 OR maxy < by0 OR miny > by1))""")
def roads_missing(i: Inputs):
    """Asked roads without a line in the request's box: none of the name at all, or the next site's road, out of reach."""
    own = _site_requests(i).withColumn("names", F.slice("names", 1, 2))
    after = own.select((F.col("request_id") - 1).alias("request_id"), F.col("names")[1].alias("far"))
    third = F.when(F.col("request_id") % 3 == 0, F.lit("Missing Lane")).when(F.col("request_id") % 3 == 1, F.col("far"))
    asked = own.join(after, "request_id", "left").withColumn("names", F.array_compact(F.concat("names", F.array(third))))
    return roads.missing_roads(asked, road_table(i))


_SITE_POINTS = "sp AS (SELECT site AS point_id, min(minx) + 50 AS x, min(miny) + 50 AS y FROM rd GROUP BY site)"


def _site_points(i: Inputs):
    return road_table(i).groupBy(F.col("site").alias("point_id")).agg(
        (F.min("minx") + 50).alias("x"), (F.min("miny") + 50).alias("y")
    )


@query("roads_nearby", "road_line", sql=f"""WITH {_ROADS_SQL}, {_SITE_POINTS}
    SELECT DISTINCT point_id, trim(name) AS name FROM sp JOIN rd ON maxx >= x - 1500 AND minx <= x + 1500 AND maxy >= y - 1500 AND miny <= y + 1500""")
def roads_nearby(i: Inputs):
    return roads.roads_nearby(_site_points(i), road_table(i))


@query("road_overlap")
def road_overlap(i: Inputs):
    """Named roads of a document that exist near its site, exactly or nearly."""
    near = roads.roads_nearby(_site_points(i), road_table(i)).withColumnRenamed("point_id", "request_id")
    asked = _site_requests(i).select("request_id", F.concat("names", F.array(F.lit("Machinery Rod"))).alias("names"))
    return roads.road_overlap(asked, near)


_LAYERS = """SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'roads_local' WHEN 1 THEN 'roads_regional' ELSE 'roads_national' END AS layer,
    CASE l_returnflag WHEN 'A' THEN 'Motorway' WHEN 'N' THEN 'Track' END AS type, CAST(15 + l_suppkey % 5 AS INT) AS zoom FROM lineitem"""


@query("paint_order", sql=f"""WITH l AS ({_LAYERS}),
    c AS (SELECT *, coalesce(type, CASE layer WHEN 'roads_local' THEN 'Local Street' WHEN 'roads_regional' THEN 'B Road' ELSE 'A Road' END) AS cls, 2.0 ^ (zoom - 17) AS s FROM l),
    w AS (SELECT *, CASE cls WHEN 'Motorway' THEN 0 WHEN 'A Road' THEN 1 WHEN 'B Road' THEN 2 ELSE 4 END AS paint_order,
        CASE cls WHEN 'Motorway' THEN 6 WHEN 'A Road' THEN 4 WHEN 'B Road' THEN 3 ELSE 1.5 END AS f,
        CASE cls WHEN 'Motorway' THEN 8 WHEN 'A Road' THEN 6 WHEN 'B Road' THEN 5 ELSE 2.5 END AS g FROM c)
    SELECT cls, zoom, paint_order, CAST(greatest(1, trunc(f * s)) AS INT) AS fill_width, CAST(greatest(1, trunc(g * s)) AS INT) AS casing_width,
        CASE cls WHEN 'Motorway' THEN '180,200,255' WHEN 'A Road' THEN '200,220,255' ELSE '255,255,255' END AS colour, count(*) AS n
    FROM w GROUP BY ALL""")
def paint_order(i: Inputs):
    """Style table of merged road layers."""
    layers = i.spark.sql(_LAYERS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=i.table("lineitem"))
    parts = [layers.where(F.col("layer") == name) for name in roads.LAYER_DEFAULTS]
    merged = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    styled = roads.paint_table(merged, F.col("zoom"))
    return styled.groupBy("cls", "zoom", "paint_order", "fill_width", "casing_width", "colour").agg(F.count("*").alias("n"))
