"""Queries of the text family: normal forms, parsing and record rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sitewise.functions import geo, geometry, rules
from sitewise.functions import text as tx
from sitewise.operators import ranking
from sitewise.plans.bindings import Inputs
from sitewise.plans.registry import query

_SUFFIX_VALUES = ", ".join(f"({n + 1}, '{w}')" for n, w in enumerate(tx.PLACE_QUALIFIERS))
CANDIDATE_SQL = f"""
    base AS (SELECT query_id, context, lower(trim(query)) AS base FROM name_query WHERE trim(query) <> ''),
    cands AS (SELECT query_id, context, 0 AS cand_pos, base AS cand FROM base UNION ALL
              SELECT query_id, context, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) AS INT),
                     trim(left(base, CAST(length(base) - length(w) AS BIGINT)))
              FROM base JOIN (VALUES {_SUFFIX_VALUES}) q(i, w) ON ends_with(base, w) AND length(base) > length(w) + 2)"""


@query("query_candidates", "name_query", sql=f"WITH {CANDIDATE_SQL} SELECT query_id, cand_pos, cand FROM cands")
def query_candidates(i: Inputs):
    return i.bind("name_query").select("query_id", F.posexplode(tx.query_candidates(F.col("query"))).alias("cand_pos", "cand"))


def _chain_sql(expr: str, words, template: str) -> str:
    for w in words:
        expr = f"trim(regexp_replace({expr}, '{template.format(re.escape(w).replace(chr(92) + ' ', ' '))}', ''))"
    return expr


CONTEXT_SQL = f"""
    ctx AS (SELECT query_id, context, {_chain_sql("lower(trim(context))", tx.CONTEXT_SUFFIXES, '{}$')} AS t FROM name_query
            WHERE context IS NOT NULL),
    tokens AS (SELECT query_id, context, token FROM (SELECT query_id, context, unnest(string_split(replace(t, ',', ' '), ' ')) AS token
               FROM ctx) WHERE length(token) > 2)"""


@query("context_tokens", "name_query", sql=f"WITH {CONTEXT_SQL} SELECT query_id, token FROM tokens")
def context_tokens(i: Inputs):
    asked = i.bind("name_query").where("context IS NOT NULL")
    return asked.select("query_id", F.explode(tx.context_tokens(F.col("context"))).alias("token"))


@query("postcode_forms", "postcode_query", sql="""WITH
    c AS (SELECT query_id, upper(replace(trim(text), ' ', '')) AS t FROM postcode_query),
    n AS (SELECT query_id, CASE WHEN length(t) < 5 THEN t ELSE concat(left(t, CAST(length(t) - 3 AS BIGINT)), ' ', right(t, 3)) END AS postcode FROM c)
    SELECT query_id, postcode, lower(regexp_extract(postcode, '^([A-Z]+)', 1)) AS area FROM n""")
def postcode_forms(i: Inputs):
    asked = i.bind("postcode_query").select("query_id", tx.normalise_postcode(F.col("text")).alias("postcode"))
    return asked.withColumn("area", tx.postcode_area(F.col("postcode")))


def admin_sql(name: str) -> str:
    expr = f"replace(lower(trim({name})), '.', '')"
    expr = f"regexp_replace({expr}, '\\s*\\(b\\)$', '')"
    expr = f"regexp_replace({expr}, '\\s*\\((district|borough|county|unitary|metro)\\)$', '')"
    return _chain_sql(_chain_sql(expr, tx.ADMIN_SUFFIXES, "{}$"), tx.ADMIN_PREFIXES, "^{}")


@query("admin_forms", "admin_text", sql=f"WITH n AS (SELECT query_id, {admin_sql('query')} AS normal FROM admin_text) SELECT * FROM n")
def admin_forms(i: Inputs):
    return i.bind("admin_text").select("query_id", tx.normalise_admin(F.col("query")).alias("normal"))


@query("road_forms", "road_line", sql="""
    SELECT road_id, array_to_string(list_transform(list_filter(
        string_split(regexp_replace(lower(name), '[^\\w\\s]', ' ', 'g'), ' '), lambda t: t <> ''),
        lambda t: CASE t WHEN 'rd' THEN 'road' WHEN 'ave' THEN 'avenue' WHEN 'cl' THEN 'close' ELSE t END), ' ') AS normal
    FROM road_line""")
def road_forms(i: Inputs):
    return i.bind("road_line").select("road_id", tx.normalise_road(F.col("name")).alias("normal"))


@query("scale_forms", "grid_text", sql="""WITH
    s AS (SELECT id, text, CAST(replace(nullif(regexp_extract(text, '1\\s*[:/]\\s*([\\d,]+)', 1), ''), ',', '') AS INT) AS scale FROM grid_text),
    m AS (SELECT *, 25.4 / 200 / 1000.0 * CAST(scale AS DOUBLE) AS mpp FROM s)
    SELECT id, scale, coalesce(regexp_matches(text, '\\b1\\s*[:/]\\s*\\d'), false) AS has_scale, round(mpp, 6) AS mpp,
        CAST(greatest(15, least(19, round_even(log2(156543.03 * cos(radians(52.5)) / mpp), 0))) AS INT) AS zoom,
        CAST(CASE WHEN scale IS NULL THEN 2500 ELSE greatest(150, CAST(trunc(0.5 * sqrt(297.0^2 + 210.0^2) / 1000 * scale) AS INT)) END AS INT) AS sigma_m,
        CAST(CASE WHEN id % 4 = 0 THEN 321.5 WHEN id % 3 = 0 THEN 900 WHEN scale IS NULL THEN 2500
             ELSE greatest(150, trunc(0.5 * sqrt(297.0^2 + 210.0^2) / 1000 * scale)) END AS DOUBLE) AS effective_m
    FROM m""")
def scale_forms(i: Inputs):
    """Map scale, ground resolution, matching zoom and search radius of a text."""
    scale = tx.scale_denominator(F.col("text"))
    rows = i.bind("grid_text").withColumn("scale", scale).withColumn("mpp", geo.map_mpp(F.col("scale")))
    given = F.when(F.col("id") % 4 == 0, F.lit(321.5))
    candidate = F.when(F.col("id") % 3 == 0, F.lit(900.0)).otherwise(F.lit(0.0))
    return rows.select(
        "id", "scale", tx.has_scale(F.col("text")).alias("has_scale"), F.round("mpp", 6).alias("mpp"),
        geo.best_zoom(F.col("mpp"), F.lit(52.5)).alias("zoom"), geo.sigma_from_scale(F.col("scale")).alias("sigma_m"),
        geo.effective_sigma(given, candidate, F.col("scale")).alias("effective_m"),
    )


_NAMES = "SELECT l_orderkey AS k, concat('12:', CAST(l_orderkey AS STRING), '/A(', CAST(l_linenumber AS STRING), 'a)_p', CAST(l_suppkey AS STRING)) AS name FROM lineitem"


@query("case_keys", sql=f"""WITH n AS ({_NAMES})
    SELECT name, replace(replace(name, ':', '_'), '/', '_') AS case_name, regexp_replace(name, '_p[0-9]+$', '') AS page_case,
        replace(replace(regexp_replace(replace(replace(name, ':', '_'), '/', '_'), '_p[0-9]+$', ''), '(', '_'), ')', '_') AS route_key,
        regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS filename, replace(replace(concat('a b/', name), ' ', '_'), '/', '_') AS prompt
    FROM n""")
def case_keys(i: Inputs):
    n = i.spark.sql(_NAMES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=i.table("lineitem"))
    c = F.col("name")
    return n.select(
        "name", tx.case_name(c).alias("case_name"), tx.page_case(c).alias("page_case"), tx.route_key(c).alias("route_key"),
        tx.safe_filename(c).alias("filename"), tx.prompt_dirname(F.concat(F.lit("a b/"), c)).alias("prompt"),
    )


_BLANKS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '   ' ELSE concat(' ', o_orderpriority, ' ') END AS raw FROM orders"


@query("blank_strings", sql=f"WITH b AS ({_BLANKS}) SELECT id, trim(coalesce(raw, '')) AS safe, nullif(trim(coalesce(raw, '')), '') AS maybe FROM b")
def blank_strings(i: Inputs):
    b = i.spark.sql(_BLANKS.replace("FROM orders", "FROM {orders}"), orders=i.table("orders"))
    return b.select("id", tx.blank_safe(F.col("raw")).alias("safe"), tx.blank_to_null(F.col("raw")).alias("maybe"))


@query("dedup_calls", "attempt", sql="""WITH
    f AS (SELECT case_id, seq, concat(center, ':', md5(concat('{"area_group":', CAST(area_group AS STRING), ',"zoom":', CAST(zoom AS STRING), '}'))) AS fingerprint FROM attempt)
    SELECT case_id, min(seq) AS seq, fingerprint FROM f GROUP BY case_id, fingerprint""")
def dedup_calls(i: Inputs):
    """First call of each tool with the same arguments."""
    calls = i.bind("attempt").select(
        "case_id", "seq", tx.call_fingerprint(F.col("center"), F.struct("area_group", "zoom")).alias("fingerprint")
    )
    return ranking.first_calls(calls)


@query("public_fields", sql="SELECT doc_id, concat('lang=', lang, ',source=', source) AS fields FROM documents")
def public_fields(i: Inputs):
    info = F.create_map(F.lit("_tokens"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    entries = F.transform(F.map_entries(tx.public_fields(info)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return i.table("documents").select("doc_id", F.array_join(entries, ",").alias("fields"))


@query("prepend_terms", sql="""
    SELECT c_custkey AS id, concat(CASE WHEN c_nationkey <> 3 THEN concat('N', CAST(c_nationkey AS STRING), '|') ELSE '' END,
        CASE WHEN c_mktsegment NOT IN ('BUILDING') THEN concat(c_mktsegment, '|') ELSE '' END, 'BUILDING|N3') AS terms FROM customer""")
def prepend_terms(i: Inputs):
    old = F.array(F.lit("BUILDING"), F.lit("N3"))
    new = F.array(F.concat(F.lit(" "), F.col("c_mktsegment")), F.lit("  "), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return i.table("customer").select(F.col("c_custkey").alias("id"), F.array_join(tx.prepend_terms(old, new), "|").alias("terms"))


_PICK = """SELECT point_id, lat - 1.2 AS top_lat, lon * 2 AS top_lon, CAST(point_id % 700 AS INT) AS sigma_m,
    CASE point_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'med' WHEN 2 THEN 'low' ELSE 'sure' END AS confidence FROM point"""


@query("record_rules", "point", sql=f"""WITH p AS ({_PICK})
    SELECT point_id, 'lat_range' AS rule FROM p WHERE NOT (top_lat BETWEEN 49.5 AND 61)
    UNION ALL SELECT point_id, 'lon_range' FROM p WHERE NOT (top_lon BETWEEN -9 AND 2)
    UNION ALL SELECT point_id, 'sigma_range' FROM p WHERE NOT (sigma_m BETWEEN 100 AND 50000)
    UNION ALL SELECT point_id, 'confidence_word' FROM p WHERE confidence NOT IN ('high', 'med', 'low')""")
def record_rules(i: Inputs):
    """Broken rules of located picks, one row each."""
    picks = i.spark.sql(_PICK.replace("FROM point", "FROM {point}"), point=i.bind("point"))
    return rules.violations(picks, ["point_id"], rules.location_rules())


@query("document_rules", sql="""WITH d AS (SELECT doc_id, lang, source, n_chars, regexp_matches(text, '[^\\x{0000}-\\x{024F}]') AS foreign_letters FROM documents)
    SELECT doc_id, 'latin_place_names' AS rule FROM d WHERE foreign_letters
    UNION ALL SELECT doc_id, 'key_lists_present' FROM d WHERE n_chars % 3 = 0 AND n_chars % 2 = 0
    UNION ALL SELECT doc_id, 'not_default' FROM d WHERE n_chars % 3 = 0 AND n_chars % 2 = 1 AND n_chars % 5 <> 0""")
def document_rules(i: Inputs):
    """Broken rules of extracted records; whole texts stand in for their place names."""
    c, none = F.col("n_chars"), F.lit(None)
    named = F.when(c % 3 != 0, F.array("text"))
    # A text with foreign letters breaks the Latin rule also where the record is otherwise empty.
    rows = i.table("documents").select(
        "doc_id", "text", c, named.alias("place_names"),
        F.when(c % 2 == 0, F.lit("1 High Street")).otherwise("").alias("site_address"),
        (c % 5 == 0).alias("is_district_wide"),
        *[none.cast("array<string>").alias(n) for n in (
            "road_names", "visible_map_labels", "house_number_road_pairs", "parish_names", "postcodes", "grid_refs",
            "map_pages", "map_page_details", "adjacency_hints")],
        *[none.cast("string").alias(n) for n in ("scale", "district_name", "admin_region", "likely_town_or_city")],
    )
    checks = rules.record_rules()
    checks["latin_place_names"] = ~tx.has_foreign_letters(F.array("text"))
    return rules.violations(rows, ["doc_id"], checks)


@query("page_rules", sql="""
    SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS page, 'category_word' AS rule FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT l_orderkey, CAST(l_linenumber AS INT), 'detail_word' FROM lineitem WHERE l_linestatus = 'F'""")
def page_rules(i: Inputs):
    rows = i.table("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"),
        F.when(F.col("l_returnflag") == "R", "other").otherwise("match").alias("category"),
        F.lit("clear").alias("boundary_clarity"),
        F.when(F.col("l_linestatus") == "F", None).otherwise("wide").alias("detail_level"),
    )
    return rules.violations(rows, ["doc_id", "page"], rules.page_rules())


@query("outcome_gate", "attempt", sql="""WITH
    t AS (SELECT case_id, CAST(sum(CASE WHEN has_valid_affine AND area_group = 0 AND n_inliers > 120 THEN n_inliers ELSE 0 END) AS BIGINT) AS total FROM attempt GROUP BY case_id),
    s AS (SELECT case_id, total, CASE case_id % 3 WHEN 0 THEN 'district_lookup' WHEN 1 THEN 'accepted' ELSE 'other' END AS status,
                 case_id % 4 = 1 AS has_geometry, case_id % 5 <> 0 AS has_record FROM t)
    SELECT case_id, 'status_word' AS rule FROM s WHERE status = 'other'
    UNION ALL SELECT case_id, 'record_present' FROM s WHERE NOT has_record
    UNION ALL SELECT case_id, 'district_polygon' FROM s WHERE status = 'district_lookup' AND NOT has_geometry
    UNION ALL SELECT case_id, 'match_result' FROM s WHERE status = 'accepted' AND total = 0 AND NOT has_geometry""")
def outcome_gate(i: Inputs):
    """Result rows whose preconditions do not hold; the inlier total comes from the attempts."""
    strong = F.col("has_valid_affine") & (F.col("area_group") == 0) & (F.col("n_inliers") > 120)
    totals = i.bind("attempt").groupBy("case_id").agg(F.sum(F.when(strong, F.col("n_inliers")).otherwise(0)).alias("total_inliers"))
    c = F.col("case_id")
    rows = totals.select(
        "case_id", "total_inliers",
        F.when(c % 3 == 0, "district_lookup").when(c % 3 == 1, "accepted").otherwise("other").alias("status"),
        F.when(c % 4 == 1, "{}").alias("geojson"), (c % 5 != 0).alias("has_record"),
    )
    return rules.violations(rows, ["case_id"], rules.outcome_rules())


@query("tier_labels", "attempt", sql="""
    SELECT seq, CASE WHEN n_inliers >= 100 THEN 'STRONG' WHEN n_inliers >= 50 THEN 'OK' WHEN n_inliers >= 25 THEN 'WEAK' ELSE 'TOO WEAK' END AS inlier_tier,
        CASE WHEN avg_scale >= 0.8 THEN 'GOOD' WHEN avg_scale >= 0.5 THEN 'MARGINAL' ELSE 'BAD' END AS scale_tier,
        CASE n_road_matched WHEN 0 THEN 'CONFLICT' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'NEUTRAL' ELSE 'STRONG' END AS road_tier,
        CASE WHEN avg_scale >= 0.8 THEN 'PASS' WHEN avg_scale >= 0.5 THEN 'OK' ELSE 'WEAK' END AS mark,
        CASE area_group WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END AS specificity
    FROM attempt""")
def tier_labels(i: Inputs):
    road = F.col("n_road_matched") / 4
    confidence = F.element_at(F.array(F.lit("high"), F.lit("med"), F.lit("low")), F.col("area_group") + 1)
    return i.bind("attempt").select(
        "seq", tx.inlier_tier(F.col("n_inliers")).alias("inlier_tier"), tx.scale_tier(F.col("avg_scale")).alias("scale_tier"),
        tx.road_tier(road).alias("road_tier"), tx.iou_mark(F.col("avg_scale")).alias("mark"),
        tx.confidence_specificity(confidence).alias("specificity"),
    )


_DOCS = """
    SELECT o_orderkey AS id, CASE o_orderkey % 6
        WHEN 0 THEN concat('{{"type":"Feature","properties":{{}},"geometry":{{"type":"Polygon","coordinates":[[[', x, ',52],[', x, ',53],[2,53],[', x, ',52]]]}}}}')
        WHEN 1 THEN concat('{{"type":"Feature","geometry":{{"type":"MultiPolygon","coordinates":[[[[', x, ',52],[1,53],[2,53],[', x, ',52]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}}}')
        WHEN 2 THEN '{{"type":"Polygon","coordinates":[]}}' WHEN 3 THEN '{{"type":"Feature","geometry":null}}'
        WHEN 4 THEN '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[1,2]}}}}'
        ELSE concat('{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[52.5,', x, '],[53,0],[53,1],[52.5,', x, ']]]}}}}') END AS doc
    FROM (SELECT o_orderkey, CAST(o_orderkey % 2 AS STRING) AS x FROM {orders})"""


@query("polygon_format", sql="""
    SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 2 THEN 'Expected ''Feature'', got ''Polygon''' WHEN 3 THEN 'Missing ''geometry'' field'
        WHEN 4 THEN 'Expected ''MultiPolygon'' or ''Polygon'', got ''Point''' ELSE '' END AS reason,
        CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 5 THEN 1 END AS n_polygons, o_orderkey % 6 = 5 AS swapped
    FROM orders""")
def polygon_format(i: Inputs):
    """Format check, number of polygons and swapped axes of GeoJSON texts."""
    docs = i.spark.sql(_DOCS, orders=i.table("orders"))
    docs = docs.withColumn("geom", geometry.parse_geometry(F.col("doc")))
    return docs.select(
        "id", geometry.format_reason(F.col("doc")).alias("reason"),
        F.when(F.col("geom").isNotNull(), F.size("geom")).alias("n_polygons"),
        geometry.swapped_axes(F.col("geom")).alias("swapped"),
    )


@query("vertex_ranges", sql="""
    SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 1200 > 1000 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 1100 > 1000 THEN 1 ELSE 0 END AS INT) AS n_outside,
        round((o_orderkey % 700) * 800 / 1000.0, 6) AS first_x, round((o_orderkey % 1200) * 600 / 1000.0, 6) AS first_y FROM orders""")
def vertex_ranges(i: Inputs):
    """Normalised (y, x) vertices outside their range, and the first one in pixels."""
    k = F.col("o_orderkey")
    pairs = F.array(F.array(k % 1200, k % 700), F.array(k % 1100, k % 900), F.array(F.lit(5).cast("bigint"), k % 3))
    rows = i.table("orders").select(k.alias("id"), F.transform(pairs, lambda p: F.transform(p, lambda v: v.cast("double"))).alias("v"))
    scaled = geometry.scale_vertices(F.col("v"), F.lit(800), F.lit(600))
    return rows.select(
        "id", geometry.vertices_out_of_range(F.col("v")).alias("n_outside"),
        F.round(F.get(scaled, F.lit(0))["x"], 6).alias("first_x"), F.round(F.get(scaled, F.lit(0))["y"], 6).alias("first_y"),
    )
