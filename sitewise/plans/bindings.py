"""Bindings: the given tables in the shapes the operators read, as SQL both engines run.

Every binding covers its whole table. The text is formatted with the table names, so the same
text serves as the input of a query and as the common table expression of its check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

BINDINGS: dict[str, str] = {
    # One row per scored page; the last four columns give rows of one page their order.
    "case_page": """
        SELECT concat('C', CAST(l_orderkey AS STRING), '_p', CAST(l_linenumber AS STRING)) AS page_id,
               concat('prompt_', CAST(l_linenumber AS STRING)) AS method,
               CASE WHEN l_returnflag = 'A' THEN round(l_discount * 10, 6) END AS iou,
               CASE WHEN l_returnflag = 'A' THEN round(l_tax * 10, 6) END AS prec,
               CASE WHEN l_returnflag = 'A' THEN round(l_quantity / 50, 6) END AS rec,
               CASE WHEN l_returnflag = 'A' THEN l_extendedprice / 100 END AS err_m,
               CASE WHEN l_linestatus = 'O' THEN round(l_tax * 10, 6) END AS worker_first_iou,
               CASE l_returnflag WHEN 'R' THEN 'crashed' WHEN 'N' THEN 'no_prediction' ELSE 'ok' END AS status,
               l_quantity AS secs, CAST(l_orderkey % 5 AS INT) AS fold,
               l_shipdate AS s1, l_partkey AS s2, l_suppkey AS s3, l_extendedprice AS s4
        FROM {lineitem}""",
    # One row per case: page means, rounded so that a threshold does not hang on summing order.
    "case_result": """
        SELECT concat('C', CAST(l_orderkey AS STRING)) AS case_id,
               round(avg(CASE WHEN l_returnflag = 'A' THEN l_discount * 10 END), 9) AS iou,
               round(avg(CASE WHEN l_returnflag = 'A' THEN l_tax * 10 END), 9) AS prec,
               round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity / 50 END), 9) AS rec,
               round(avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice / 100 END), 7) AS err_m,
               round(avg(CASE WHEN l_linestatus = 'O' THEN l_tax * 10 END), 9) AS worker_first_iou,
               round(avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice / 90 END), 7) AS worker_first_err_m,
               CASE WHEN min(l_returnflag) = 'A' THEN 'ok' WHEN min(l_returnflag) = 'N' THEN 'no_prediction'
                    ELSE 'crashed' END AS status,
               CAST(max(l_orderkey % 5) AS INT) AS fold, max(l_quantity) AS secs
        FROM {lineitem} GROUP BY l_orderkey""",
    "case_label": """
        SELECT concat('C', CAST(o_orderkey AS STRING)) AS folder, o_custkey AS site,
               CASE o_orderstatus WHEN 'O' THEN ' White' WHEN 'F' THEN 'white' ELSE 'Yellow ' END AS colour,
               CASE WHEN o_orderkey % 7 = 0 THEN 'Bad?' WHEN o_orderkey % 3 = 0 THEN 'bad' ELSE 'Good' END AS quality,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'hard' WHEN '2' THEN 'Hard' WHEN '3' THEN 'medium?'
                    ELSE 'easy' END AS complexity,
               CASE WHEN o_orderkey % 25 = 0 THEN 'yes - almost' WHEN o_orderkey % 11 = 0 THEN 'yes - across 2 pages'
                    ELSE 'Yes' END AS shape_matches,
               o_totalprice / 1000 AS span_m
        FROM {orders}""",
    "place": """
        SELECT p_partkey AS row_id, p_name AS name1, p_type AS local_type, p_brand AS district_borough,
               concat('County ', CAST(p_size % 10 AS STRING)) AS county_unitary,
               CAST(NULL AS STRING) AS populated_place,
               CAST(100000 + (p_partkey * 7919) % 500000 AS DOUBLE) AS easting,
               CAST(50000 + (p_partkey * 104729) % 900000 AS DOUBLE) AS northing
        FROM {part}""",
    "name_query": """
        SELECT c.c_custkey AS query_id,
               CASE c.c_custkey % 4 WHEN 0 THEN p.p_name WHEN 1 THEN concat(upper(p.p_name), ' Village')
                    WHEN 2 THEN substr(p.p_name, 1, 4) ELSE replace(p.p_name, 'e', '') END AS query,
               CASE WHEN c.c_custkey % 3 = 0 THEN concat(p.p_brand, ' District')
                    WHEN c.c_custkey % 7 = 0 THEN 'Nowhere County' END AS context
        FROM {customer} c JOIN {part} p ON p.p_partkey = c.c_custkey""",
    "postcode": """
        SELECT concat('AB', CAST(c_custkey % 90 + 1 AS STRING), ' ',
                      CAST(CAST(floor(c_custkey / 90.0) AS INT) % 10 AS STRING),
                      substr('ABDEFGHJLN', CAST(floor(c_custkey / 900.0) AS INT) % 10 + 1, 1),
                      substr('PQRSTUWXYZ', CAST(floor(c_custkey / 9000.0) AS INT) % 10 + 1, 1)) AS postcode,
               CASE WHEN c_custkey % 50 = 0 THEN 90 ELSE 10 END AS quality,
               CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE CAST(380000 + c_custkey * 13 % 40000 AS INT) END AS easting,
               CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE CAST(790000 + c_custkey * 29 % 40000 AS INT) END AS northing,
               CAST(c_nationkey AS STRING) AS district_code, c_custkey AS seq
        FROM {customer}""",
    "postcode_query": """
        SELECT o_orderkey AS query_id,
               CASE WHEN o_orderkey % 13 = 0 THEN 'ab1' WHEN o_orderkey % 17 = 0 THEN '12 3XY'
                    ELSE concat(CASE WHEN o_orderkey % 2 = 0 THEN 'ab' ELSE ' AB' END,
                      CAST(o_custkey % 90 + 1 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE '' END,
                      CAST(CAST(floor(o_custkey / 90.0) AS INT) % 10 AS STRING),
                      substr('ABDEFGHJLN', CAST(floor(o_custkey / 900.0) AS INT) % 10 + 1, 1),
                      substr('pqrstuwxyz', CAST(floor(o_custkey / 9000.0) AS INT) % 10 + 1, 1)) END AS text
        FROM {orders}""",
    "admin_code": """
        SELECT n_name AS name, CAST(n_nationkey AS STRING) AS code, 1 AS sheet_rank, n_nationkey AS seq FROM {nation}
        UNION ALL
        SELECT concat('Unitary ', n_name), CAST(n_nationkey AS STRING), 2, n_nationkey FROM {nation}
        WHERE n_regionkey = 2""",
    "admin_text": """
        SELECT c_custkey AS query_id,
               CASE c_custkey % 9 WHEN 0 THEN concat(n_name, ' District Council') WHEN 1 THEN concat(' City of ', n_name)
                 WHEN 2 THEN concat('Royal Borough of ', n_name) WHEN 3 THEN concat(n_name, ' (B)')
                 WHEN 4 THEN concat(n_name, ' Metropolitan Borough Council') WHEN 5 THEN substr(n_name, 1, 6)
                 WHEN 6 THEN concat(n_name, ' district, Wessex') WHEN 7 THEN concat('St. ', n_name, ' Unitary')
                 ELSE concat('Atlantis ', c_mktsegment) END AS query
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "grid_text": """
        SELECT s_suppkey AS id,
               concat('T', substr('GQRLM', CAST(1 + s_suppkey % 5 AS INT), 1),
                      CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE '' END,
                      CASE s_suppkey % 6
                        WHEN 0 THEN concat(lpad(CAST(s_suppkey * 37 % 1000 AS STRING), 3, '0'), ' ',
                                           lpad(CAST(s_suppkey * 91 % 1000 AS STRING), 3, '0'))
                        WHEN 1 THEN lpad(CAST(s_suppkey * 3701 % 10000 AS STRING), 4, '0')
                        WHEN 2 THEN concat(lpad(CAST(s_suppkey * 37 % 1000 AS STRING), 3, '0'), ' ',
                                           lpad(CAST(s_suppkey * 7 % 100 AS STRING), 2, '0'), ' SE')
                        WHEN 3 THEN concat(lpad(CAST(s_suppkey * 3701 % 10000 AS STRING), 4, '0'), '-60')
                        WHEN 4 THEN concat(lpad(CAST(s_suppkey * 37 % 100 AS STRING), 2, '0'), ' NW')
                        ELSE concat(lpad(CAST(s_suppkey * 37013 % 100000 AS STRING), 5, '0')) END) AS grid_ref,
               concat('ref P12 at ', CAST(400000 + s_suppkey * 997 % 400000 AS STRING), ' E ',
                      CAST(100000 + s_suppkey * 1009 % 500000 AS STRING), ' N, scale 1:',
                      CAST((s_suppkey % 8 + 1) * 1250 AS STRING)) AS text
        FROM {supplier}""",
    "region_ring": """
        SELECT n_nationkey AS region_id, concat(n_name, ' District') AS name,
               CAST(100000 + (n_nationkey % 5) * 100000 AS DOUBLE) AS x0,
               CAST(60000 + floor(n_nationkey / 5.0) * 180000 AS DOUBLE) AS y0,
               CAST(190000 + (n_nationkey % 5) * 100000 AS DOUBLE) AS x1,
               CAST(80000 + floor(n_nationkey / 5.0) * 180000 AS DOUBLE) AS y1,
               CAST(180000 + (n_nationkey % 5) * 100000 AS DOUBLE) AS x2,
               CAST(230000 + floor(n_nationkey / 5.0) * 180000 AS DOUBLE) AS y2,
               CAST(90000 + (n_nationkey % 5) * 100000 AS DOUBLE) AS x3,
               CAST(210000 + floor(n_nationkey / 5.0) * 180000 AS DOUBLE) AS y3
        FROM {nation}""",
    "point": """
        SELECT c_custkey AS point_id, CAST(100000 + (c_custkey * 7919) % 500000 AS DOUBLE) AS easting,
               CAST(50000 + (c_custkey * 104729) % 900000 AS DOUBLE) AS northing,
               round(50.0 + ((c_custkey * 37) % 900) / 100.0, 6) AS lat,
               round(-5.0 + ((c_custkey * 53) % 650) / 100.0, 6) AS lon, c_nationkey AS region_id
        FROM {customer}""",
    "case_quad": """
        SELECT o_orderkey AS case_id, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS tx,
               CAST((o_orderkey * 53) % 1000 AS DOUBLE) AS ty, CAST(10 + o_orderkey % 7 AS DOUBLE) AS w,
               CAST(8 + o_orderkey % 5 AS DOUBLE) AS h, CAST(o_orderkey % 4 AS DOUBLE) AS skew,
               CAST(o_orderkey % 13 AS DOUBLE) - 4 AS dx, CAST(o_orderkey % 9 AS DOUBLE) - 3 AS dy
        FROM {orders}""",
    # Eight roads per site, sites 1 km apart, so the density does not depend on the table's size.
    "road_line": """
        SELECT c_custkey AS road_id, CAST(floor(c_custkey / 8.0) AS BIGINT) AS site,
               concat(c_mktsegment, ' ', CASE c_custkey % 3 WHEN 0 THEN 'Rd' WHEN 1 THEN 'Road' ELSE 'Ave.' END) AS name,
               CAST(CAST(floor(c_custkey / 8.0) AS BIGINT) % 500 * 1000 + (c_custkey * 37) % 100 AS DOUBLE) AS x0,
               CAST(CAST(floor(c_custkey / 4000.0) AS BIGINT) * 1000 + (c_custkey * 53) % 100 AS DOUBLE) AS y0,
               CAST(CAST(floor(c_custkey / 8.0) AS BIGINT) % 500 * 1000 + (c_custkey * 37) % 100 + 60
                    - (c_custkey % 7) * 20 AS DOUBLE) AS x1,
               CAST(CAST(floor(c_custkey / 4000.0) AS BIGINT) * 1000 + (c_custkey * 53) % 100 + 50
                    - (c_custkey % 5) * 25 AS DOUBLE) AS y1
        FROM {customer}""",
    "attempt": """
        SELECT user_id AS case_id, event_type AS center, CAST(15 + event_id % 5 AS INT) AS zoom, event_id AS seq,
               CAST(floor(value) AS INT) AS n_inliers, CAST(50 + event_id % 100 AS DOUBLE) / 100 AS avg_scale,
               CAST(event_id % 3 AS INT) AS area_group, event_id % 17 <> 0 AS has_valid_affine,
               CAST(event_id % 5 AS INT) AS n_road_matched, CAST(event_id % 7 AS INT) AS quadrants
        FROM {events}""",
    "tool_message": """
        SELECT conv_id AS case_id, turn, CASE WHEN role = 'user' THEN 'retryprompt' ELSE 'toolcall' END AS kind,
               CASE WHEN turn % 4 = 1 THEN 'match_at' WHEN turn % 4 = 3 THEN 'commit_match'
                    ELSE 'propose_centers' END AS tool_name, text
        FROM {conversations}""",
    "mask_run": """
        SELECT l_orderkey AS mask_id, CASE WHEN l_linenumber % 2 = 0 THEN 'pred' ELSE 'gt' END AS which,
               CAST(l_quantity AS INT) AS row_no, CAST(l_partkey % 50 AS INT) AS x_start,
               CAST(l_partkey % 50 + 1 + l_suppkey % 30 AS INT) AS x_end
        FROM {lineitem}""",
    "usage": """
        SELECT doc_id AS case_id, lang AS model, n_chars AS tokens_in, n_chars % 997 AS tokens_out,
               n_chars / 100.0 AS call_seconds, source
        FROM {documents}""",
    "epoch": """
        SELECT CAST(l_suppkey % 5 AS INT) AS fold, CAST(year(l_shipdate) AS INT) AS epoch,
               round(avg(l_discount), 4) AS val
        FROM {lineitem} GROUP BY 1, 2""",
}


def tables_of(name: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in BINDINGS[name]]


class Inputs:
    """The tables of one folder and the bindings over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def bind(self, name: str) -> DataFrame:
        tables = {t: self.table(t) for t in tables_of(name)}
        return self.spark.sql(BINDINGS[name], **tables)


def ctes(*names: str) -> str:
    """WITH clause over bindings for the checking engine (ends without a comma)."""
    plain = {t: t for t in TABLES}
    return "WITH " + ",\n".join(f"{n} AS ({BINDINGS[n].format(**plain)})" for n in names)
