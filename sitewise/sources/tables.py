"""Text, CSV and JSON scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions import text as tx
from sitewise.functions.geometry import parse_geometry
from sitewise.operators.union import union_geometries

# The columns of the headerless place-name file, in file order.
PLACE_COLUMNS = (
    "ID", "NAMES_URI", "NAME1", "NAME1_LANG", "NAME2", "NAME2_LANG", "TYPE", "LOCAL_TYPE", "GEOMETRY_X", "GEOMETRY_Y",
    "MOST_DETAIL_VIEW_RES", "LEAST_DETAIL_VIEW_RES", "MBR_XMIN", "MBR_YMIN", "MBR_XMAX", "MBR_YMAX",
    "POSTCODE_DISTRICT", "POSTCODE_DISTRICT_URI", "POPULATED_PLACE", "POPULATED_PLACE_URI", "POPULATED_PLACE_TYPE",
    "DISTRICT_BOROUGH", "DISTRICT_BOROUGH_URI", "DISTRICT_BOROUGH_TYPE", "COUNTY_UNITARY", "COUNTY_UNITARY_URI",
    "COUNTY_UNITARY_TYPE", "REGION", "REGION_URI", "COUNTRY", "COUNTRY_URI", "RELATED_SPATIAL_OBJECT",
    "SAME_AS_DBPEDIA", "SAME_AS_GEONAMES",
)
# Columns of the result files.
LOCATE_SCHEMA = (
    "case string, err_km double, picked_lat double, picked_lon double, picked_source string, confidence string, "
    "sigma_m int, n_gt_parts int, evidence string, error string"
)
ONESHOT_SCHEMA = (
    "case string, stratum string, iou double, precision double, recall double, centroid_distance_m double, "
    "valid_pred boolean, schema_failure boolean, validation_error string, n_polygons int, is_multipolygon_pred boolean, "
    "is_multipolygon_gt boolean, latlon_swap_warning string, call_seconds double, vlm_request_tokens bigint, "
    "vlm_response_tokens bigint, error string"
)
SEGMENT_SCHEMA = "case string, fold int, filename string, iou double, n_polygons int, call_seconds double, error string, notes string"
SCORES = "iou double, precision double, recall double, centroid_distance_m double"
RUN_SCHEMA = (
    f"status string, error string, {SCORES}, worker_first_iou double, worker_first_metrics struct<"
    "iou:double,precision:double,recall:double,centroid_distance_m:double>, processing_time double, "
    "agent_stats struct<n_commits:int,reader_request_tokens:bigint,reader_response_tokens:bigint,"
    "worker_request_tokens:bigint,worker_response_tokens:bigint,locate_request_tokens:bigint,"
    "locate_response_tokens:bigint,locate_n_calls:int,total_tokens:bigint,outcome_status:string,"
    "tool_calls:map<string,bigint>,n_turns:int,validator_retries:int,critic:struct<n_rejections:int,"
    "iterations:array<struct<iter_idx:int,action:string,chosen_candidate_id:int,wall_s:double,llm_error:string,"
    "geojson_changed:boolean>>,tokens:struct<request:bigint,response:bigint>>>"
)
PAGE_SCORES = "struct<fold:int,sem_iou:double,sem_precision:double,sem_recall:double,sem_f1:double,inst_iou:double,inst_f1:double>"
DOCUMENT_TOKENS = ("map", "plan")


def _folder(path: Column) -> Column:
    """Name of the folder a file lies in; file URLs are percent-encoded."""
    return F.url_decode(F.element_at(F.split(path, "/"), -2))


def _file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Place names: seven of 34 columns, bad lines skipped, in file and line order (row_id)."""
    numbers = ("GEOMETRY_X", "GEOMETRY_Y")
    schema = ", ".join(f"{c} {'double' if c in numbers else 'string'}" for c in PLACE_COLUMNS)
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).csv(path)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    kept = raw.select(
        order.alias("row_id"), F.col("NAME1").alias("name1"), F.lower(F.coalesce("LOCAL_TYPE", F.lit(""))).alias("local_type"),
        F.col("GEOMETRY_X").alias("easting"), F.col("GEOMETRY_Y").alias("northing"),
        F.col("DISTRICT_BOROUGH").alias("district_borough"), F.col("COUNTY_UNITARY").alias("county_unitary"),
        F.col("POPULATED_PLACE").alias("populated_place"),
    )
    return kept.withColumn("name_lc", tx.strip(F.lower(F.coalesce("name1", F.lit("")))))


def read_postcodes(spark: SparkSession, path: str) -> DataFrame:
    """Raw postcode rows of every area file; `area` is the file's name, so a filter on it prunes files' rows."""
    schema = "postcode string, quality string, easting string, northing string, c4 string, c5 string, c6 string, c7 string, district_code string"
    raw = spark.read.schema(schema).csv(path)
    return raw.select(
        "postcode", *[F.col(c).try_cast("int").alias(c) for c in ("quality", "easting", "northing")],
        F.coalesce("district_code", F.lit("")).alias("district_code"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("seq"),
        F.regexp_replace(_file_name(F.col("_metadata.file_path")), r"\.csv$", "").alias("area"),
    )


def read_admin_codes(spark: SparkSession, sheets: list[str]) -> DataFrame:
    """name, code, sheet_rank, seq of exported sheets, in precedence order; every row is data."""
    frames = [
        spark.read.schema("name string, code string").csv(path).select(
            "name", "code", F.lit(rank).alias("sheet_rank"), F.monotonically_increasing_id().alias("seq")
        )
        for rank, path in enumerate(sheets)
    ]
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def read_run(spark: SparkSession, run_dir: str) -> DataFrame:
    """One row per case folder with a metrics file; absent keys are NULL."""
    raw = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(f"{run_dir}/*/metrics.json")
    return raw.select(_folder(F.col("_metadata.file_path")).alias("case_id"), "*")


def read_result_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result file with a header; blanks are NULL. `seq` is the line order."""
    raw = spark.read.schema(schema).option("header", True).option("nullValue", "").option("multiLine", True).csv(path)
    return raw.withColumn("seq", F.monotonically_increasing_id())


def page_scores(results: DataFrame) -> DataFrame:
    """page_id, iou: rows with a score, the last per file stem."""
    stem = F.regexp_replace(F.element_at(F.split("filename", "/"), -1), r"\.[^.]*$", "")
    scored = results.where(F.col("iou").isNotNull())
    return scored.groupBy(stem.alias("page_id")).agg(F.max_by("iou", "seq").alias("iou"))


def read_truth(spark: SparkSession, data_dir: str) -> DataFrame:
    """case_id, geom: every GeoJSON of a case folder, several of them united."""
    docs = spark.read.option("wholetext", True).text(f"{data_dir}/*/*.geojson").select(
        _folder(F.col("_metadata.file_path")).alias("case_id"), F.col("_metadata.file_path").alias("part_id"),
        parse_geometry(F.col("value")).alias("geom"),
    )
    return union_geometries(docs, "case_id", "part_id")


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value rows of one JSON object, with a declared value type."""
    docs = spark.read.option("wholetext", True).text(path)
    return docs.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """folder, stratum of a subset file; an empty subset is an error."""
    docs = spark.read.schema("cases array<struct<folder:string,stratum:string>>").option("multiLine", True).json(path)
    empty = F.raise_error(F.lit("the subset holds no cases"))
    cases = F.when(F.size("cases") > 0, F.col("cases")).otherwise(empty)
    return docs.select(F.explode(cases).alias("_c")).select("_c.*")


def case_documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """case_id, path: per folder the first PDF named like a map or plan, else the first PDF.

    Only paths are read, never file contents.
    """
    files = spark.read.format("binaryFile").load(f"{data_dir}/*/*.pdf").select("path")
    named = files.select("path", _folder(F.col("path")).alias("case_id"), _file_name(F.col("path")).alias("name"))
    hinted = F.exists(F.array(*map(F.lit, DOCUMENT_TOKENS)), lambda t: F.contains(F.lower("name"), t))
    return named.groupBy("case_id").agg(F.min_by("path", F.struct(~hinted, "name")).alias("path"))


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """filename of every match, contents pruned."""
    return spark.read.format("binaryFile").load(glob).select(_file_name(F.col("path")).alias("filename"))
