"""Record rules as named booleans: a table of checks that gives a report of violations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.text import has_foreign_letters

# Ranges and word lists a record must keep to.
LAT_RANGE, LON_RANGE = (49.5, 61.0), (-9.0, 2.0)
SIGMA_RANGE = (100, 50_000)
CONFIDENCES = ("high", "med", "low")
PAGE_CATEGORIES = ("match", "discard")
CLARITIES = ("clear", "ambiguous", "none")
DETAILS = ("close", "medium", "wide")
OUTCOMES = ("accepted", "district_lookup")
LATIN_FIELDS = (
    "place_names", "road_names", "parish_names", "house_number_road_pairs", "visible_map_labels",
    "adjacency_hints",
)


def _blank(column: Column) -> Column:
    return F.coalesce(F.length(column) == 0, F.lit(True))


def _empty(column: Column) -> Column:
    return F.coalesce(F.size(column) <= 0, F.lit(True))


def location_rules() -> dict[str, Column]:
    return {
        "lat_range": F.col("top_lat").between(*LAT_RANGE),
        "lon_range": F.col("top_lon").between(*LON_RANGE),
        "sigma_range": F.col("sigma_m").between(*SIGMA_RANGE),
        "confidence_word": F.col("confidence").isin(*CONFIDENCES),
    }


def page_rules() -> dict[str, Column]:
    return {
        "category_word": F.col("category").isin(*PAGE_CATEGORIES),
        "clarity_word": F.col("boundary_clarity").isin(*CLARITIES),
        "detail_word": F.col("detail_level").isin(*DETAILS),
    }


def record_rules() -> dict[str, Column]:
    """Rules over a whole extracted record."""
    rules = {f"latin_{name}": ~F.coalesce(has_foreign_letters(F.col(name)), F.lit(False)) for name in LATIN_FIELDS}
    no_keys = _empty(F.col("place_names")) & _empty(F.col("road_names")) & _empty(F.col("visible_map_labels"))
    other = ~(
        _blank(F.col("site_address")) & _empty(F.col("house_number_road_pairs")) & _empty(F.col("parish_names"))
    )
    rules["key_lists_present"] = ~(no_keys & other)
    blank = _blank(F.col("site_address"))
    for name in ("scale", "district_name", "admin_region", "likely_town_or_city"):
        blank = blank & _blank(F.col(name))
    for name in ("postcodes", "grid_refs", "map_pages", "map_page_details", *LATIN_FIELDS):
        blank = blank & _empty(F.col(name))
    rules["not_default"] = ~(blank & ~F.coalesce(F.col("is_district_wide"), F.lit(False)))
    return rules


def outcome_rules() -> dict[str, Column]:
    """A result row stands only if what it claims was produced."""
    has_geometry = F.col("geojson").isNotNull()
    return {
        "status_word": F.col("status").isin(*OUTCOMES),
        "record_present": F.coalesce(F.col("has_record"), F.lit(False)),
        "district_polygon": (F.col("status") != "district_lookup") | has_geometry,
        "match_result": (F.col("status") != "accepted")
        | ~((F.coalesce(F.col("total_inliers"), F.lit(0)) == 0) & ~has_geometry),
    }


def violations(df: DataFrame, keys: list[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule: keys, rule. A check that is NULL counts as broken."""
    checks = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.coalesce(ok, F.lit(False)).alias("ok"))
            for name, ok in rules.items()
        ]
    )
    broken = F.filter(checks, lambda c: ~c["ok"])
    return df.select(*keys, F.explode(broken).alias("_c")).select(*keys, F.col("_c.rule").alias("rule"))
