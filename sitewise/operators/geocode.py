"""Postcode, admin-area and road lookups as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import geo
from sitewise.functions import text as tx
from sitewise.functions.crs import bng_to_wgs84
from sitewise.functions.geometry import bounds
from sitewise.operators.polygon import centroid

NO_POSITION_QUALITY = 90


def clean_postcodes(raw: DataFrame) -> DataFrame:
    """Usable rows only, the last row of a postcode winning (`seq` is the table order)."""
    usable = raw.where(
        F.col("easting").isNotNull() & F.col("northing").isNotNull()
        & ~((F.col("easting") == 0) & (F.col("northing") == 0))
        & (F.coalesce("quality", F.lit(0)) != NO_POSITION_QUALITY)
    )
    last = usable.groupBy("postcode").agg(
        F.max_by(F.struct("easting", "northing", "district_code"), "seq").alias("_r")
    )
    return last.select("postcode", "_r.*").withColumn("area", tx.postcode_area(F.col("postcode")))


def admin_codes(sheets: DataFrame) -> DataFrame:
    """code, name: the later sheet wins, then the later row of a sheet."""
    named = sheets.where(F.length(F.trim("code")) > 0)
    last = F.max_by(F.trim("name"), F.struct("sheet_rank", "seq"))
    return named.groupBy(F.trim("code").alias("code")).agg(last.alias("name"))


def lookup_postcodes(queries: DataFrame, postcodes: DataFrame, codes: DataFrame) -> DataFrame:
    """query_id, postcode, lat, lon, admin_district for every query that is found."""
    asked = queries.withColumn("postcode", tx.normalise_postcode(F.col("text")))
    asked = asked.withColumn("area", tx.postcode_area(F.col("postcode"))).where("area <> ''")
    found = asked.join(postcodes, ["area", "postcode"]).join(
        codes.select(F.col("code").alias("district_code"), F.col("name").alias("admin_district")),
        "district_code", "left",
    )
    metres = found.select(
        "query_id", "postcode", "admin_district",
        F.col("easting").cast("double").alias("_e"), F.col("northing").cast("double").alias("_n"),
    )
    return bng_to_wgs84(metres, "_e", "_n").drop("_e", "_n")


def admin_names(polygons: DataFrame) -> DataFrame:
    """key, polygon_id, key_order: every lookup key and the polygon that claims it first.

    `polygons` has polygon_id, name, layer_rank; the order is layer, polygon, variant.
    """
    keys = polygons.where(F.length(F.trim("name")) > 0).select(
        "polygon_id", "layer_rank", F.posexplode(tx.admin_variants(F.trim("name"))).alias("variant", "key")
    )
    order = F.struct("layer_rank", "polygon_id", "variant")
    return keys.groupBy("key").agg(
        F.min_by("polygon_id", order).alias("polygon_id"), F.min(order).alias("key_order")
    )


def _grams(text: str) -> F.Column:
    """All pieces of one to three letters."""
    pieces = [
        F.when(
            F.length(text) >= n,
            F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))
        for n in (1, 2, 3)
    ]
    return F.array_distinct(F.concat(*pieces))


def _containing(inner: DataFrame, outer: DataFrame, inner_text: str, outer_text: str) -> DataFrame:
    """Pairs where `outer_text` contains `inner_text`, over an equality join on its first letters."""
    head = F.left(inner_text, F.least(F.length(inner_text), F.lit(3)))
    left = inner.where(F.length(inner_text) > 0).withColumn("_g", head)
    right = outer.withColumn("_g", F.explode(_grams(outer_text)))
    return left.join(right, "_g").where(F.contains(outer_text, inner_text))


def resolve_admin(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, polygon_id, stage: exact key, then normalised key, then longest overlapping key.

    Works on distinct query texts; queries that resolve to nothing have a NULL polygon.
    """
    lower = F.lower(tx.strip(F.coalesce("query", F.lit(""))))
    texts = queries.select("query").distinct().select(
        "query", lower.alias("q"), tx.normalise_admin(F.col("query")).alias("qn")
    )
    keyed = names.select("key", F.col("polygon_id"), "key_order")
    exact = texts.join(keyed.select(F.col("key").alias("q"), F.col("polygon_id").alias("p1")), "q", "left")
    both = exact.join(keyed.select(F.col("key").alias("qn"), F.col("polygon_id").alias("p2")), "qn", "left")
    open_texts = both.where("p1 IS NULL AND p2 IS NULL AND q <> ''").select("query", "q", "qn")
    pairs = [
        _containing(open_texts, keyed, "q", "key"),
        _containing(open_texts, keyed, "qn", "key"),
        _containing(keyed, open_texts, "key", "q"),
        _containing(keyed, open_texts, "key", "qn").where("qn <> ''"),
    ]
    hits = pairs[0].select("query", "key", "polygon_id", "key_order")
    for more in pairs[1:]:
        hits = hits.unionByName(more.select("query", "key", "polygon_id", "key_order"))
    # Longest key, the earlier one on ties.
    longest = hits.groupBy("query").agg(
        F.min_by("polygon_id", F.struct((-F.length("key")).alias("l"), "key_order")).alias("p3")
    )
    resolved = both.join(longest, "query", "left").select(
        "query",
        F.coalesce("p1", "p2", "p3").alias("polygon_id"),
        F.when(F.col("p1").isNotNull(), "exact").when(F.col("p2").isNotNull(), "normalised")
        .when(F.col("p3").isNotNull(), "overlap").alias("stage"),
    )
    return queries.join(resolved, "query", "left").select("query_id", "query", "polygon_id", "stage")


def resolve_alternates(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, matched_variant, polygon_id: the first of the |-separated names that resolves."""
    options = queries.select("query_id", F.posexplode(F.split("query", r"\|")).alias("pos", "query"))
    options = options.withColumn("query", tx.strip(F.col("query"))).where("query <> ''")
    tagged = options.withColumn("query_id", F.struct("query_id", "pos"))
    found = resolve_admin(tagged, names).where("polygon_id IS NOT NULL")
    best = F.min_by(F.struct("query", "polygon_id"), F.col("query_id.pos")).alias("_b")
    best_of = found.groupBy(F.col("query_id.query_id").alias("qid")).agg(best)
    return best_of.select(
        F.col("qid").alias("query_id"), F.col("_b.query").alias("matched_variant"), F.col("_b.polygon_id")
    )


def fallback_centre(cases: DataFrame, polygons: DataFrame) -> DataFrame:
    """Centre and search radius where no better signal is left: case_id, lat, lon, sigma_m, source.

    `cases` carries polygon_id (NULL = unresolved); `polygons` has polygon_id and geom in degrees.
    """
    shapes = polygons.select(
        "polygon_id", centroid(F.col("geom")).alias("_c"), bounds(F.col("geom")).alias("_b")
    )
    width = (F.col("_b.maxx") - F.col("_b.minx")) * geo.M_PER_DEGREE * F.cos(F.radians(F.col("_c.y")))
    height = (F.col("_b.maxy") - F.col("_b.miny")) * geo.M_PER_DEGREE
    low, high = geo.SIGMA_RANGE_M
    radius = F.greatest(F.lit(low), F.least((F.greatest(width, height) / 2).cast("int"), F.lit(high)))
    areas = shapes.select(
        "polygon_id", F.col("_c.y").alias("_lat"), F.col("_c.x").alias("_lon"), radius.alias("_sigma")
    )
    lat, lon = geo.FALLBACK_CENTRE
    return cases.join(areas, "polygon_id", "left").select(
        "case_id",
        F.coalesce("_lat", F.lit(lat)).alias("lat"),
        F.coalesce("_lon", F.lit(lon)).alias("lon"),
        F.coalesce("_sigma", F.lit(high)).alias("sigma_m"),
        F.when(F.col("_lat").isNotNull(), "area_centroid").otherwise("country_centroid").alias("source"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= k)
