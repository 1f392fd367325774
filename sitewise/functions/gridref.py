"""National Grid references and easting/northing text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions.crs import bng_to_wgs84
from sitewise.functions.text import strip

# Plausible grid metres and the outer latitude/longitude box.
GRID_RANGE = ((60_000, 700_000), (5_000, 1_280_000))
LATLON_BOX = ((49.0, 61.0), (-8.5, 2.0))

_PAIR = r"^([A-Z]{2})\s*(\d+)\s+(\d+)$"
_COMPACT = r"^([A-Z]{2})\s*(\d+)$"
_EN_TEXT = r"(?i)(\d{4,7})\s*E\s*(\d{4,7})\s*N"


def _letter_index(char: Column) -> Column:
    """0-24 over the alphabet without I."""
    code = F.ascii(char)
    return F.when(char != "I", code - 65 - (code > 73).cast("int"))


def square_origin(letters: Column) -> tuple[Column, Column]:
    """South-west corner of a two-letter square; NULL for squares off the grid."""
    first, second = _letter_index(F.left(letters, F.lit(1))), _letter_index(F.right(letters, F.lit(1)))
    column = F.pmod(first - 2, F.lit(5)) * 5 + F.pmod(second, F.lit(5))
    row = 19 - 5 * F.floor(first / 5) - F.floor(second / 5)
    on_grid = column.between(0, 9) & row.between(0, 24)
    return F.when(on_grid, column * 100_000), F.when(on_grid, row * 100_000)


def grid_squares(spark) -> DataFrame:
    """All squares with their origins: letters, easting, northing."""
    codes = spark.range(26 * 26).select(
        F.concat(F.char(F.col("id").try_cast("int") % 26 + 65), F.char(F.floor(F.col("id") / 26) + 65)).alias(
            "letters"
        )
    )
    easting, northing = square_origin(F.col("letters"))
    return codes.select("letters", easting.alias("easting"), northing.alias("northing")).where(
        "easting IS NOT NULL"
    )


def _centre_digits(digits: Column) -> Column:
    """Five digits per axis; a shorter axis is completed to the middle of its own cell."""
    return F.when(F.length(digits) >= 5, digits).otherwise(
        F.rpad(F.concat(digits, F.lit("5")), 5, "0")
    )


def parse_grid_ref(df: DataFrame, ref: str, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Add grid metres of a reference such as "TG 210 080"; NULL where it does not parse."""
    keep = [c for c in df.columns if c not in (easting, northing)]
    text = F.replace(F.replace(F.upper(strip(F.col(ref))), F.lit(","), F.lit("")), F.lit("  "), F.lit(" "))
    text = F.regexp_replace(text, r"\s+[NSEW]{1,2}$", "")
    text = strip(F.regexp_replace(text, r"(\d+)-\d+", "$1"))
    df = df.withColumn("_ref", text)
    paired = F.col("_ref").rlike(_PAIR)
    run = F.regexp_extract("_ref", _COMPACT, 2)
    half = F.floor(F.length(run) / 2).cast("int")
    df = df.withColumns(
        {
            "_letters": F.coalesce(
                F.nullif(F.regexp_extract("_ref", _PAIR, 1), F.lit("")),
                F.nullif(F.regexp_extract("_ref", _COMPACT, 1), F.lit("")),
            ),
            "_e": F.when(paired, F.regexp_extract("_ref", _PAIR, 2)).otherwise(F.substring(run, F.lit(1), half)),
            "_n": F.when(paired, F.regexp_extract("_ref", _PAIR, 3)).otherwise(
                F.substring(run, half + 1, half)
            ),
        }
    )
    base_e, base_n = square_origin(F.col("_letters"))
    fine = (F.length("_e") + F.length("_n")) >= 4
    return df.select(
        *keep,
        F.when(fine, base_e + _centre_digits(F.col("_e")).try_cast("bigint")).cast("double").alias(easting),
        F.when(fine, base_n + _centre_digits(F.col("_n")).try_cast("bigint")).cast("double").alias(northing),
    )


def _inside_box(df: DataFrame, keep: list[str]) -> DataFrame:
    ok = F.col("_la").between(*LATLON_BOX[0]) & F.col("_lo").between(*LATLON_BOX[1])
    return df.select(*keep, F.when(ok, F.col("_la")).alias("lat"), F.when(ok, F.col("_lo")).alias("lon"))


def geocode_grid_ref(df: DataFrame, ref: str) -> DataFrame:
    """Add lat and lon of a grid reference."""
    keep = df.columns
    df = parse_grid_ref(df, ref, "_ge", "_gn")
    return _inside_box(bng_to_wgs84(df, "_ge", "_gn", "_la", "_lo"), keep)


def parse_easting_northing(df: DataFrame, text: str) -> DataFrame:
    """Add lat and lon of a "528942 E 184544 N" passage anywhere in the text."""
    keep = df.columns
    east = F.nullif(F.regexp_extract(text, _EN_TEXT, 1), F.lit("")).try_cast("int")
    north = F.nullif(F.regexp_extract(text, _EN_TEXT, 2), F.lit("")).try_cast("int")
    df = df.withColumns({"_ge": east, "_gn": north})
    plausible = F.col("_ge").between(*GRID_RANGE[0]) & F.col("_gn").between(*GRID_RANGE[1])
    df = df.withColumns(
        {
            "_ge": F.when(plausible, F.col("_ge")).cast("double"),
            "_gn": F.when(plausible, F.col("_gn")).cast("double"),
        }
    )
    return _inside_box(bng_to_wgs84(df, "_ge", "_gn", "_la", "_lo"), keep)
