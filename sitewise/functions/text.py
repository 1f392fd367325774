"""String and parsing scalars."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a place query may carry after the name proper.
PLACE_QUALIFIERS = (
    " village", " town", " city", " hamlet", " road", " street", " lane", " avenue", " way",
    " borough", " district",
)
# Words dropped from the end of an admin context, in this order.
CONTEXT_SUFFIXES = (" district", " borough", " unitary", " county", " council")
# Admin-name suffixes, dropped one after the other in exactly this order.
ADMIN_SUFFIXES = (
    " district council", " borough council", " city council", " county council",
    " metropolitan borough council", " london borough council", " district", " borough",
    " london boro", " london borough", " metropolitan borough", " unitary",
    " unitary authority", " council",
)
# Admin-name prefixes, dropped in this order after the suffixes.
ADMIN_PREFIXES = (
    "city of ", "london borough of ", "borough of ", "the london borough of ",
    "royal borough of ",
)
# Suffixes that give an admin polygon one more lookup key each.
VARIANT_SUFFIXES = (" district", " borough", " london boro", " county")
# Road-type abbreviations and their full forms.
ROAD_TYPES = {"rd": "road", "ave": "avenue", "cl": "close"}

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_safe(text: Column) -> Column:
    """NULL counts as the empty string; the result is stripped."""
    return strip(F.coalesce(text.cast("string"), F.lit("")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(blank_safe(text), F.lit(""))


def _drop_suffix(text: Column, suffix: str) -> Column:
    return strip(F.regexp_replace(text, re.escape(suffix) + "$", ""))


def _drop_prefix(text: Column, prefix: str) -> Column:
    return strip(F.regexp_replace(text, "^" + re.escape(prefix), ""))


def query_candidates(query: Column) -> Column:
    """The lower-cased query, then one shortened form per qualifier it ends with."""
    base = F.lower(strip(query))
    shortened = [
        F.when(
            base.endswith(word) & (F.length(base) > len(word) + 2),
            strip(F.left(base, F.length(base) - len(word))),
        )
        for word in PLACE_QUALIFIERS
    ]
    return F.array_compact(F.array(base, *shortened))


def context_tokens(context: Column) -> Column:
    text = functools.reduce(_drop_suffix, CONTEXT_SUFFIXES, F.lower(strip(context)))
    words = F.split(F.replace(text, F.lit(","), F.lit(" ")), r"\s+")
    return F.filter(words, lambda word: F.length(word) > 2)


def normalise_postcode(postcode: Column) -> Column:
    compact = F.upper(F.replace(strip(postcode), F.lit(" "), F.lit("")))
    spaced = F.concat_ws(
        " ", F.left(compact, F.length(compact) - 3), F.right(compact, F.lit(3))
    )
    return F.when(F.length(compact) < 5, compact).otherwise(spaced)


def postcode_area(postcode: Column) -> Column:
    return F.lower(F.regexp_extract(F.replace(postcode, F.lit(" "), F.lit("")), "^([A-Za-z]+)", 1))


def normalise_admin(name: Column) -> Column:
    """Bare admin name; the lists are applied in order, so a short suffix may hide a long one."""
    text = F.replace(F.lower(strip(F.coalesce(name, F.lit("")))), F.lit("."), F.lit(""))
    text = F.regexp_replace(text, r"\s*\(b\)$", "")
    text = F.regexp_replace(text, r"\s*\((?:district|borough|county|unitary|metro)\)$", "")
    text = functools.reduce(_drop_suffix, ADMIN_SUFFIXES, text)
    return functools.reduce(_drop_prefix, ADMIN_PREFIXES, text)


def admin_variants(name: Column) -> Column:
    """Lookup keys of one admin polygon, most specific first."""
    lower = F.lower(name)
    keys = [lower, F.nullif(normalise_admin(name), F.lit(""))]
    keys.append(F.when(F.contains(lower, F.lit(" (b)")), F.replace(lower, F.lit(" (b)"), F.lit(""))))
    for word in VARIANT_SUFFIXES:
        short = strip(F.left(lower, F.length(lower) - len(word)))
        keys.append(F.when(lower.endswith(word) & (short != ""), short))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def normalise_road(name: Column) -> Column:
    text = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    text = strip(F.regexp_replace(text, r"\s+", " "))
    for short, full in ROAD_TYPES.items():
        text = F.regexp_replace(text, rf"(?<![^ ]){short}(?![^ ])", full)
    return text


def scale_denominator(text: Column) -> Column:
    """1:N or 1/N as an integer; NULL where no scale is written."""
    digits = F.replace(F.regexp_extract(text, r"1\s*[:/]\s*([\d,]+)", 1), F.lit(","), F.lit(""))
    return F.nullif(digits, F.lit("")).try_cast("int")


def has_scale(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\b1\s*[:/]\s*\d"), F.lit(False))


def case_name(name: Column) -> Column:
    return F.translate(F.coalesce(name, F.lit("")), ":/", "__")


def page_case(page: Column) -> Column:
    return F.regexp_replace(page, r"_p\d+$", "")


def route_key(name: Column) -> Column:
    """The one key under which every spelling of a case name meets."""
    return F.translate(page_case(case_name(name)), "()", "__")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def prompt_dirname(prompt: Column) -> Column:
    return F.translate(prompt, " /", "__")


def normalise_label(label: Column) -> Column:
    return strip(F.replace(F.lower(strip(label)), F.lit("?"), F.lit("")))


def well_traced(shape_matches: Column) -> Column:
    text = F.lower(strip(shape_matches))
    return (text == "yes") | text.startswith("yes - across")


def stratum(quality: Column, complexity: Column) -> Column:
    return F.concat(normalise_label(quality), F.lit("_x_"), normalise_label(complexity))


def call_fingerprint(tool: Column, args: Column) -> Column:
    """Key of one tool call; `args` is a struct with its fields in name order."""
    return F.concat(tool, F.lit(":"), F.md5(F.to_json(args)))


def public_fields(info: Column) -> Column:
    return F.map_filter(info, lambda key, _: ~F.startswith(key, F.lit("_")))


def prepend_terms(old: Column, new: Column) -> Column:
    """New terms in front of a list; every insert goes first, so they end up reversed."""
    clean = F.filter(F.transform(new, strip), lambda term: F.length(term) > 0)
    return F.concat(F.reverse(F.array_except(clean, old)), old)


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1e6)


def confidence_specificity(confidence: Column) -> Column:
    return F.when(confidence == "high", 5).when(confidence == "med", 3).otherwise(1)


def axis_field(reward: Column, axis: str, field: str) -> Column:
    """Score or verdict of one axis in a map of structs; NULL at any missing level."""
    return F.try_element_at(reward, F.lit(axis)).getField(field)


def changed(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)


def has_foreign_letters(values: Column) -> Column:
    """True where a list holds a character past the Latin Extended-B block."""
    return F.exists(values, lambda v: v.rlike("[^\\u0000-\\u024F]"))


def inlier_tier(n_inliers: Column) -> Column:
    return (
        F.when(n_inliers >= 100, "STRONG").when(n_inliers >= 50, "OK")
        .when(n_inliers >= 25, "WEAK").otherwise("TOO WEAK")
    )


def scale_tier(score: Column) -> Column:
    return F.when(score >= 0.8, "GOOD").when(score >= 0.5, "MARGINAL").otherwise("BAD")


def road_tier(score: Column) -> Column:
    return (
        F.when(score >= 0.6, "STRONG").when(score == 0, "CONFLICT")
        .when(score == 0.5, "NEUTRAL").otherwise("PARTIAL")
    )


def iou_mark(iou: Column) -> Column:
    return F.when(iou >= 0.8, "PASS").when(iou >= 0.5, "OK").otherwise("WEAK")
