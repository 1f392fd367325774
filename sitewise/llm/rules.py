"""Quality rules by distribution divergence, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import fresh, settle, words

# Frequent words of four languages, from public stop-word lists.
COMMON_WORDS = {
    "en": "the of and to a in is that for it was on with as be at",
    "de": "der die und in den von zu das mit sich des auf für ist im dem",
    "fr": "de la le et les des en un du une que est pour qui dans au",
    "es": "de la que el en y a los se del las un por con no una",
}
VOCABULARY = tuple(sorted({w for text in COMMON_WORDS.values() for w in text.split()}))
SYMBOLS = "#*$%&|<>"
# Character classes; what none of them holds is a class of its own (other letters and signs).
CLASSES = {
    "lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": r"[.,;:?'\"()-]",
    "bang": "[!]", "symbol": r"[#*$%&|<>]",
}
LANGUAGES = tuple(COMMON_WORDS)


@dataclass(frozen=True)
class Rules:
    """max_class, max_word: greatest Jensen-Shannon distance (0 to 1) from the nearest language
    reference; min_chars, min_words: texts with less to count aren't judged by that histogram."""

    max_class: float = 0.18
    max_word: float = 0.25
    min_chars: int = 200
    min_words: int = 200


def class_counts(text: Column) -> Column:
    """Code points per character class, the rest last.

    The classes are apart from each other, so each is counted in what the ones before it left: runs of
    lower-case letters and spaces go first, and what later passes read is short.
    """
    left, counts = text, {}
    for name in sorted(CLASSES, key=lambda c: (c not in ("lower", "space"), list(CLASSES).index(c))):
        less = F.regexp_replace(left, CLASSES[name] + "+", "")
        counts[name] = F.length(left) - F.length(less)
        left = less
    return F.array(*[counts[name] for name in CLASSES], F.length(left))


def word_counts(tokens: Column) -> Column:
    """Occurrences of each word of VOCABULARY, all other words last."""
    counts = [F.size(tokens) - F.size(F.array_remove(tokens, w)) for w in VOCABULARY]
    rest = F.size(tokens)
    for c in counts:
        rest = rest - c
    return F.array(*counts, rest)


def with_histograms(docs: DataFrame, text_col: str, tokens: str, classes: str, common: str) -> DataFrame:
    rows = docs.withColumn(tokens, words(F.col(text_col)))
    return rows.withColumns({classes: class_counts(F.coalesce(F.col(text_col), F.lit(""))), common: word_counts(F.col(tokens))})


def with_repeats(rows: DataFrame, tokens: str, name: str) -> DataFrame:
    """Adds the number of words in 3-word windows that the text holds twice or more.

    Windows are compared by 64-bit hash within one text. Only a text with an equal pair sorts them.
    """
    hashes, order = fresh(rows, "_hashes", "_order")
    n = F.size(tokens)
    window = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*[F.get(F.col(tokens), i + j) for j in range(3)])
    )
    rows = rows.withColumn(hashes, F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct(F.col(hashes))) < F.size(hashes)
    placed = F.array_sort(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn(order, F.when(some, placed))
    same = lambda e, i: e["h"].eqNullSafe(F.get(F.col(order), i)["h"])
    found = F.filter(F.col(order), lambda e, i: same(e, i - 1) | same(e, i + 1))
    covered = F.flatten(F.transform(found, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
    count = F.when(F.col(order).isNull(), 0).otherwise(F.size(F.array_distinct(covered)))
    return rows.withColumn(name, count.cast("bigint")).drop(hashes, order)


def measured(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with a struct column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, classes and common."""
    tokens, classes, common, repeats = fresh(docs, "_tokens", "_classes", "_common", "_repeats")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_repeats(with_histograms(docs, text_col, tokens, classes, common), tokens, repeats)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, "\t\x0b\f\r ", "")) > 0)
    several = F.instr(text, "\n") > 0
    return rows.withColumn(name, F.struct(
        F.size(tokens).cast("bigint").alias("n_words"),
        (F.length(text) - F.col(classes)[list(CLASSES).index("space")]).cast("bigint").alias("word_chars"),
        F.col(classes)[list(CLASSES).index("symbol")].cast("bigint").alias("n_symbols"),
        F.when(several, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("bigint").alias("n_dup_lines"),
        F.col(repeats).alias("n_repeat_words"), F.length(text).alias("chars"), F.col(classes).alias("classes"), F.col(common).alias("common"),
    )).drop(tokens, classes, common, repeats)


def _references(rows: DataFrame, name: str, lang_col: str) -> dict[str, tuple[list[float], list[float]]]:
    m = F.col(name)
    rows = rows.where(F.col(lang_col).isin(*LANGUAGES) & (m["n_words"] >= 50)).select(F.col(lang_col).alias("lang"), m.alias("m"))
    m, n_classes, n_common = F.col("m"), len(CLASSES) + 1, len(VOCABULARY) + 1
    sums = rows.groupBy("lang").agg(
        *[F.percentile_approx(m["classes"][i] / m["chars"], 0.5, 10_000).alias(f"c{i}") for i in range(n_classes)],
        *[F.avg(m["common"][i] / m["n_words"]).alias(f"w{i}") for i in range(n_common)],
    )
    out = {}
    for r in sums.orderBy("lang").collect():
        middle = [r[f"c{i}"] for i in range(n_classes)]
        out[r["lang"]] = ([c / (sum(middle) or 1.0) for c in middle], [r[f"w{i}"] for i in range(n_common)])
    return out


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Per language, the middle share of each character class and the mean share of each common word.

    Every document with at least 50 words counts once, whatever its length; the median keeps junk,
    as long as it is the lesser part, out of the class histogram, which is then scaled to 1. One aggregate over all
    rows; what comes back is one row per language of COMMON_WORDS. A language without documents
    has no reference.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return _references(measured(rows, "m"), "m", "lang")


def js_distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of an array of shares from a fixed distribution."""
    ref = F.array(*[F.lit(float(x)) for x in reference])

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    total = F.aggregate(F.zip_with(shares, ref, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def judge(
    docs: DataFrame, references: dict[str, tuple[list[float], list[float]]] | None = None, rules: Rules = Rules(),
    text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """The columns `keep` of docs (all, if none are named) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, class_distance, word_distance and kept.

    The distances are those from the nearest language reference (least of both added); they are 0
    where a text has too little to count or no reference exists. kept is false if the base rules
    fail or a distance is above its limit. Without references, those of docs itself are taken. A null
    or empty text has no words and fails. Input columns of these names are replaced; repeated rows are
    judged alike; an empty table gives no rows. Texts are measured once: the measures are written to
    the shared folder, and both the references and the verdicts come from there.
    """
    kept_columns = [c for c in (keep or docs.columns) if c.lower() not in ADDED]
    docs = docs.drop(*ADDED)
    m, near, cs, ws, lang = fresh(docs, "_measured", "_near", "_cs", "_ws", "_lang")
    known = F.col(lang_col) if lang_col.lower() in [c.lower() for c in docs.columns] else F.lit(None).cast("string")
    rows = settle(measured(docs.withColumn(lang, known), m, text_col).select(*kept_columns, lang, m))
    if references is None:
        references = _references(rows, m, lang)
    rows = rows.withColumns({name: F.col(m)[name] for name in ADDED[:5]})
    chars, n = F.col(m)["chars"], F.col(m)["n_words"]
    rows = rows.withColumns({
        cs: F.transform(F.col(m)["classes"], lambda x: x / F.greatest(chars, F.lit(1))),
        ws: F.transform(F.col(m)["common"], lambda x: x / F.greatest(n, F.lit(1))),
    })
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("c"), F.lit(0.0).alias("w"))
    pairs = []
    for class_ref, word_ref in references.values():
        c = F.when(chars >= rules.min_chars, js_distance(F.col(cs), class_ref)).otherwise(0.0)
        w = F.when(n >= rules.min_words, js_distance(F.col(ws), word_ref)).otherwise(0.0)
        pairs.append(F.struct((c + w).alias("sum"), c.alias("c"), w.alias("w")))
    rows = rows.withColumn(near, F.array_min(F.array(*pairs)) if pairs else none)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col(near)["c"] <= rules.max_class) & (F.col(near)["w"] <= rules.max_word)
    return rows.withColumns({
        "base_failed": failed, "class_distance": F.col(near)["c"], "word_distance": F.col(near)["w"], "kept": kept,
    }).select(*kept_columns, *ADDED)


def passing(
    docs: DataFrame, references: dict[str, tuple[list[float], list[float]]] | None = None, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of docs that judge keeps, with their own columns, even where those have names that judge adds."""
    added = [c for c in docs.columns if c.lower() in ADDED]
    renamed = dict(zip(added, fresh(docs, *[f"_{c}" for c in added]), strict=True))
    judged = judge(docs.withColumnsRenamed(renamed), references, rules, text_col, lang_col).where("kept")
    return judged.drop(*ADDED).withColumnsRenamed({b: a for a, b in renamed.items()}).select(*docs.columns)
