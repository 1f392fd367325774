"""Phrase collocations: counts of all n-grams from counts of the longest windows alone, by ROLLUP."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.common import forget, settle

LONGEST = 5  # words of a top-order window, and of the longest phrase
WORDS = tuple(f"w{i}" for i in range(1, LONGEST + 1))
BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)  # what ends a piece becomes a line feed, which ends one too
ENOUGH = 2_000_000  # words that are windowed at a time
KNOWN = 1 << 20  # distinct words a task remembers at a time
PART = 1 << 16  # buckets of the filter that travel together
MULTIPLIERS = np.random.default_rng(12).integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Mining:
    """least: occurrences that a phrase needs (at most 255); top: phrases returned per language; bits: the pre-counts
    have 2^bits buckets for words, for pairs, and for longer runs, whatever the size of the corpus."""

    least: int = 100
    top: int = 2000
    bits: int = 24


class _Words(dict):
    """word -> number, from 1 on, in the order of appearance; 64-bit hashes beside them."""

    def __init__(self) -> None:
        super().__init__()
        self.names, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return at


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, dict[str, np.ndarray]]]:
    """Per about ENOUGH words: the words known, and per language the numbers of the words in order, 0 after each piece."""
    known, held, n = _Words(), {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out = held.setdefault(lang, [])
            before = len(out)
            for piece in (text.as_py() or "").encode("utf-8", "surrogatepass").lower().translate(BREAKS).split(b"\n"):
                if words := piece.split():
                    out.extend(map(known.__getitem__, words))
                    out.append(0)
            n += len(out) - before
            if n >= ENOUGH:
                yield known, {k: np.array(v, np.int64) for k, v in held.items() if v}
                held, n = {}, 0
                if len(known) > KNOWN:
                    known = _Words()
    if n:
        yield known, {k: np.array(v, np.int64) for k, v in held.items() if v}


def _runs(known: _Words, lang: str, numbers: np.ndarray, tables: list[np.ndarray], bits: int, upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k from 1 to upto: k, the places where k words may be a part of a frequent phrase, and their buckets.

    tables[k - 1], where given, has a bit for each bucket that k words need; longer runs need both
    of their shorter ones. Words of different pieces are never neighbours.
    """
    own = np.array(known.hashes, np.uint64)[numbers] ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
    hashes, at, shift = own, np.flatnonzero(numbers > 0), np.uint64(64 - bits)
    for k in range(1, upto + 1):
        if k > 1:
            open_ = np.zeros(len(numbers) + 1, bool)
            open_[at] = True
            at = at[open_[at + 1]]
            mixed = hashes[at] * MULTIPLIERS[0] + own[at + k - 1] * MULTIPLIERS[1]
            hashes = hashes.copy()
            hashes[at] = mixed ^ (mixed >> np.uint64(29))
        buckets = (hashes[at] * MULTIPLIERS[2]) >> shift
        if k <= len(tables):
            table = tables[k - 1]
            keep = (table[buckets >> np.uint64(3)] >> (np.uint64(7) - (buckets & np.uint64(7))).astype(np.uint8)) & 1 > 0
            at, buckets = at[keep], buckets[keep]
        yield k, at, buckets


def _tables(bits: bytes, often: int) -> list[np.ndarray]:
    """Bit tables for 1, 2 and so on words; the last one serves all longer runs."""
    rows = list(np.frombuffer(bits, np.uint8).reshape(often, -1)) if often else []
    return rows + rows[2:] * (LONGEST - 3)


def _filter(docs: DataFrame, rule: Mining, often: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """(bit tables with the next ones added, words per language) after one pass over docs (lang, text).

    The first pass counts words and pairs, the second the longer runs whose pairs were all often
    enough, each kind in a fixed number of buckets. A run in a bucket below rule.least is rare for
    certain; a rare one in a fuller bucket costs work only. A task counts up to 255 and stops
    there, so what it counts, what it sends and what comes back (2^bits bits a table) have sizes
    that don't depend on the corpus.
    """
    have, new = len(often), 1 if len(often) else 2
    lowest, upto = have + 1, LONGEST if have else 2
    shared = docs.sparkSession.sparkContext.broadcast(often.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((new, 1 << rule.bits), np.uint8), {}
        tables = _tables(shared.value, have)
        for known, langs in _chunks(batches):
            for lang, numbers in langs.items():
                totals[lang] = totals.get(lang, 0) + int((numbers > 0).sum())
                for k, _, buckets in _runs(known, lang, numbers, tables, rule.bits, upto):
                    if k >= lowest:
                        row = counts[min(k - lowest, new - 1)]
                        at, times = np.unique(buckets, return_counts=True)
                        row[at] = np.minimum(row[at] + times, 255)
        if not totals:
            return
        press, parts = zstandard.ZstdCompressor(level=1), counts.reshape(-1, PART)
        used = np.flatnonzero(parts.any(axis=1))
        for some in np.array_split(used, len(used) // 64 + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([press.compress(parts[i].tobytes()) for i in some], pa.binary())]
                + [pa.nulls(len(some), t) for t in (pa.string(), pa.int64())], ["part", "counts", "lang", "n"],
            )
        size = len(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
            ["part", "counts", "lang", "n"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, now, sums = zstandard.ZstdDecompressor(), None, None

        def ready() -> pa.RecordBatch:
            bits = np.packbits(sums >= rule.least).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bits], pa.binary())], ["part", "often"])

        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now:
                    if now is not None:
                        yield ready()
                    now, sums = part, np.zeros(PART, np.int64)
                sums += np.frombuffer(opener.decompress(packed.as_py()), np.uint8)
        if now is not None:
            yield ready()

    both = settle(docs.mapInArrow(count, "part long, counts binary, lang string, n long"))
    parts = both.where("part is not null").select("part", "counts").repartition("part").sortWithinPartitions("part")
    found = np.zeros(((new << rule.bits) // PART, PART // 8), np.uint8)
    for row in parts.mapInArrow(add, "part long, often binary").collect():  # 2^bits / 8 bytes a table
        found[row["part"]] = np.frombuffer(row["often"], np.uint8)
    totals = settle(both.where("part is null").groupBy("lang").agg(F.sum("n").alias("n")))
    forget(both)
    return np.vstack([often, found.reshape(new, -1)]), totals


def _distinct(columns: list[np.ndarray], times: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns as one, their times added."""
    keys = [columns[4], (columns[2] << 32) | columns[3], (columns[0] << 32) | columns[1]]
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.add.reduceat(times[order], first) if len(first) else times


def _windows(docs: DataFrame, often: np.ndarray, rule: Mining) -> DataFrame:
    """lang, w1 .. w5, c: padded longest windows of docs (lang, text), one for each place a frequent phrase may start.

    A window goes on to the end of its piece, or for as long as the filter does not know its words
    to be a rare run; '' pads it. Equal windows of a task are counted together while they are at
    most ENOUGH in all languages, also where the words known are forgotten in between.
    """
    have, shared = len(often), docs.sparkSession.sparkContext.broadcast(often.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, last = _tables(shared.value, have), {}, None

        def batch(lang: str) -> pa.RecordBatch:
            columns, times = held.pop(lang)
            names = pa.array(last.names, pa.binary()).cast(pa.string())
            words = [names.take(pa.array(c)) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(times), pa.string()), *words, pa.array(times)], ["lang", *WORDS, "c"])

        for known, langs in _chunks(batches):
            if known is not last:
                for lang, (columns, times) in held.items():
                    used, place = np.unique(np.concatenate(columns), return_inverse=True)
                    numbers = np.array([known[last.names[i]] if i else 0 for i in used], np.int64)
                    held[lang] = np.split(numbers[place], LONGEST), times
                last = known
            for lang, numbers in langs.items():
                padded = np.append(numbers, np.zeros(LONGEST, np.int64))
                length = np.zeros(len(numbers), np.int64)
                for k, at, _ in _runs(known, lang, numbers, tables, rule.bits, LONGEST):
                    length[at] = k
                at = np.flatnonzero(length)
                columns = [np.where(length[at] > k, padded[at + k], 0) for k in range(LONGEST)]  # lead by k
                columns, times = _distinct(columns, np.ones(len(at), np.int64))
                if lang in held:
                    old, before = held[lang]
                    columns, times = _distinct([np.append(a, b) for a, b in zip(old, columns, strict=True)], np.append(before, times))
                held[lang] = columns, times
                if sum(len(times) for _, times in held.values()) > ENOUGH:
                    yield batch(max(held, key=lambda lang: len(held[lang][1])))
        yield from [batch(lang) for lang in list(held)]

    schema = "lang string, " + ", ".join(f"{w} string" for w in WORDS) + ", c long"
    return docs.mapInArrow(run, schema)


def _joined(first: int, last: int) -> Column:
    """Words first to last (from 1) as one string; '' pads are left out."""
    return F.concat_ws(" ", *[F.when(F.col(w) != "", F.col(w)) for w in WORDS[first - 1 : last]])


def _together(docs: DataFrame) -> DataFrame:
    """docs in at most one task per core, without a shuffle.

    Every task sends its own counts of the frequent words and windows, and most tasks meet most of them. With a task
    per file split, the rows sent were splits times windows, and both of these grow with the corpus.
    """
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, 1))


def phrase_counts(docs: DataFrame, rule: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, w1 .. w5, k, phrase, f of every n-gram of up to 5 words with f >= rule.least; words n per language).

    Only padded longest windows are counted. ROLLUP sums them over ever shorter prefixes, and the
    prefix of k words has the phrase's count, since a window starts wherever the phrase does. Two
    passes before it count runs of words in a fixed number of buckets, and a window ends before
    its words are a run whose bucket is too small. All parts of a frequent phrase are frequent,
    so no count that is returned misses an occurrence.
    """
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    source = _together(source)
    often, totals = _filter(source, rule, np.zeros((0, (1 << rule.bits) // 8), np.uint8))
    often, _ = _filter(source, rule, often)
    windows = _windows(source, often, rule).groupBy("lang", *WORDS).agg(F.sum("c").alias("c"))
    summed = windows.rollup("lang", *WORDS).agg(F.sum("c").alias("f"), F.grouping_id().alias("g")).where(F.col("f") >= rule.least)
    # Level k has k words: the last 5 - k columns are summed away, and word k is no pad.
    level = F.lit(0)
    for k in range(1, LONGEST + 1):
        level = F.when((F.col("g") == (1 << (LONGEST - k)) - 1) & (F.col(WORDS[k - 1]) != ""), k).otherwise(level)
    grams = summed.withColumn("k", level).where("k > 0").select("lang", *[F.coalesce(w, F.lit("")).alias(w) for w in WORDS], "k", "f")
    return settle(grams.withColumn("phrase", _joined(1, LONGEST))), totals


def score(a: Column, left: Column, right: Column, n: Column) -> Column:
    """floor(1000 * a * n / (left * right)) from exact products of up to 38 digits; at most 10 * n, which fits 64 bits."""
    a, left, right, n = (x.cast("decimal(19,0)") for x in (a, left, right, n))
    whole = (a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", whole, left * right).cast("bigint")


def collocations(docs: DataFrame, rule: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to 5 words.

    A cut of a phrase after k words scores floor(1000 * a * n / (l * r)); the lowest cut counts, of
    equal ones the first. A phrase whose words lie inside a longer phrase of the same count is
    left out. Ties go to the larger count, then to the lesser phrase by bytes. Null languages are
    'und'; null and blank texts have no words; repeated rows count again; an empty table gives
    no rows; other columns are ignored. A language's ranks need rule.top rows of each task only.
    """
    grams, totals = phrase_counts(docs, rule, text_col, lang_col)
    counts = grams.select("lang", F.col("phrase").alias("part"), F.col("f"))
    phrases = grams.where("k > 1")
    # A longer phrase with the same count implies one that is longer by one word and has it too.
    longer = phrases.where("k > 2")
    shorter = [F.concat_ws(" ", *[F.when(F.col("k") > i + 1, F.col(w)) for i, w in enumerate(WORDS)]), _joined(2, LONGEST)]
    inside = longer.select("lang", F.explode(F.array(*shorter)).alias("phrase"), F.col("f").alias("g")).groupBy("lang", "phrase").agg(F.max("g").alias("g"))
    open_ = phrases.join(inside, ["lang", "phrase"], "left").where("g is null or g < f").drop("g")
    cuts = F.array(*[
        F.when(F.col("k") > i, F.struct(F.lit(i).alias("cut"), _joined(1, i).alias("left"), _joined(i + 1, LONGEST).alias("right")))
        for i in range(1, LONGEST)
    ])
    cut = open_.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.filter(cuts, lambda x: x.isNotNull())).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at.*")
    cut = cut.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"]).join(totals, "lang")
    best = cut.withColumn("score", score(*map(F.col, "alrn"))).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "b.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rule.top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
