"""Near-duplicate documents: universal hash minima, banding, signature check, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.common import forget, fresh, settle
from sitewise.llm.components import components

SEED = 20_11
BLOCK = 2048  # shingles hashed at a time
SHARE = 256  # pairs of a hub that one copy of its text serves, on average
BINS = 20  # steps of the distance from a hub
MEMBERS, SHINGLES = 512, 1_000_000  # of a block that is compared in one task, on average
COLUMNS = 8192  # shingles that are counted at a time


@dataclass(frozen=True)
class NearDup:
    """words: length of a shingle; percent: least 100 * intersection / union of a link; bands, rows:
    minima are `bands` groups of `rows`. A pair at 0.8 shares no band of 33 with probability 4e-5,
    and a pair at 0.85 none of 28 bands of 7 rows with 2e-5. slack: a pair of one bucket goes on to the
    exact check unless its signatures agree in fewer places than percent minus slack, which is
    five standard deviations and more."""

    words: int = 5
    percent: int = 80
    bands: int = 33
    rows: int = 6
    slack: int = 15


def shingle_set(text: str | bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (or its UTF-8), A-Z lower-cased; all words where there are fewer."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = min(size, len(tokens))
    out = np.full(len(tokens) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(tokens) - size + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Least value of every multiply-shift hash over a set."""
    best = np.full(len(factors), np.iinfo(np.uint32).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        best = np.minimum(best, ((factors[:, None] * part[None, :] + shifts[:, None]) >> np.uint64(32)).min(axis=1))
    return best


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    full = np.iinfo(np.uint64).max
    return random.integers(0, full, n, np.uint64) | np.uint64(1), random.integers(0, full, n, np.uint64)


def _features(docs: DataFrame, rule: NearDup) -> DataFrame:
    """docs: id, text. Adds set size, 128-bit fingerprint of the set, band keys and one byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _hash_family(rule.bands * rule.rows)
        mix = _hash_family(rule.rows)[0]
        salt = np.arange(rule.bands, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        for batch in batches:
            sizes, prints, bands, signs = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), rule.words)
                sizes.append(len(shingles))
                prints.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                if len(shingles):
                    low = minima(shingles, factors, shifts)
                    keys = (low.reshape(rule.bands, rule.rows) * mix).sum(axis=1, dtype=np.uint64) ^ salt
                    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    bands.append(keys.view(np.int64))
                    signs.append(low.astype(np.uint8).tobytes())
                else:
                    bands.append(np.empty(0, np.int64))
                    signs.append(b"")
            offsets = np.cumsum([0, *map(len, bands)])
            lists = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *bands]), pa.int64())
            )
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists, pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "print", "bands", "sign"])

    return docs.mapInArrow(run, "id long, n long, print binary, bands array<long>, sign binary")


def _pressed(source: DataFrame) -> DataFrame:
    """id, text of source, each text compressed before it is sent anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "text"])

    return source.where("text is not null").mapInArrow(run, "id long, text binary")


def _agreement(pairs: DataFrame, signs: DataFrame, rule: NearDup) -> DataFrame:
    """pairs (u, hub) with alike, the share of places in which their signatures agree; null where an id has several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [
                None if a is None or b is None else float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.float64())], ["u", "hub", "alike"])

    both = pairs.join(signs.toDF("u", "a"), "u").join(signs.toDF("hub", "b"), "hub")
    return settle(both.select("u", "hub", "a", "b").mapInArrow(run, "u long, hub long, alike double"))


def _beside_hubs(pairs: DataFrame, texts: DataFrame, rule: NearDup) -> DataFrame:
    """Comparison of pairs (u, hub, alike); texts: id, which, n, text.

    One row per text of u, and per text of a hub: hub, u, which, size (of the set), bin (of the
    Jaccard distance from the hub's first text), linked (to any text of the hub) and guess. Pairs
    whose signatures are too far apart are not linked; their distance is the signatures' (guess 1).
    All others are compared exactly; a hub's texts travel once for about SHARE of its pairs.
    """
    far = F.coalesce(100 * F.col("alike") < rule.percent - rule.slack, F.lit(False))
    known = texts.select(F.col("id").alias("u"), "which", F.col("n").alias("size"))
    apart = pairs.where(far).join(known, "u").select(
        "hub", "u", "which", "size", F.floor(BINS * (1 - F.col("alike"))).cast("int").alias("bin"), F.lit(False).alias("linked"), F.lit(1).alias("guess")
    )
    hubs_too = pairs.select(F.col("hub").alias("u")).distinct().withColumn("hub", F.col("u")).join(known.where("which = 1"), "u").select(
        "hub", "u", "which", "size", F.lit(0).alias("bin"), F.lit(True).alias("linked"), F.lit(0).alias("guess")
    )
    pairs = pairs.where(~far)
    counted = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SHARE).alias("parts"))
    dealt = settle(pairs.join(counted, "hub").select("hub", "u", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part")))
    own = texts.select(F.col("id").alias("u"), "which", "text")
    members = dealt.join(own, "u").select("hub", "part", F.lit(1).alias("side"), "u", "which", "text")
    hubs = dealt.select("hub", "part").distinct().join(texts.select(F.col("id").alias("hub"), "which", "text"), "hub")
    hubs = hubs.select("hub", "part", F.lit(0).alias("side"), F.col("hub").alias("u"), "which", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, opener = None, [], zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, bins, linked = [], [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for (hub, part, side), text in zip(keys, batch.column(5), strict=True):
                if (hub, part) != now:
                    now, known = (hub, part), []
                own = shingle_set(opener.decompress(text.as_py()), rule.words)
                if side == 0:
                    known.append(own)
                    continue
                both = np.array([len(np.intersect1d(own, k, assume_unique=True)) for k in known])
                union = len(own) + np.array([len(k) for k in known]) - both
                sizes.append(len(own))
                bins.append(int(BINS * (1 - both[0] / union[0])))
                linked.append(bool((100 * both >= rule.percent * union).any()))
            mine = batch.filter(pc.equal(batch.column(2), 1))
            columns = [mine.column(0), mine.column(3), mine.column(4), pa.array(sizes, pa.int64()), pa.array(bins, pa.int32()), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["hub", "u", "which", "size", "bin", "linked"])

    rows = members.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "side", "which")
    compared = rows.mapInArrow(run, "hub long, u long, which int, size long, bin int, linked boolean")
    # A hub's other texts are left out of what follows: every member has met all of them.
    return settle(compared.withColumn("guess", F.lit(0)).unionByName(apart).unionByName(hubs_too))


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of `left` with each of `right`, from products of 0/1 matrices."""
    whole = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    _, column, times = np.unique(whole, return_inverse=True, return_counts=True)
    several = times > 1  # what one set alone has is in no intersection of two
    number = np.cumsum(several) - 1
    owner, column = owner[several[column]], number[column[several[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(several.sum()), COLUMNS):
        some = slice(*np.searchsorted(column, (at, at + COLUMNS)))
        dense = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        dense[owner[some], column[some] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


def joined_labels(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label reachable from each row and column of a link matrix, labels being those given."""
    top = np.iinfo(np.int64).max
    while True:
        a = np.minimum(left, np.where(links, right[None, :], top).min(axis=1, initial=top))
        b = np.minimum(right, np.where(links, a[:, None], top).min(axis=0, initial=top))
        if (a == left).all() and (b == right).all():
            return a, b
        left, right = a, b


def _among_members(compared: DataFrame, joined: DataFrame, texts: DataFrame, rule: NearDup) -> DataFrame:
    """Links (u, v) between components that the members of a hub's buckets still have among themselves.

    Members that a linked pair might join differ in their distance from the hub by no more than the
    distance of a link (Jaccard distance is a metric; a guess may be off by the slack), and members of the hub's own component need
    no link among themselves. So the members of a hub are dealt to blocks by step of distance, and
    only blocks within reach are compared, with exact set sizes, inside a task. A task returns at
    most one link for each of its members.
    """
    label = joined.select(F.col("node").alias("u"), F.col("component_id").alias("c"))
    placed = compared.join(label, "u", "left").withColumn("c", F.coalesce("c", "u"))
    home = joined.select(F.col("node").alias("hub"), F.col("component_id").alias("h"))
    placed = placed.join(home, "hub", "left").withColumn("out", (F.col("c") != F.coalesce("h", "hub")).cast("int"))
    apart = placed.groupBy("hub").agg(F.max("out").alias("any")).where("any = 1").drop("any")
    left_table = settle(placed.join(apart, "hub").select("hub", "u", "which", "size", "c", (F.col("bin") * 4 + F.col("guess") * 2 + F.col("out")).alias("cell")))
    cells = left_table.groupBy("hub", "cell").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    cells = settle(cells.select("hub", "cell", F.greatest(F.ceil(F.col("m") / MEMBERS), F.ceil(F.col("s") / SHINGLES)).alias("parts")))
    block = F.shiftleft(F.col("cell").cast("bigint"), 32) + F.pmod(F.xxhash64("u", "which"), F.col("parts"))
    left = left_table.join(cells, ["hub", "cell"]).select("hub", "u", "which", "c", block.alias("block"))
    blocks = cells.select("hub", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.select("hub", "cell", (F.shiftleft(F.col("cell").cast("bigint"), 32) + F.col("part")).alias("block"))
    reach = BINS * (100 - rule.percent) // 100 + 1
    a, b = blocks.toDF("hub", "ca", "a"), blocks.toDF("hub", "cb", "b")
    guessed = F.expr("(ca div 2) % 2 + (cb div 2) % 2") * (BINS * rule.slack // 100 + 1)
    near = F.abs(F.expr("ca div 4 - cb div 4")) <= reach + guessed
    tasks = a.join(b, "hub").where(near & (F.col("a") <= F.col("b")) & (F.col("ca") % 2 + F.col("cb") % 2 > 0)).select("hub", "a", "b")
    tasks = settle(tasks)
    first = tasks.withColumn("block", F.col("a")).join(left, ["hub", "block"]).withColumn("side", F.lit(0))
    second = tasks.where("a < b").withColumn("block", F.col("b")).join(left, ["hub", "block"]).withColumn("side", F.lit(1))
    rows = first.unionByName(second).join(texts.select(F.col("id").alias("u"), "which", "text"), ["u", "which"])
    rows = rows.select("hub", "a", "b", "side", "c", "text").repartition("hub", "a", "b").sortWithinPartitions("hub", "a", "b", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, labels, opener = None, ([], []), ([], []), zstandard.ZstdDecompressor()

        def links() -> pa.RecordBatch:
            right = 1 if now[1] != now[2] else 0
            c = [np.array(x, np.int64) for x in (labels[0], labels[right])]
            sizes = [np.array([len(x) for x in y], np.int64) for y in (sets[0], sets[right])]
            both = common(sets[0], sets[right])
            linked = (both > 0) & (100 * both >= rule.percent * (sizes[0][:, None] + sizes[1][None, :] - both))
            linked &= c[0][:, None] != c[1][None, :]
            found = np.column_stack([np.concatenate(c), np.concatenate(joined_labels(linked, *c))])
            found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            for (hub, one, other, side, c), text in zip(keys, batch.column(5), strict=True):
                if (hub, one, other) != now:
                    if now is not None:
                        yield links()
                    now, sets, labels = (hub, one, other), ([], []), ([], [])
                sets[side].append(shingle_set(opener.decompress(text.as_py()), rule.words))
                labels[side].append(c)
        if now is not None:
            yield links()

    found = settle(rows.mapInArrow(run, "u long, v long").distinct())
    for done in (left_table, cells, tasks):
        forget(done)
    return found


def near_duplicates(docs: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, fingerprint, component_id, kept.

    Two documents are linked if their shingle sets reach the rule's similarity; component_id is the
    least id reachable by links and kept says that it is the row's own. Texts that are null, empty
    or only white space have no shingles and are linked with nothing. Rows with a null id take no
    part: component null, kept true. Rows that share an id are one document with the links of all
    their texts; each is returned. Ties cannot occur.

    Equal sets are first one class, by a 128-bit fingerprint. Classes that share a band are a bucket,
    and its hub is the member that meets most others over all bands: in a group of edited copies
    that is the text they were made from. All members are compared with their hubs, exactly.
    What is still apart then is compared with the other members of its hubs, exactly too, by blocks
    of like distance from the hub. So every pair that shares a band is decided; copies of one
    text that stay near it cost one comparison each, no bucket is gathered, and nothing is
    capped. The work of a group whose members are too far from its hub grows with the square of
    their number.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = settle(_features(source, rule))
    usable = features.where("n > 0 and id is not null")
    reps = settle(usable.groupBy("print").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sign").alias("sign")))
    member = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("key")).distinct()
    counted = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = settle(member.join(counted, "key"))
    central = buckets.groupBy("id").agg(F.sum("m").alias("meets"))
    scored = buckets.join(central, "id").select("key", F.struct("meets", (-F.col("id")).alias("id")).alias("score"))
    hubs = scored.groupBy("key").agg((-F.max("score")["id"]).alias("hub"))
    pairs = settle(buckets.join(hubs, "key").where("id <> hub").select(F.col("id").alias("u"), "hub").distinct())
    wanted = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("hub").alias("id"))).distinct()
    order = Window.partitionBy("id").orderBy(F.xxhash64("text"), "text")
    texts = _pressed(source).join(wanted, "id", "left_semi").dropDuplicates(["id", "text"])
    sizes = reps.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"), F.count("*").alias("sets"), F.first("sign").alias("sign"))
    texts = texts.withColumn("which", F.row_number().over(order)).join(sizes, "id").select("id", "which", "n", "text")
    texts = settle(texts)
    signs = sizes.select("id", F.when(F.col("sets") == 1, F.col("sign")).alias("sign"))

    # Texts of one id are one document.
    named = usable.join(reps.select("print", "rep"), "print").select("id", "rep")
    several = named.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("w")).where("u <> w").drop("w")
    links = named.join(several, "id").select("u", F.col("rep").alias("v")).distinct()
    measured = _agreement(pairs, signs, rule)
    compared = _beside_hubs(measured, texts, rule)
    joined = components(links.unionByName(compared.where("linked").select("u", F.col("hub").alias("v"))))
    more = _among_members(compared, joined, texts, rule)
    if not more.isEmpty():
        joined = components(joined.toDF("u", "v").unionByName(more))
    for done in (buckets, pairs, texts, measured, compared):
        forget(done)

    final = reps.select("print", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select("print", F.coalesce("component_id", "rep").alias("component_id"))
    whole = features.select("id", "n", "print").join(final, "print", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return whole.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("print").alias("fingerprint"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: one row of each component stays, whole and with its own columns.

    Rows with a null id, and those without words, stay; of rows that repeat an id one stays.
    """
    n, k = fresh(docs, "_row", "_keep")
    kept = near_duplicates(docs, rule, id_col, text_col).where(F.col("kept") & F.col(id_col).isNotNull())
    ids = kept.select(F.col(id_col).alias(k)).distinct()
    known = docs.where(F.col(id_col).isNotNull()).join(ids, F.col(id_col).cast("long") == F.col(k), "left_semi")
    order = Window.partitionBy(F.col(id_col).cast("long")).orderBy(F.xxhash64(text_col), text_col)
    known = known.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)
    return known.unionByName(docs.where(F.col(id_col).isNull()))
