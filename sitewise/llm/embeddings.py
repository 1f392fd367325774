"""Near-duplicate vectors: a forest of random-projection trees with spill, exact cosines inside leaves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import settle, ship, shipped
from sitewise.llm.components import components

SEED = 7_919
BAND = 2.0  # width of a split's band, in deviations of what the longest link spans along it


SAMPLE_BYTES = 64 << 20  # of vectors that the trees are fitted on, as they reach the driver


@dataclass(frozen=True)
class Forest:
    """cosine: least cosine of a link. trees, leaf, spill: number of trees, vectors a leaf aims at,
    and the least share of a node's vectors that go to both sides of its split. sample: vectors the
    splits are fitted on, at most. block: rows of a leaf that one task compares with as many."""

    cosine: float = 0.98
    trees: int = 5
    leaf: int = 1024
    spill: float = 0.12
    sample: int = 40_000
    block: int = 2048


@dataclass(frozen=True)
class Split:
    """Vectors with a projection below `high` go left, those above `low` go right; number is a leaf's own."""

    direction: np.ndarray | None
    low: float
    high: float
    left: "Split | None"
    right: "Split | None"
    number: int


def _cut(at: np.ndarray, spill: float, width: float) -> tuple[float, float, float]:
    """(low, high, cost) of the cut with the least comparing work: squares of both sides by that of the node.

    What lies between low and high goes to both sides: the share `spill` at least, and all within
    `width` of each other. Cuts beside a dense group are cheaper than through it.
    """
    at, n = np.sort(at), len(at)
    middle = np.linspace(0.1, 0.9, 33)
    middle = middle[np.argsort(np.abs(middle - 0.5), kind="stable")]  # the median wins ties
    centre = np.quantile(at, middle)
    low = np.minimum(np.quantile(at, np.maximum(middle - spill / 2, 0.0)), centre - width / 2)
    high = np.maximum(np.quantile(at, np.minimum(middle + spill / 2, 1.0)), centre + width / 2)
    left, right = np.searchsorted(at, high, "right") / n, 1 - np.searchsorted(at, low, "left") / n
    cost = left**2 + right**2
    best = int(np.argmin(cost))
    return float(low[best]), float(high[best]), float(cost[best])


def fit_tree(sample: np.ndarray, leaf: float, spill: float, width: float, random: np.random.Generator, numbers: Iterator[int]) -> Split:
    """Random splits until a node has fewer sampled vectors than `leaf`, or no cut saves work.

    width: of the band that goes to both sides at least. A group of vectors that are all linked is
    hardly wider than it, so such a group stays one leaf, however large.
    """
    if len(sample) >= max(leaf, 16):
        direction = random.standard_normal(sample.shape[1])
        direction /= np.linalg.norm(direction)
        at = sample @ direction
        low, high, cost = _cut(at, spill, width)
        left, right = sample[at <= high], sample[at >= low]
        if cost < 0.9:
            return Split(
                direction, low, high, fit_tree(left, leaf, spill, width, random, numbers),
                fit_tree(right, leaf, spill, width, random, numbers), -1,
            )
    return Split(None, 0.0, 0.0, None, None, next(numbers))


def leaves_of(tree: Split, vectors: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(positions of the vectors that reach it, number) of each leaf."""
    out, todo = [], [(tree, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node.direction is None:
            out.append((rows, node.number))
            continue
        at = vectors[rows] @ node.direction
        todo += [(node.left, rows[at <= node.high]), (node.right, rows[at >= node.low])]
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that very small or large values don't vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def fit_forest(sample: np.ndarray, expected: float, rule: Forest) -> list[Split]:
    """expected: vectors of the largest label; leaves shrink on the sample as the sample does against all.

    Along a random direction the ends of the longest link lie apart by its length times a deviate of
    variance 1 by the number of components, whatever the vectors; the band is BAND such deviates wide.
    """
    leaf = rule.leaf * len(sample) / max(expected, 1.0)
    width = BAND * np.sqrt(max(2 * (1 - rule.cosine), 0.0) / sample.shape[1])
    out, first = [], 0
    for t in range(rule.trees):
        numbers = iter(range(first, 1 << 60))
        out.append(fit_tree(sample, leaf, rule.spill, width, np.random.default_rng((SEED, t)), numbers))
        first = next(numbers)
    return out


def _local_links(ids: np.ndarray, unit: np.ndarray, weight: np.ndarray, leaves: list[frozenset], here: int, left: np.ndarray, right: np.ndarray, rule: Forest):
    """Per vector of a leaf (or pair of its blocks): vectors linked in it, and the least id it reaches in it.

    A pair counts in the first leaf, by number, that holds both, so no link counts twice.
    """
    n = len(ids)
    links, least = np.zeros(n, np.int64), ids.copy()
    bits = _earlier(leaves, here)
    same = len(left) == len(right) and bool((left == right).all())  # a block with itself
    us, vs = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        close = unit[rows] @ unit[right].T >= rule.cosine
        i, j = np.nonzero(np.triu(close, at + 1) if same else close)
        u, v = rows[i], right[j]
        own = np.ones(len(u), bool)
        for word in bits:
            own &= (word[u] & word[v]) == 0
        for a, b in ((u[own], v[own]), (v[own], u[own])):
            np.add.at(links, a, weight[b])
        us.append(u.astype(np.int32))
        vs.append(v.astype(np.int32))
    u, v = np.concatenate(us), np.concatenate(vs)
    while len(u):
        before = least.copy()
        np.minimum.at(least, u, least[v])
        np.minimum.at(least, v, least[u])
        if (before == least).all():
            break
    return links, least


def _earlier(leaves: list[frozenset], here: int) -> list[np.ndarray]:
    """Bit sets, 64 leaves a word, of the leaves numbered below `here` that each vector is in, where two are in one."""
    seen: dict[int, list[int]] = {}
    for i, own in enumerate(leaves):
        for number in own:
            if number < here:
                seen.setdefault(number, []).append(i)
    out: list[np.ndarray] = []
    for k, rows in enumerate(x for x in seen.values() if len(x) > 1):
        if k % 64 == 0:
            out.append(np.zeros(len(leaves), np.uint64))
        out[-1][rows] |= np.uint64(1 << (k % 64))
    return out


def link(vectors: DataFrame, rule: Forest = Forest(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    Vectors of one label are linked if their cosine, in double precision, reaches the rule's and a
    tree puts both in a leaf. A vector that is null, empty, zero or holds a null or non-finite
    component, and one whose label or id is null, is linked with nothing and is its own component
    (kept). Vectors of different lengths are never linked. Rows that repeat an id count as vectors
    of their own for the others; their links add up and they share what they reach.

    Equal vectors of a label are one class first: a vector that a third of all rows share is
    compared once. The trees are fitted on at most `sample` classes drawn by hash; all classes go
    down them. Leaves larger than `block` are compared in pairs of blocks. A leaf returns one row
    per vector, never its pairs.
    """
    v = F.col("v")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound &= F.exists(v, lambda x: x != 0)
    ok = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    plain = F.transform(v, lambda x: x + 0.0)  # minus zero is zero
    rows = source.select("id", "label", "v", ok.alias("ok"))
    kind = F.md5(F.concat_ws(",", F.transform(plain, lambda x: F.hex(F.xxhash64(x)))).cast("binary"))
    keyed = rows.where("ok").select("id", "label", F.xxhash64("label", kind).alias("h1"), kind.alias("kind"), "v")
    classes = settle(
        keyed.groupBy("label", "kind").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("v").cast("array<float>").alias("f"), F.first("v").alias("v"))
        .select("label", "kind", "rep", "w", F.when(F.col("f").cast("array<double>") == v, F.lit(None)).otherwise(v).alias("v"), "f")
    )
    sizes = classes.groupBy("label", F.size("f").alias("d")).count()
    top = sizes.groupBy("d").agg(F.max("count").alias("most"), F.sum("count").alias("all")).orderBy("d").collect()
    found = None
    for size in top:  # one forest per length of vector; a table has one, as a rule
        part = classes.where(F.size("f") == size["d"])
        wanted = min(rule.sample, max(1, SAMPLE_BYTES // (4 * max(size["d"], 1))))
        share = min(1.0, wanted / size["all"])
        drawn = part.where(F.pmod(F.xxhash64("kind"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("f").limit(2 * wanted)
        flat = drawn.toArrow().column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sample = _unit(flat.reshape(-1, size["d"]).astype(float) if len(flat) else np.ones((1, size["d"])))
        # One forest serves all labels: their vectors are kept apart by the key of the leaf.
        forest = fit_forest(sample, size["most"], rule)
        part = _in_leaves(part, forest, rule)
        found = part if found is None else found.unionByName(part)
    if found is None:
        linked = classes.select("rep", F.lit(0).cast("long").alias("links"), F.col("rep").alias("least"))
    else:
        linked = settle(found)
    edges = linked.where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct()
    repeated = keyed.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id")
    twice = keyed.select("id", "label", "kind").join(repeated, "id").join(classes.select("label", "kind", "rep"), ["label", "kind"])
    same = twice.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct()
    joined = components(edges.unionByName(same))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    # A class is named by (label, kind); rep alone may name two classes where ids repeat.
    whole = classes.select("label", "kind", "rep", "w").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("label", "kind", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    good = keyed.select("id", "label", "kind").join(whole, ["label", "kind"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(alone)
    return out.select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _in_leaves(classes: DataFrame, forest: list[Split], rule: Forest) -> DataFrame:
    """(rep, links, least) of every class and leaf that holds it with a class it is linked with."""
    shared = ship(classes.sparkSession, forest)  # at most 2 * sample / 16 splits per tree

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped(shared)
        for batch in batches:
            if not batch.num_rows:
                continue
            exact, short = batch.column(3).to_pylist(), batch.column(4)
            width = len(short[0])
            raw = np.asarray(short.flatten(), float).reshape(-1, width)
            for i, x in enumerate(exact):
                if x is not None:
                    raw[i] = x
            unit = _unit(raw)
            pairs = [(int(i), number) for tree in trees for rows, number in leaves_of(tree, unit) for i in rows]
            of: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for i, number in pairs:
                of[i].append(number)
            at = pa.array([i for i, _ in pairs], pa.int64())
            own = pa.array([of[i] for i, _ in pairs], pa.list_(pa.int32()))
            columns = [batch.column(k).take(at) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for _, x in pairs], pa.int32()), own], ["label", "rep", "w", "v", "f", "leaf", "leaves"])

    label = classes.schema["label"].dataType.simpleString()
    routed = classes.select("label", "rep", "w", "v", "f").mapInArrow(
        route, f"label {label}, rep long, w long, v array<double>, f array<float>, leaf int, leaves array<int>"
    )
    routed = settle(routed)
    many = routed.groupBy("label", "leaf").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    sized = routed.join(many, ["label", "leaf"])
    n = F.ceil(F.col("size") / rule.block).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("size", "other")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        leaf, lo, hi = int(key[1]), int(key[2]), int(key[3])
        raw = np.stack([np.asarray(f if v is None else v, float) for v, f in zip(group["v"], group["f"], strict=True)])
        ids, weight, block = (group[c].to_numpy(np.int64) for c in ("rep", "w", "own"))
        left, right = np.nonzero(block == lo)[0], np.nonzero(block == hi)[0]
        links, least = _local_links(ids, _unit(raw), weight, [frozenset(map(int, x)) for x in group["leaves"]], leaf, left, right, rule)
        some = (links > 0) | (least != ids)
        return pd.DataFrame({"rep": ids[some], "links": links[some], "least": least[some]})

    return dealt.groupBy("label", "leaf", "lo", "hi").applyInPandas(compare, "rep long, links long, least long")
