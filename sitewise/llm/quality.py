"""Quality by compression: zstandard dictionaries of good and bad text, compared chunk by chunk."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import fresh, held_out, settle, ship, shipped
from sitewise.llm.fitting import fit_logistic, learning_rows, sigmoid

CHUNK = 1024  # bytes that are compressed on their own, so that a dictionary counts all along a long text
DICTIONARY = 48 * 1024
SAMPLES = 6_000  # chunks a dictionary is made of, at most; drawn by hash
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text, and the calibration: weights over the features, intercept last."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    threshold: float = 0.3


def chunks(text: str | None) -> list[bytes]:
    """The whole text in chunks; the last one has up to twice the size, so that none is tiny."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data) // CHUNK)
    return [data[i * CHUNK : len(data) if i == n - 1 else (i + 1) * CHUNK] for i in range(n)] if data else []


class Gauge:
    """Compressed sizes under two dictionaries, as features of a text."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.tools = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            if d else zstandard.ZstdCompressor(level=LEVEL) for d in (good, bad)
        ]
        self.plain = zstandard.ZstdCompressor(level=LEVEL)

    def features(self, text: str | None) -> list[float]:
        """Difference (good less bad) over the bytes, as mean, greatest and least of the chunks; compressed size
        with the good dictionary and, for the whole text, without one, over the bytes; log of the bytes; emptiness."""
        parts = chunks(text)
        if not parts:
            return [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
        sizes = np.array([[len(tool.compress(p)) for tool in self.tools] for p in parts], float)
        length = np.array([len(p) for p in parts], float)
        diff = (sizes[:, 0] - sizes[:, 1]) / length
        whole = sum(map(len, self.plain_parts(parts)))
        total = length.sum()
        return [
            10 * float((sizes[:, 0] - sizes[:, 1]).sum() / total), 10 * float(diff.max()), 10 * float(diff.min()),
            10 * float(sizes[:, 0].sum() / total), 10 * whole / total, float(np.log(total)), 0.0,
        ]

    def plain_parts(self, parts: list[bytes]) -> Iterator[bytes]:
        tool = self.plain.compressobj()
        for p in parts:
            yield tool.compress(p)
        yield tool.flush()


def _dictionary(rows: DataFrame, y: int) -> bytes:
    """A dictionary of the class's chunks that have the least hashes; empty where there are too few to train on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [p for text in batch.column(0) for p in chunks(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(p) for p in got], pa.int64()), pa.array(got, pa.binary())], ["h", "p"])

    best = rows.where(F.col("y") == y).select("text").mapInArrow(run, "h long, p binary").distinct().orderBy("h", "p").limit(SAMPLES)
    samples = [bytes(r[0]) for r in best.select("p").toLocalIterator()]
    if len(samples) < 8 or sum(map(len, samples)) < 4096:
        return b""
    size = min(DICTIONARY, max(1024, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too uniform to train on: raw content serves as a dictionary as well
        return b"".join(samples)[-size:]


def _feature_rows(rows: DataFrame, good: bytes, bad: bytes) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauge = Gauge(good, bad)
        for batch in batches:
            got = [gauge.features(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.float64()))], ["id", "y", "x"])

    got = rows.select("id", "text", "y").mapInArrow(run, "id long, y int, x array<double>").orderBy("id", "x").collect()
    return np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality") -> Model:
    """Dictionaries from one half of the learning rows and the calibration from the other, so that no
    text is measured with a dictionary that holds it. Without labelled rows of both classes every
    text scores alike."""
    rows = settle(learning_rows(docs, labels, target, id_col=id_col, text_col=text_col))
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))
    n_good, n = (rows.agg(F.sum("y"), F.count("*")).first())
    if not n or not n_good or n_good == n:
        return Model(b"", b"", np.array([0.0] * 7 + [float(np.log(((n_good or 0) + 0.5) / (n - (n_good or 0) + 0.5)))]))
    good, bad = (_dictionary(rows.where(half == 0), y) for y in (1, 0))
    x, y = _feature_rows(rows.where(half == 1), good, bad)
    if not len(y) or y.min() == y.max():
        return Model(good, bad, np.array([-1.0] + [0.0] * 7))
    return Model(good, bad, fit_logistic(x, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1, higher is better) and predicted (1 from the model's threshold on).

    Whole texts are measured inside a task and nothing is shuffled; null counts as empty, and an
    empty text has a score of its own from the calibration. Input columns of these names are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    (s,) = fresh(docs, "_score")
    shared = ship(docs.sparkSession, model)  # two dictionaries of DICTIONARY bytes at most
    names = [*docs.columns, s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped(shared)
        gauge = Gauge(known.good, known.bad)
        at = names.index(text_col)
        for batch in batches:
            x = np.array([gauge.features(text.as_py()) for text in batch.column(at)], float).reshape(-1, 7)
            p = sigmoid(x @ known.weights[:-1] + known.weights[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names)

    scored = docs.mapInArrow(run, docs.withColumn(s, F.lit(0.0)).schema)
    return scored.select(
        *docs.columns, held_out(F.col(id_col)).alias("held_out"), F.col(s).alias("score"),
        (F.col(s) >= model.threshold).cast("int").alias("predicted"),
    )
