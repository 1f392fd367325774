"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import fresh, held_out, settle, ship, shipped
from sitewise.llm.fitting import fit_logistic, learning_rows, sigmoid

WORDS = re.compile(r"[^\W_]+")
STEMS = range(4, 8)  # lengths of word beginnings that may become patterns
LEVELS = (1, 2, 3)  # a voter speaks when its word or stem occurs this often,
RATES = (5, 10, 15)  # or this often per thousand words
MOST_RATE = 30  # per thousand words; what is beyond counts no further in the classifier
REMEMBERED = 300_000  # words whose terms a task keeps
FLUSH = 400_000  # terms a task counts before it hands them on


@dataclass(frozen=True)
class Voting:
    """voters: most voters kept; pool: distinct terms looked at for each of them; support: labelled rows
    a term needs; z: least standard score of its excess among toxic rows; overlap: share of common
    votes from which a stem repeats a better one."""

    voters: int = 256
    pool: int = 4
    support: int = 8
    z: float = 6.0
    overlap: float = 0.98


@dataclass(frozen=True)
class Model:
    """terms: term -> place of its count; weights of the linear classifier over log counts, then over rates."""

    terms: dict[str, int]
    weights: np.ndarray
    intercept: float


def terms_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a hat."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) >= k)]


def term_counts(text: str | None) -> tuple[Counter, int]:
    """(occurrences of every term, words) of a text."""
    counts: Counter = Counter()
    words = WORDS.findall((text or "").lower())
    for word, n in Counter(words).items():
        for term in terms_of(word):
            counts[term] += n
    return counts, len(words)


def speaks(counts, words, level: int):
    """Whether a voter of this level speaks: levels from 1 on are counts, those below 0 are rates."""
    return counts >= level if level > 0 else (counts >= 1) & (1000 * counts >= -level * words)


def inputs(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The classifier's inputs: log counts, and hundredths of the words up to MOST_RATE."""
    rate = np.minimum(1000.0 * counts / np.maximum(words, 1)[:, None], MOST_RATE) / 10
    return np.hstack([np.log1p(counts), rate])


def _term_table(rows: DataFrame) -> DataFrame:
    """term, level, n1 (toxic rows in which its voter speaks), n0 (other rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int, int], list[int]] = {}

        def batch_of() -> pa.RecordBatch:
            columns = [*([k[i] for k in found] for i in range(3)), [v[1] for v in found.values()], [v[0] for v in found.values()]]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["term", "c", "r", "n1", "n0"])

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts, words = term_counts(text.as_py())
                for term, n in counts.items():
                    key = (term, min(n, LEVELS[-1]), bisect_right(RATES, 1000 * n / words))
                    found.setdefault(key, [0, 0])[y] += 1
                if len(found) > FLUSH:
                    yield batch_of()
                    found.clear()
        yield batch_of()

    parts = rows.select("text", "y").mapInArrow(run, "term string, c int, r int, n1 long, n0 long")
    parts = parts.groupBy("term", "c", "r").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counted = F.sequence(F.lit(1), F.col("c"))
    rated = F.slice(F.array(*[F.lit(-x) for x in RATES]), F.lit(1), F.col("r"))
    parts = parts.select("term", "n1", "n0", F.explode(F.concat(counted, rated)).alias("level"))
    return parts.groupBy("term", "level").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


class TermCounter(dict):
    """Word -> places of the terms it counts for; most words have none."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = got = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
        return got

    def count(self, text: str | None) -> tuple[dict[int, int], int]:
        out: dict[int, int] = {}
        words = WORDS.findall((text or "").lower())
        for word in words:
            for place in self[word]:
                out[place] = out.get(place, 0) + 1
        return out, len(words)


def _count_matrix(rows: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, words, y) of the learning rows: bounded by MOST_LABELLED rows and the number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(terms)
        for batch in batches:
            got = [counter.count(text.as_py()) for text in batch.column(1)]
            lists = [pa.array([list(x) for x in column], pa.list_(pa.int32())) for column in ([g[0] for g in got], [g[0].values() for g in got])]
            columns = [batch.column(0), batch.column(2), pa.array([g[1] for g in got], pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "y", "words", "at", "n"])

    found = rows.select("id", "text", "y").mapInArrow(run, "id long, y int, words long, at array<int>, n array<int>")
    got = found.orderBy("id", "words", "at", "n").collect()
    counts = np.zeros((len(got), len(terms)))
    for i, r in enumerate(got):
        counts[i, r["at"]] = r["n"]
    return counts, np.array([r["words"] for r in got], float), np.array([r["y"] for r in got], float)


def label_model(votes: np.ndarray, given: np.ndarray, trust: float = 0.95, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each row, weight of each voter) of a two-class generative model, by EM.
    The given labels are one more voter, right with chance `trust`.

    A voter speaks with a chance of its own in each class; silence is no evidence, as most voters
    know a few words only, so a last voter speaks for the clean class where no other does. Voters
    that repeat each other inside the classes are not independent witnesses: the correlations of
    their residuals are estimated in every round, and a voter's evidence is divided by the sum of
    its squared ones.
    """
    votes = np.hstack([votes, ~votes.any(axis=1, keepdims=True)]).astype(float)
    gold = np.log(trust / (1 - trust)) * (2 * given - 1)
    q = sigmoid(gold)
    weight = np.ones(votes.shape[1])
    for _ in range(rounds):
        n1, n0 = q.sum(), (1 - q).sum()
        prior = (n1 + 1) / (n1 + n0 + 2)
        p1, p0 = (q @ votes + 0.5) / (n1 + 1), ((1 - q) @ votes + 0.5) / (n0 + 1)
        rest = votes - (q[:, None] * p1 + (1 - q)[:, None] * p0)
        rest /= np.sqrt((rest * rest).sum(axis=0)) + 1e-12
        weight = 1.0 / np.maximum(1.0, ((rest.T @ rest) ** 2).sum(axis=0))
        weight[-1] = 1.0  # silence repeats no voter
        z = gold + np.log(prior / (1 - prior)) + votes @ (weight * np.log(p1 / p0))
        before, q = q, sigmoid(z)
        if np.abs(q - before).max(initial=0.0) < 1e-6:
            break
    return q, weight


def learn(docs: DataFrame, labels: DataFrame, rule: Voting = Voting(), id_col: str = "doc_id", text_col: str = "text", target: str = "toxic") -> Model:
    """The voters with the highest standard score in the learning folds, of different terms first, judged together by the
    label model, whose posteriors teach the classifier. Without labelled rows, or with one class
    only, there are no voters and the score is the same for all texts."""
    rows = settle(learning_rows(docs, labels, target, id_col=id_col, text_col=text_col))
    sums = rows.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    n, n1 = sums["n"], sums["n1"] or 0
    n0 = n - n1
    if not n1 or not n0:
        return Model({}, np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5)) if n else -3.0))
    p = (F.col("n1") + F.col("n0")) / n
    score = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p + 1 / n) * (1 / n1 + 1 / n0))
    best = _term_table(rows).where(F.col("n1") >= rule.support).withColumn("z", score).where(F.col("z") >= rule.z)
    # Terms are bounded, not (term, level): a term's levels, six at most, never take the place of another term.
    terms = best.groupBy("term").agg(F.max("z").alias("z"), F.sort_array(F.collect_list(F.struct((-F.col("z")).alias("z"), "level"))).alias("levels"))
    found = terms.orderBy(F.desc("z"), "term").limit(rule.pool * rule.voters).collect()
    candidates = {r["term"]: i for i, r in enumerate(found)}
    best = sorted((place, x["z"], r["term"], x["level"]) for r in found for place, x in enumerate(r["levels"]))
    counts, words, y = _count_matrix(rows, candidates)
    kept, columns = [], []
    for _, _, term, level in best:  # every term's best level first
        vote = speaks(counts[:, candidates[term]], words, level)
        if all((vote & c).sum() < rule.overlap * (vote | c).sum() for c in columns):
            kept.append(term)
            columns.append(vote)
        if len(kept) == rule.voters:
            break
    if not kept:
        return Model({}, np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    votes = np.stack(columns, axis=1)
    posterior, _ = label_model(votes, y)
    terms = {t: i for i, t in enumerate(dict.fromkeys(kept))}
    w = fit_logistic(inputs(counts[:, [candidates[t] for t in terms]], words), posterior)
    return Model(terms, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Whole texts are read, inside a task and without a shuffle; null counts as empty and scores like
    any text without a voter's word. Input columns of these names are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    (s,) = fresh(docs, "_score")
    shared = ship(docs.sparkSession, model)  # at most Voting.voters terms
    names = [*docs.columns, s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped(shared)
        counter = TermCounter(known.terms)
        weights = known.weights
        at = names.index(text_col)
        for batch in batches:
            z = []
            for text in batch.column(at):
                got, words = counter.count(text.as_py())
                if not got:
                    z.append(known.intercept)
                    continue
                n = np.zeros((1, len(known.terms)))
                n[0, list(got)] = list(got.values())
                z.append(known.intercept + float(inputs(n, np.array([words]))[0] @ weights))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(np.array(z, float)), pa.float64())], names)

    out_schema = docs.withColumn(s, F.lit(0.0)).schema
    scored = docs.mapInArrow(run, out_schema)
    return scored.select(
        *docs.columns, held_out(F.col(id_col)).alias("held_out"), F.col(s).alias("score"), (F.col(s) >= 0.5).cast("int").alias("predicted")
    )
