"""Labelled rows of the learning folds, and a logistic regression fitted on a bounded matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import held_out

MOST_LABELLED = 20_000  # labelled rows a classifier is fitted on, at most; drawn by hash


def learning_rows(docs: DataFrame, labels: DataFrame, target: str, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most about `most` labelled rows outside the held-out fold.

    A row without a label or id is left out; of labels that repeat an id the greatest counts. The
    text is no key here, so repeated documents stay.
    """
    known = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(known, "id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit_logistic(rows: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, intercept last, by Newton steps with a ridge; targets may be probabilities."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - target) + penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max(initial=0.0)
        w -= step * min(1.0, 4.0 / size if size else 1.0)
        if size < 1e-8:
            break
    return w
