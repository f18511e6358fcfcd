"""Labelled rows for fitting, and logistic regression in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 20_000


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learnable: Column, bound: int = SAMPLE_ROWS, text: str = "text"
) -> DataFrame:
    """A written table (doc_id, text, label) of at most ``bound`` labelled rows, chosen by hash.

    ``learnable`` is a condition on doc_id; rows outside it are never read for their labels.
    The chosen ids and rows, at most ``bound``, are sent to all executors; no other texts are shuffled.
    Of several labels for an id the largest counts. Of an id's rows with equal texts one is
    taken, and the bound holds for the rows: of too many, those with the least hashes stay.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learnable)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    joined = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    hashed = joined.withColumn("_hash", F.xxhash64("doc_id", "text"))
    kept = hashed.select("doc_id", "_hash").distinct().orderBy("_hash", "doc_id").limit(bound)
    rows = hashed.join(F.broadcast(kept), ["doc_id", "_hash"]).dropDuplicates(["doc_id", "_hash"])
    return written(rows.select("doc_id", "text", "label"), "labelled")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
