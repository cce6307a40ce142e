"""Labelled rows to learn from: a bounded sample, chosen by hash, without the held-out rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.shared import texts


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of about ``bound`` labelled rows at most, of those that ``may_learn`` (over doc_id) allows.

    Only the sample's ids and labels, bounded by ``bound``, are joined to the texts; a doc_id with
    labels of both kinds or none teaches nothing.
    """
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y"))
        .filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most"))
        .filter("y = most").select("doc_id", "y").filter(may_learn)
    )
    count = known.count()
    share = 1_000_000 if count <= bound else max(1, int(1e6 * bound / count))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < F.lit(share))
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model drawn towards ``prior``, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    pull = np.full(a.shape[1], strength)
    pull[-1] = 1e-3
    w = prior.astype(float).copy()
    for _ in range(rounds):
        p = sigmoid(a @ w)
        slope = a.T @ (p - y) + pull * (w - prior)
        curve = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
