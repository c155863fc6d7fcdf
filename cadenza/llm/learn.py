"""Bounded labelled samples, and the optimiser the numpy networks share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of what a classifier is fitted on: labelled documents of a class, and
#: bytes of the longest text among them.  Everything else covers all rows.
SAMPLE_PER_CLASS = 3000
SAMPLE_BYTES = 20_000


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str,
                    per_class: int = SAMPLE_PER_CLASS, max_bytes: int = SAMPLE_BYTES):
    """(texts as bytes, labels, weights) of at most ``per_class`` documents of
    either class, the first by a hash of doc_id.  A weight is the number of
    labelled documents that one of its class stands for.

    ``labels`` holds doc_id and ``label_col``; null labels are left out, and so
    are ids whose labels disagree and texts over ``max_bytes``.
    """
    clear = (labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
             .groupBy(F.col("doc_id").alias("__id"))
             .agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__high"))
             .filter("__label = __high").select("__id", "__label", F.xxhash64("__id").alias("__h")))
    rows, total = [], dict(clear.groupBy("__label").count().collect())
    for label in (0, 1):
        chosen = clear.filter(F.col("__label") == label).orderBy("__h", "__id").limit(per_class)
        found = (docs.filter(F.octet_length("text") <= max_bytes)
                 .join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))     # at most per_class rows
                 .groupBy("__id", "__label").agg(F.min("text").alias("text")))
        rows += [(r["__id"], r["text"].encode(), label) for r in found.collect()]
    rows.sort()
    y = np.array([r[2] for r in rows], np.int64)
    weight = np.array([total.get(k, 0) for k in (0, 1)]) / np.maximum(1, np.bincount(y, minlength=2))
    return [r[1] for r in rows], y, weight[y]


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], decay: float = 0.0) -> None:
        self.step += 1
        a = self.rate * np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= a * self.m[k] / (np.sqrt(self.v[k]) + 1e-8) + self.rate * decay * self.params[k]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_temperature(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of lowest log loss on held-back rows, by golden section
    over its logarithm.  The labels are drawn in by one row of either class, so
    that rows told apart without an error do not make it vanish."""
    n = np.bincount(labels, minlength=2)
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))

    def loss(t):
        z = logits / np.exp(t)
        return float(np.mean(weight * (np.logaddexp(0, z) - target * z)))
    lo, hi, g = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
