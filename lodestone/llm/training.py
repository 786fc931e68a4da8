"""Bounded training samples and small numpy optimisers for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def sampled(docs: DataFrame, ids: DataFrame, most: int) -> pa.Table:
    """Texts of at most ``most`` of the ids (doc_id, and more columns): those whose hash
    is least, so that the same rows give the same sample. Sorted by doc_id."""
    few = ids.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    got = docs.select("doc_id", "text").filter("doc_id is not null").join(F.broadcast(few), "doc_id").toArrow()
    return got.sort_by("doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam over a list of arrays, in place."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.first = [np.zeros_like(w) for w in weights]
        self.second = [np.zeros_like(w) for w in weights]

    def move(self, slopes: list[np.ndarray]) -> None:
        self.step += 1
        for w, g, m, v in zip(self.weights, slopes, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
