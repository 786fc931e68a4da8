"""Model calls as pluggable column functions, each with an offline implementation.

A backend is a function of a batch of texts. Calls run in Arrow batches; the offline
backends are deterministic, so that pipelines can be tested without a model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import config

WIDTH = 64


def hashed_embedding(texts: list[str]) -> list[list[float]]:
    """Unit vectors from hashed words: equal texts are equal, shared words are near. Each
    different word of the batch is hashed once."""
    words = [re.findall(r"[^ \t\n\r\f\v]+", (t or "").lower()) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    different, of_word = np.unique(np.array([w for held in words for w in held], dtype=object), return_inverse=True)
    digests = [hashlib.md5(w.encode("utf-8", "surrogatepass")).digest() for w in different]
    slot = np.array([d[7] % WIDTH for d in digests], np.int64)
    sign = np.array([1.0 if d[0] >> 7 else -1.0 for d in digests])
    out = np.zeros((len(texts), WIDTH))
    np.add.at(out, (text, slot[of_word]), sign[of_word])
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0).tolist()


def embedder(backend: Callable[[list[str]], list[list[float]]] = hashed_embedding, batch: int = config.EMBED_BATCH):
    """A column function text -> array<float>, called with at most ``batch`` texts."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            held = part.tolist()
            yield pd.Series([v for i in range(0, len(held), batch) for v in backend(held[i : i + batch])], index=part.index)

    return embed


def backfilled(questions: DataFrame, embed=None) -> DataFrame:
    """questions with the missing embeddings filled in; others aren't computed."""
    embed = embed or embedder()
    missing = questions.filter("embedding is null").withColumn("embedding", embed(F.col("original_text")))
    return questions.filter("embedding is not null").unionByName(missing)


def extractive_answer(context: Column) -> Column:
    """Offline generation: the context's first sentence; empty without context."""
    return F.coalesce(F.regexp_extract(context, r"(?:^|\n)([^\[\n][^.\n]*\.?)", 1), F.lit(""))


def overlap_judge(answer: Column, evidence: Column) -> Column:
    """Offline judge: 0 to 10 by the share of the answer's words in the evidence."""
    words = F.array_distinct(F.split(F.lower(answer), r"\W+"))
    shared = F.size(F.array_intersect(words, F.split(F.lower(evidence), r"\W+")))
    return F.round(10.0 * shared / F.greatest(F.size(words), F.lit(1))).cast("int")


def paraphrase(question: Column) -> Column:
    """Offline paraphrase: the words in reverse order."""
    return F.array_join(F.reverse(F.split(question, " ")), " ")
