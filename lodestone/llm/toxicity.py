"""Toxicity scores learned from confirmed toxic and unlabelled text.

The classifier never sees a clean label. Its risk is the non-negative estimate for
positive and unlabelled samples: with the share p of toxic text, p times the loss of the
toxic sample taken as toxic, plus what the unlabelled sample loses taken as clean less p
times what the toxic sample loses taken as clean; that second part is held at zero where
it would fall below.

A text is the set of its words and word beginnings (4 to 6 bytes), with ASCII case
folded and ASCII marks parting words. Of these the model keeps the ones that are much
more frequent in toxic than in unlabelled text, and learns a weight for each.

Training takes at most ``most_toxic`` and ``most_unlabelled`` rows, the ones with the
least hash; the weights go to the tasks and every text is scored whole where it lies.

Defined results: a null or empty text, or one without a kept feature, has the score of
the bias alone. Rows repeated in full score alike. Without a toxic example all scores
are 0. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bytescan, training

BEGINNINGS = (4, 5, 6)
SCORES = "doc_id long, score double"


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of every word and word beginning of a batch."""
    names, bounds, starts, ends = bytescan.words(body, offsets, marks=True)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    sums, (_, down) = bytescan.prefix_sums(body, bytescan._folded), bytescan.powers(len(body) + 1)
    texts, found = [text], [names]
    for n in BEGINNINGS:
        long = ends - starts > n
        a = starts[long]
        texts.append(text[long])
        found.append(bytescan.mix((sums[a + n] - sums[a]) * down[a] + np.uint64(n)))
    return np.concatenate(texts), np.concatenate(found)


def feature_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    body, offsets = bytescan.buffers(texts)
    for i, j in bytescan.pieces(offsets):
        part = offsets[i : j + 1]
        text, name = features(body[part[0] : part[-1]], part - part[0])
        order = np.argsort(text, kind="stable")
        ends = np.searchsorted(text[order], np.arange(j - i + 1))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield np.unique(name[order[a:b]])


@dataclass
class Model:
    keys: np.ndarray  # sorted feature names
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        body, offsets = bytescan.buffers(texts)
        table = np.zeros(1 << 20, bool)
        table[self.keys >> np.uint64(44)] = True
        out = np.full(len(offsets) - 1, self.bias)
        for i, j in bytescan.pieces(offsets):
            part = offsets[i : j + 1]
            text, name = features(body[part[0] : part[-1]], part - part[0])
            hit = np.flatnonzero(table[name >> np.uint64(44)])
            at = np.searchsorted(self.keys, name[hit])
            same = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == name[hit]) if len(self.keys) else np.zeros(len(hit), bool)
            pairs = np.unique(text[hit[same]] * max(1, len(self.keys)) + at[same])
            np.add.at(out, i + pairs // max(1, len(self.keys)), self.weights[pairs % max(1, len(self.keys))])
        return training.sigmoid(out)


def distinct(sets: list[np.ndarray]) -> list[np.ndarray]:
    """One set of each group of near copies, told by six least hashes: else the words of
    a text with many copies would pass for signs."""
    first = {}
    for own in sets:
        if len(own):
            first.setdefault(tuple(int(bytescan.mix(own ^ np.uint64(j)).min()) for j in range(6)), own)
    return list(first.values())


def _matrix(sets: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(keys)), np.float32)
    for row, own in zip(out, sets, strict=True):
        row[np.isin(keys, own)] = 1
    return out


def _rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the share of each."""
    rows, n = np.unique(matrix, axis=0, return_counts=True)
    return rows, n / max(1, len(matrix))


def ratio_of(other: np.ndarray, own: np.ndarray) -> float:
    return float(other.sum() / max(1, own.sum()))


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, kept: int = 512, steps: int = 3000) -> Model:
    """Non-negative positive-unlabelled training on feature sets."""
    toxic, unlabelled = distinct(toxic), distinct(unlabelled)
    if not toxic or not unlabelled:
        return Model(np.empty(0, np.uint64), np.empty(0), -40.0)
    names, counts = np.unique(np.concatenate(toxic), return_counts=True)
    other, others = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(other, names), len(other) - 1)
    beside = np.where(other[at] == names, others[at], 0)
    # toxic text is in the unlabelled sample too: without its share, what is left there
    # says how many toxic texts would have the feature by chance
    ratio = len(toxic) / len(unlabelled)
    chance = np.maximum(beside - prior * counts / ratio, 0) * ratio
    sure = counts - chance - 4 * np.sqrt(chance) - max(4, len(toxic) // 200)
    best = np.argsort(-sure, kind="stable")[:kept]
    best = best[(sure[best] >= 0) & (counts[best] >= 2 * chance[best])]
    sign = best[: max(1, len(best) // 10)]  # the share of text with a sure sign bounds the prior
    if len(sign):
        prior = min(prior, ratio * ratio_of(beside[sign], counts[sign]))
    prior *= 0.95
    keys = np.sort(names[best])
    (x_toxic, n_toxic), (x_other, n_other) = (_rows(_matrix(s, keys)) for s in (toxic, unlabelled))
    w, b = np.zeros(len(keys)), np.array([np.log(prior / (1 - prior))])
    adam = training.Adam([w, b], 0.03)
    for _ in range(steps):
        p_toxic, p_other = training.sigmoid(x_toxic @ w + b), training.sigmoid(x_other @ w + b)
        as_clean = -n_other @ np.log(1 - p_other + 1e-12) + prior * (n_toxic @ np.log(1 - p_toxic + 1e-12))
        slope = [-prior * n_toxic * (1 - p_toxic), np.zeros(len(n_other))]
        if as_clean > 0:  # else the second part is held at zero and has no slope
            slope = [slope[0] - prior * n_toxic * p_toxic, n_other * p_other]
        adam.move([slope[0] @ x_toxic + slope[1] @ x_other + 2e-5 * w, (slope[0].sum() + slope[1].sum()).reshape(1)])
        np.maximum(w, 0, out=w)  # kept features are signs of toxic text only
    return Model(keys, w, float(b[0]))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 6000, most_unlabelled: int = 12_000) -> Model:
    """labels (doc_id, toxic) are the rows to learn from; clean ones count only for the
    share of toxic text."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    toxic = training.sampled(docs, known.filter("toxic = 1").select("doc_id"), most_toxic)
    other = training.sampled(docs, docs.select("doc_id"), most_unlabelled)
    sets = [list(feature_sets(t["text"])) for t in (toxic, other)]
    return fit(*sets, prior=min(max(share, 0.001), 0.9))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(batch.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)
