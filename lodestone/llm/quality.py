"""Quality scores from pooled random-indexing vectors and a two-layer network.

Each word has two units, its own spelling and its shape (runs of capitals, small letters
and digits, the marks themselves, and whether it repeats one of the two words before).
Units fall into slots; a slot has a fixed random index vector and a context vector, the
sum of the index vectors of the slots met within two words in the training sample. A text
is the mean of its units' context vectors and two plain numbers, how concentrated its
words are and how many there are. A network of two layers, in numpy, scores that, and a
temperature fitted on training rows it hasn't learned from calibrates the probability.

Training takes at most ``most`` labelled rows, the ones with the least hash; vectors and
network go to the tasks, and every text is scored whole where it lies.

Defined results: a null or empty text is pooled from no unit and scores like any other.
Rows repeated in full score alike. Without labels of both kinds all scores are the share
of good rows (0.5 without any). An empty table gives no rows; other columns are kept by
``keep`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bytescan, training

SLOT_BITS = 11
SLOTS = 1 << SLOT_BITS
WIDTH = 48
HIDDEN = 24
SCORES = "doc_id long, score double"

_class = np.arange(256, dtype=np.uint8)
_class[65:91], _class[97:123], _class[48:58], _class[128:] = 65, 97, 48, 97


def _units(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word slot, shape slot) of every word of a batch."""
    names, bounds, starts, ends = bytescan.words(body, offsets, fold=False)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    classes = _class[body]
    keep = np.ones(len(body), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    sums, (_, down) = bytescan.prefix_sums(classes[keep]), bytescan.powers(len(body) + 1)
    a, z = place[starts], place[ends]
    shapes = (sums[z] - sums[a]) * down[a]
    same = np.zeros(len(names), np.uint64)
    for d in (2, 1):
        again = (names[d:] == names[:-d]) & (text[d:] == text[:-d])
        same[d:][again] = d
    top = np.uint64(64 - SLOT_BITS)
    return text, (names >> top).astype(np.int64), (bytescan.mix(shapes + same * np.uint64(0x9E3779B97F4A7C15)) >> top).astype(np.int64)


def index_vectors(seed: int) -> np.ndarray:
    """Sparse random vectors of 1 and -1, eight entries a slot."""
    rng = np.random.default_rng(seed)
    out = np.zeros((SLOTS, WIDTH), np.float32)
    for row in out:
        row[rng.choice(WIDTH, 8, replace=False)] = rng.choice([-1.0, 1.0], 8)
    return out


def _met(slots: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often slot i has slot j within two words of it."""
    met = np.zeros(SLOTS * SLOTS, np.float32)
    for d in (1, 2):
        inside = text[d:] == text[:-d]
        a, b = slots[:-d][inside], slots[d:][inside]
        for pair in (a * SLOTS + b, b * SLOTS + a):
            at, n = np.unique(pair, return_counts=True)
            met[at] += n
    return met.reshape(SLOTS, SLOTS)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    body, offsets = bytescan.buffers(texts)
    for i, j in bytescan.pieces(offsets):
        part = offsets[i : j + 1]
        yield i, j, _units(body[part[0] : part[-1]], part - part[0])


@dataclass
class Model:
    vectors: tuple[np.ndarray, np.ndarray]  # of words and of shapes
    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def pooled(self, texts: pa.Array) -> np.ndarray:
        return pooled(texts, self.vectors)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (self.pooled(texts) - self.center) / self.scale
        return training.sigmoid(_forward(x, self.layers)[1] / self.temperature)


def pooled(texts: pa.Array, vectors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of 2 * WIDTH + 2 numbers for each text."""
    out = np.zeros((len(texts), 2 * WIDTH + 2))
    for i, j, (text, *slots) in _chunks(texts):
        n = np.maximum(np.bincount(text, minlength=j - i), 1)[:, None]
        for k, (own, held) in enumerate(zip(slots, vectors, strict=True)):
            counts = np.bincount(text * SLOTS + own, minlength=(j - i) * SLOTS).reshape(j - i, SLOTS).astype(np.float32)
            out[i:j, k * WIDTH : (k + 1) * WIDTH] = counts @ held / n
            if k == 0:
                out[i:j, -2] = np.log((counts.astype(np.float64) ** 2).sum(1) / n[:, 0] ** 2 + 1e-4)
        out[i:j, -1] = np.log(n[:, 0])
    return out


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def fit(texts: pa.Array, good: np.ndarray, steps: int = 1500, seed: int = 11) -> Model:
    if not len(good) or good.min() == good.max():
        return Model((np.zeros((SLOTS, WIDTH), np.float32),) * 2, np.zeros(1), np.ones(1), [], 1.0, float(good.mean()) if len(good) else 0.5)
    met = [np.zeros((SLOTS, SLOTS), np.float32) for _ in range(2)]
    for _, _, (text, *slots) in _chunks(texts):
        for total, own in zip(met, slots, strict=True):
            total += _met(own, text)
    vectors = []
    for k, total in enumerate(met):
        own = index_vectors(seed + k)
        context = total @ own / np.maximum(total.sum(1, keepdims=True), 1)
        vectors.append((own / np.sqrt(8) + context).astype(np.float32))
    del met
    x = pooled(texts, (vectors[0], vectors[1]))
    center, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - center) / scale
    rng = np.random.default_rng(seed)
    held = rng.random(len(good)) < 0.2
    if good[held].min(initial=1) == good[held].max(initial=0) or good[~held].min() == good[~held].max():
        held[:] = False
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    adam = training.Adam(layers, 0.003)
    own_x, own_y = x[~held], good[~held]
    for _ in range(steps):
        rows = rng.integers(0, len(own_y), 512)
        bx, by = own_x[rows], own_y[rows]
        hidden, raw = _forward(bx, layers)
        slope = (training.sigmoid(raw) - by) / len(rows)
        back = np.outer(slope, layers[2]) * (1 - hidden**2)
        adam.move([bx.T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ slope + 1e-4 * layers[2], np.array([slope.sum()])])
    check = held if held.any() else ~held
    raw = _forward(x[check], layers)[1]
    heats = np.exp(np.linspace(-1.5, 2, 71))
    loss = [np.logaddexp(0, -np.where(good[check] == 1, raw, -raw) / t).mean() for t in heats]
    return Model((vectors[0], vectors[1]), center, scale, layers, float(heats[int(np.argmin(loss))]))


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> Model:
    """labels (doc_id, quality) are the rows to learn from."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    got = training.sampled(docs, known, most)
    return fit(got["text"].combine_chunks(), got["quality"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(batch.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)


def keep(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs that score ``least`` or more, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(batch.column(at)) >= least))

    return docs.mapInArrow(run, docs.schema)
