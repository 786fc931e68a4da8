"""Held-out accuracy of the classifiers and the pipeline's stages on a small corpus."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lodestone.llm import quality, toxicity

PLAIN = [f"{a}{b}" for a in ("re", "ton", "li", "mar", "sha", "be") for b in ("na", "vor", "tis", "el", "und", "o")]
SIGNS = ["vileword", "foulword", "vilest"]


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(5, 80))]
        mark = i % 8 == 0
        if mark:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(SIGNS))
        texts.append(" ".join(words))
        marks.append(mark)
    return texts, np.array(marks)


def test_toxic_words_are_learned_from_positives_and_unlabelled():
    texts, marks = toxic_corpus(1600, 1)
    sets = list(toxicity.feature_sets(pa.array(texts)))
    model = toxicity.fit([s for s, m in zip(sets, marks, strict=True) if m], sets, 0.125)
    fresh, truth = toxic_corpus(400, 2)
    scores = model.scores(pa.array(fresh))
    assert scores[truth].min() > scores[~truth].max() and scores[~truth].max() < 0.1
    assert (scores[truth] >= 0.7).mean() > 0.8
    odd = model.scores(pa.array(["", None, "VILEWORD!", "plain"]))
    assert odd[0] == odd[1] == odd[3] < 0.5 < odd[2]


def test_nothing_to_learn_from():
    model = toxicity.fit([], [np.array([1], np.uint64)], 0.1)
    assert (model.scores(pa.array(["a", ""])) < 1e-9).all()
    assert quality.fit(pa.array([], pa.string()), np.empty(0)).scores(pa.array(["a"]))[0] == 0.5
    assert quality.fit(pa.array(["a", "b"]), np.ones(2)).scores(pa.array(["a"]))[0] == 1.0


def quality_corpus(n, seed):
    rng = random.Random(seed)
    texts, good = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(20, 80))]
        kind = i % 4
        if kind == 0:
            words = [words[0].capitalize()] * 60
        elif kind == 1 and i % 8 == 1:
            words = [w.upper() + "!!" for w in words]
        texts.append(" ".join(words) + ".")
        good.append(not (kind == 0 or (kind == 1 and i % 8 == 1)))
    return texts, np.array(good, float)


def test_quality_is_learned_and_calibrated():
    texts, good = quality_corpus(800, 3)
    model = quality.fit(pa.array(texts), good, steps=600)
    fresh, truth = quality_corpus(200, 4)
    scores = model.scores(pa.array(fresh))
    assert ((scores >= 0.3) == truth).mean() > 0.97
    assert 0 < model.temperature and ((scores >= 0) & (scores <= 1)).all()
    odd = model.scores(pa.array([None, "", texts[1], texts[1]]))
    assert odd[0] == odd[1] and odd[2] == odd[3]


def test_scores_of_tables(spark):
    texts, marks = toxic_corpus(200, 5)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, None, 2.0), (0, texts[0], 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "score"] and got.count() == 202
    assert toxicity.score(docs.limit(0), model).count() == 0
    good = quality.train(docs, labels.withColumnRenamed("toxic", "quality"))
    kept = quality.keep(docs, good, 0.0)
    assert kept.columns == docs.columns and kept.count() == 202 and quality.keep(docs.limit(0), good).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
        n.append(docs.count())
    assert n[0] >= n[1] == n[2] >= n[3] >= n[4] > 20
    layout = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in layout.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
