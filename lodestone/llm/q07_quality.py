"""op7: the quality score of every document; every fifth fold of ids is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import quality, shared, training

FOLDS, HELD_OUT, LEAST = 5, 0, 0.3


def model_of(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Trained on the rows outside the held-out fold."""
    fold = training.fold_of("doc_id", FOLDS)
    return quality.train(docs, labels.filter(fold != HELD_OUT))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    scored = quality.score(docs, model_of(docs, labels))
    fold = training.fold_of("doc_id", FOLDS)
    return scored.select("doc_id", (fold == HELD_OUT).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
