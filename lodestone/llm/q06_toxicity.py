"""op6: the toxicity score of every document; every third fold of ids is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import shared, toxicity, training

FOLDS, HELD_OUT, LEAST = 3, 1, 0.7


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    fold = training.fold_of("doc_id", FOLDS)
    model = toxicity.train(docs.filter(fold != HELD_OUT), labels.filter(fold != HELD_OUT))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold == HELD_OUT).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
