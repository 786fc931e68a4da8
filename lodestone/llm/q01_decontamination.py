"""op1: the benchmark items that documents hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, shared


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark")
    return decontamination.find(docs, benchmark, seed=5, least=3, coverage=0.8).withColumn("coverage", F.round("coverage", 6))


QUERIES = {"op1_decontamination": op1_decontamination}
