"""op8: every byte covered by a 100-byte string that also starts earlier, removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import shared, suffixes


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(shared.table(spark, sf_dir, "documents"), length=100)


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
