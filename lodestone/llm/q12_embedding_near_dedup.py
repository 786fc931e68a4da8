"""op12: near-duplicate vectors of each label by sharded small-world graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import shared, vectordedup


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectordedup.dedup(shared.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", threshold=0.93, recall=0.95)
    return found.select("vec_id", "n_links", "component_id", "kept", "audit_beam", "audit_recall")


QUERIES = {"op12_embedding_near_dedup": op12_embedding_near_dedup}
