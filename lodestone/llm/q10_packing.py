"""op10: every document packed into sequences of 1024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import packing, shared


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_path(), end_id=2, max_tokens=1024)


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
