"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import importlib

import corpus_pipeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _name in (
    "q01_decontamination",
    "q02_line_dedup",
    "q03_warc",
    "q04_media",
    "q05_ngram_join",
    "q06_toxicity",
    "q07_quality",
    "q08_suffix_dedup",
    "q09_sharding",
    "q10_packing",
    "q11_filter_audit",
    "q12_embedding_near_dedup",
    "q13_fill_in_middle",
):
    _module = importlib.import_module(f"lodestone.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
