"""op4: every document stored as a media payload, read back and described."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import media, shared


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(shared.table(spark, sf_dir, "documents"))
    places = media.directory(stored).repartition("shard")
    found = media.decode(media.headers(places))
    return stored.select("doc_id", "n_bytes", "digest").join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


QUERIES = {"op4_media_columns": op4_media_columns}
