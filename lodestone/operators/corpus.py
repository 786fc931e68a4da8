"""Documents to chunk rows, and what a corpus holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import text


def chunk_rows(documents: DataFrame, size: int = config.CHUNK_SIZE) -> DataFrame:
    """(source, corpus, category, language, chunk_index, content, lexemes) of documents."""
    rows = documents.select("source", "corpus", "category", "language", F.posexplode(text.chunks(F.col("text"), size)).alias("chunk_index", "content"))
    return rows.withColumn("lexemes", text.placed_lexemes(F.col("content"), text.search_configuration(F.coalesce("language", F.lit("")))))


def committed(chunks: DataFrame, path: str, size: int = config.COMMIT_SIZE) -> DataFrame:
    """Write chunks in files of at most ``size`` rows, and give them back from there. A
    task keeps one file's rows in memory, and what a lost task has written is left out."""
    chunks.write.option("maxRecordsPerFile", size).parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)


def truncate(spark: SparkSession, path: str) -> None:
    """Leave an empty table of the same schema."""
    held = spark.read.parquet(path)
    spark.createDataFrame([], held.schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def category_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per category; order by ``labels`` for the order of a path tree."""
    return chunks.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("labels", F.split("category", r"\."))


def top_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(text.top_category(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def source_counts(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every source with its number of chunks, 0 if it has none."""
    n = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sources.join(n, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
