"""What the operators share: table reading, the shared folder, written cuts of lineage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir. A
    session on a cluster that has it unset is refused."""
    return storage.shared_dir(spark)


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: its lineage ends
    there, so a lost executor costs a reread and not a recomputation. The shuffle
    files of what was written are released at once."""
    spark, schema = df.sparkSession, df.schema
    path = fresh(spark, what)
    df.write.parquet(path)
    del df  # else its own shuffle files would outlive the release
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a cut that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as scanned: one task per file split, no shuffle."""
    return table(spark, sf_dir, name)


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))
