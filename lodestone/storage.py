"""The folder that the driver and all executors share, and tables written into it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session whose driver and executors are one process.
ONE_MACHINE = "file:///tmp/checkpoints"

_written: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else ""
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a shared folder")
        where = ONE_MACHINE
    return where.rstrip("/") if ":" in where else f"file://{os.path.abspath(where)}"


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The path of what ``write`` has put into the shared folder; an application writes
    each name once."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _written:
        path = fresh(spark, "index")
        write(path)
        _written[key] = path
    return _written[key]


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _file_system(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    system, at = _file_system(spark, path)
    return [str(s.getPath()) for s in system.listStatus(at)] if system.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file; empty if it isn't there."""
    if not exists(spark, path):
        return ""
    return spark.read.text(path, wholetext=True).first()[0]


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside the old one and move it into place."""
    system, at = _file_system(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = options
    context.rename(aside, at, kinds)


def partition_of(spark: SparkSession, path: str, column: str, value: str) -> str:
    """The folder of one partition of a written table; empty if it has no rows."""
    escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
    at = f"{path}/{column}={escaped}"
    return at if exists(spark, at) else ""
