"""Every registered query of the engine against its DuckDB twin."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the plans
from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list) else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_equal_the_twin(spark, duck, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    twin = duck.sql(catalog.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(twin.columns)
    at = [twin.columns.index(c) for c in columns]
    assert ordered([[r[c] for c in columns] for r in frame.collect()]) == ordered([[r[i] for i in at] for r in twin.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_a_twin_have_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_chunks_are_small_and_lose_no_letter(spark, sf_dir):
    from pyspark.sql import functions as F

    from lodestone.functions import text

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.chunks(F.col("text")).alias("c"))
    for r in docs.collect():
        assert all(len(c) <= 1024 for c in r.c)
        assert "".join("".join(r.c).split()).replace(".", "") == "".join(r.text.split()).replace(".", "")
