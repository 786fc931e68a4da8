"""Connected components of an edge table, by alternating stars.

Each round replaces a node's edges by edges to the least of its neighbours, first for
its larger neighbours and then for its smaller ones, until every component is a star
around its least node. Minima are partial aggregates, so a node with very many edges is
no hot task there; the joins back are plain equi joins that adaptive execution splits.
Edges stay in tables throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least.hint("merge"), "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its least node."""
    found = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    found = shared.cut(found, "edges")
    mark = _mark(found)
    while mark[0]:
        before, found = found, shared.cut(_small_star(_large_star(found)), "edges")
        shared.discard(before)
        now = _mark(found)
        if now == mark:
            break
        mark = now
    roots = found.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return found.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
