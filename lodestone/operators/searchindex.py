"""The search index as four tables that every search reads a small part of.

* ``nodes`` (category, pre, last): the tree of category paths, numbered in pre-order. A
  subtree is the range pre to last.
* ``chunks``: the chunk rows with ``place``, their category's number, and ``inverted``,
  their lexemes with places, in files sorted by place; a category filter is a range that
  skips files and row groups.
* ``postings`` (lexeme, id, source, place, places): the inverted index, range-partitioned
  and sorted by lexeme, so that a search reads the row groups of its own lexemes. A very
  frequent lexeme spans many files, by id.
* ``vectors`` (cell, id, source, place, norm, embedding): the vectors by cell of a k-means
  partition trained on a bounded share of them. ``cells`` holds the centroids and how far
  from them a cell reaches; a search probes the nearest cells, or all that can hold a
  vector within its threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions import blocks, stemming, text, vector

#: Vectors that cells are trained on at most, rounds of training, most cells.
TRAINED, ROUNDS, MOST_CELLS = 100_000, 6, 4096
#: Category ranges that go into a filter; more are a join.
MOST_RANGES = 500


@dataclass(frozen=True)
class SearchIndex:
    """The tables of an index, and what of them is small by a bound: the centroids."""

    nodes: DataFrame
    chunks: DataFrame
    postings: DataFrame
    vectors: DataFrame
    centroids: np.ndarray
    reach: np.ndarray

    def in_category(self, rows: DataFrame, category: str) -> DataFrame:
        """rows (with ``place``) below any node whose path ends with the labels."""
        found = subtrees(self.nodes, category)
        ranges = merged_ranges(found.select("pre", "last").limit(MOST_RANGES + 1).collect())
        if ranges is None:
            inside = self.nodes.alias("n").join(found.select(F.col("pre").alias("a"), F.col("last").alias("z")), F.col("pre").between(F.col("a"), F.col("z")), "left_semi")
            return rows.join(inside.select(F.col("pre").alias("place")), "place", "left_semi")
        within: Column = F.lit(False)
        for a, z in ranges:
            within = within | F.col("place").between(a, z)
        return rows.filter(within)

    def probed(self, query, probes: int | None, most: float = 2.0) -> list[int]:
        """The cells to read for a query: the ``probes`` nearest, or without a number all
        that may hold a vector within distance ``most``."""
        if not len(self.centroids):
            return []
        q = np.asarray(query, float)
        angle = np.arccos(np.clip(self.centroids @ (q / np.linalg.norm(q)), -1, 1))
        if probes is not None:
            return np.argsort(angle, kind="stable")[:probes].tolist()
        bound = math.acos(max(-1.0, 1 - most)) + 1e-6
        return np.flatnonzero(angle - self.reach <= bound).tolist()


# ---- categories -------------------------------------------------------------------


def category_nodes(categories: DataFrame) -> DataFrame:
    """(category, pre, last) of all paths in a column ``category`` and their ancestors.
    Numbers are given by sorted range partitions: each counts its own and adds what the
    partitions before it hold."""
    labels = F.split("category", r"\.")
    paths = categories.filter("category is not null").select(labels.alias("labels")).distinct()
    every = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.slice("labels", 1, n))).alias("labels")).distinct()
    ranged = storage.cut(every.repartitionByRange("labels").withColumn("part", F.spark_partition_id()), "paths")
    sizes = {r.part: r["count"] for r in ranged.groupBy("part").count().collect()}
    before, starts = 0, [F.lit(-1), F.lit(0).cast("long")]
    for part in sorted(sizes):  # one entry a partition
        starts += [F.lit(part), F.lit(before).cast("long")]
        before += sizes[part]
    start = F.element_at(F.create_map(*starts), F.col("part"))
    numbered = ranged.select("labels", (start + F.row_number().over(Window.partitionBy("part").orderBy("labels"))).alias("pre"))
    ancestors = numbered.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.slice("labels", 1, n))).alias("labels"), "pre")
    last = ancestors.groupBy("labels").agg(F.max("pre").alias("last"))
    return numbered.join(last, "labels").select(F.array_join("labels", ".").alias("category"), "pre", "last")


def subtrees(nodes: DataFrame, category: str) -> DataFrame:
    """The nodes whose path ends with the labels of ``category``."""
    return nodes.filter(F.concat(F.lit("."), "category").endswith(f".{category}"))


def merged_ranges(rows) -> list[tuple[int, int]] | None:
    """Disjoint ranges in order; None if there are too many."""
    if len(rows) > MOST_RANGES:
        return None
    out: list[tuple[int, int]] = []
    for a, z in sorted((r.pre, r.last) for r in rows):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


# ---- vectors ----------------------------------------------------------------------


def _nearest_cell(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sims = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ centroids.T
    best = sims.argmax(axis=1)
    return best, sims[np.arange(len(v)), best]


def train_cells(vectors: DataFrame, cells: int | None = None, rounds: int = ROUNDS, most: int = TRAINED) -> np.ndarray:
    """Unit centroids of a spherical k-means over (id, embedding). About the square root
    of the rows are cells unless told; the rows whose id has the least hash are trained
    on, and the first centroids are those with the very least. Each round sums the rows of
    a cell in tasks and brings one row a cell to the driver."""
    n = vectors.count()
    if not n:
        return np.zeros((0, 0))
    k = min(n, cells or max(1, min(MOST_CELLS, round(math.sqrt(n)))))
    order = F.xxhash64("id")
    first = vectors.orderBy(order, "id").limit(k).select("embedding").collect()
    width = len(first[0].embedding)
    centroids = np.array([r.embedding for r in first], float)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    share = min(1.0, most / n)
    sampled = vectors.filter(F.pmod(order, F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("embedding")
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(centroids)
            for batch in batches:
                if batch.num_rows:
                    v = blocks.matrix(batch.column(0), width)
                    np.add.at(total, _nearest_cell(v, centroids)[0], v / np.linalg.norm(v, axis=1, keepdims=True))
            cell, dim = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(dim), pa.array(total[cell, dim])], names=["cell", "dim", "value"])

        rows = sampled.mapInArrow(sums, "cell long, dim long, value double").groupBy("cell", "dim").agg(F.sum("value").alias("value")).toArrow()
        moved = np.zeros_like(centroids)
        moved[rows["cell"].to_numpy(), rows["dim"].to_numpy()] = rows["value"].to_numpy()
        size = np.linalg.norm(moved, axis=1, keepdims=True)
        centroids = np.where(size > 0, moved / np.where(size > 0, size, 1), centroids)
    return centroids


def in_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with ``cell`` and ``similarity`` to its centroid."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, sim = _nearest_cell(blocks.matrix(batch.column("embedding"), centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(sim)], names=[*batch.schema.names, "cell", "similarity"])

    return vectors.mapInArrow(placed, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in vectors.schema)}, cell int, similarity double")


# ---- the index --------------------------------------------------------------------


def build(chunks: DataFrame, path: str, cells: int | None = None) -> None:
    """Write the index of chunks (id, source, content, embedding, category, language,
    chunk_index; a null embedding is in no cell) under ``path``."""
    spark = chunks.sparkSession
    category_nodes(chunks.select("category")).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    placed = chunks.drop("place").join(nodes.select("category", F.col("pre").alias("place")), "category", "left")
    configuration = text.search_configuration(F.coalesce("language", F.lit("")))
    sorted_ = placed.repartitionByRange("place", "id").sortWithinPartitions("place", "id")
    sorted_.withColumn("inverted", stemming.placed_postings(text.words(F.col("content")), configuration)).write.parquet(f"{path}/chunks")
    held = spark.read.parquet(f"{path}/chunks")
    postings = held.select("id", "source", "place", F.explode("inverted").alias("p"))
    postings.select("p.lexeme", "id", "source", "place", "p.places").repartitionByRange("lexeme", "id").sortWithinPartitions("lexeme", "id").write.parquet(f"{path}/postings")
    vectors = held.filter("embedding is not null").select("id", "source", "place", "embedding")
    centroids = train_cells(vectors, cells)
    if len(centroids):
        celled = in_cells(vectors, centroids).withColumn("norm", vector.norm(F.col("embedding")))
    else:
        celled = vectors.limit(0).selectExpr("*", "0 AS cell", "0D AS similarity", "0D AS norm")
    celled.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/vectors")
    found = spark.read.schema(celled.schema).parquet(f"{path}/vectors")
    reach = {r.cell: r.least for r in found.groupBy("cell").agg(F.min("similarity").alias("least")).collect()}
    rows = [(i, float(math.acos(max(-1.0, min(1.0, reach.get(i, 1.0))))), c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, reach double, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")


def load(spark: SparkSession, path: str) -> SearchIndex:
    cells = spark.read.schema("cell int, reach double, centroid array<double>").parquet(f"{path}/cells").toArrow().sort_by("cell")
    centroids = cells["centroid"].combine_chunks()
    schema = "id long, source string, place long, embedding array<float>, similarity double, norm double, cell int"
    return SearchIndex(
        *[spark.read.parquet(f"{path}/{name}") for name in ("nodes", "chunks", "postings")],
        spark.read.schema(schema).parquet(f"{path}/vectors"),
        blocks.matrix(centroids, len(centroids[0]) if cells.num_rows else 1),
        cells["reach"].to_numpy(),
    )


def _cells_by_nearness(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cells of each vector from the nearest on, a row a vector."""
    return np.argsort(-(v @ centroids.T), axis=1, kind="stable")


def cell_ranks(index: SearchIndex, queries: DataFrame, k: int) -> DataFrame:
    """(rank, n): how many of the k true nearest vectors of the queries lie in the cell
    that is the rank-th nearest to their query, from 1. One exact scan."""
    centroids = index.centroids
    true = blocks.nearest(index.vectors, queries, k).select("query_id", "id").join(index.vectors.select("id", "cell"), "id")
    held = true.groupBy("query_id").agg(F.collect_list("cell").alias("cells"))  # k a query
    asked = held.join(queries.select("query_id", "query_embedding"), "query_id").select("query_embedding", "cells")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, blocks.ROWS) for i in range(0, batch.num_rows, blocks.ROWS)):
                order = _cells_by_nearness(blocks.matrix(some.column("query_embedding"), centroids.shape[1]), centroids)
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(1, order.shape[1] + 1)[None, :], 1)
                cells = some.column("cells")
                query = np.repeat(np.arange(some.num_rows), cells.value_lengths().to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(rank[query, cells.flatten().to_numpy()].astype(np.int32))], names=["rank"])

    return asked.mapInArrow(ranked, "rank int").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def calibrated(index: SearchIndex, queries: DataFrame, k: int, target: float = 0.95) -> tuple[int, float]:
    """The least number of probes whose recall of the queries' k nearest vectors against
    the exact scan reaches the target, and that recall."""
    ranks = sorted((r["rank"], r.n) for r in cell_ranks(index, queries, k).collect())  # a row a cell at most
    every, found = sum(n for _, n in ranks), 0
    for rank, n in ranks:
        found += n
        if found >= target * every:
            return rank, found / every
    return max(1, len(index.centroids)), 1.0


def probed_nearest(index: SearchIndex, queries: DataFrame, k: int, probes: int, most: float = 2.0) -> DataFrame:
    """blocks.nearest() where each query reads its ``probes`` nearest cells."""
    centroids = index.centroids

    def reading(asked: np.ndarray) -> np.ndarray:
        read = np.zeros((len(centroids), len(asked)), bool)
        for i in range(0, len(asked), blocks.ROWS):
            cells = _cells_by_nearness(asked[i : i + blocks.ROWS], centroids)[:, :probes]
            read[cells, np.arange(i, i + len(cells))[:, None]] = True
        return read

    return blocks.nearest(index.vectors, queries, k, most, reading=reading if len(centroids) else None)
