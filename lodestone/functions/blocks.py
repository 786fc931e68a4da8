"""Distances of a stated set of queries to all vectors of a table, a block at a time."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block: their matrix goes to every task (2 MB at 64 components). So many
#: rows meet them at once (32 MB of distances).
BLOCK, ROWS = 4096, 1024


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class _Best:
    """The k nearest rows so far of each query of a block; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, most: float, digits: int):
        self.k, self.most, self.digits = k, most, digits
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.distance = np.full((queries, k), np.inf)
        self.held = np.zeros(queries, np.int64)

    def add(self, asked: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        """Distances, not rounded yet, of the queries ``asked`` (a row each) to rows."""
        slack = 2 * 10.0**-self.digits  # what rounding can make equal
        limit = np.minimum(self.distance[asked, -1], self.most)
        near = distance <= limit[:, None] + slack
        if len(ids) > self.k and np.count_nonzero(near) > 4 * self.k * len(asked):
            limit = np.minimum(limit, np.partition(distance, self.k - 1, axis=1)[:, self.k - 1])
            near = distance <= limit[:, None] + slack
        query, row = np.nonzero(near)
        rounded = np.round(distance[query, row], self.digits) + 0.0
        fits = rounded <= self.most
        query, row, rounded = query[fits], row[fits], rounded[fits]
        if not len(query):
            return
        touched, more = np.unique(query, return_counts=True)
        own = asked[touched]
        query = np.concatenate([query, np.repeat(touched, self.k)])
        name = np.concatenate([ids[row], self.ids[own].ravel()])
        far = np.concatenate([rounded, self.distance[own].ravel()])
        order = np.lexsort((name, far, query))
        starts = np.concatenate([[0], np.cumsum(more + self.k)[:-1]])
        kept = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.ids[own], self.distance[own] = name[kept].reshape(-1, self.k), far[kept].reshape(-1, self.k)
        self.held[own] = np.minimum(self.k, self.held[own] + more)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(np.arange(self.k) < self.held[:, None])
        return query, self.ids[query, place], self.distance[query, place]


def _pieces(cells: np.ndarray | None, rows: int) -> Iterator[slice]:
    """Slices of so many rows, ROWS at most, each of one cell."""
    ends = np.arange(0, rows, ROWS)
    if cells is not None:
        ends = np.union1d(ends, np.flatnonzero(cells[1:] != cells[:-1]) + 1)
    yield from itertools.starmap(slice, itertools.pairwise([*ends.tolist(), rows]))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, most: float = float("inf"), digits: int = 9, reading: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, vector_distance, vector_rank): for each of the queries (query_id,
    query_embedding) the k nearest rows of ``vectors`` (id, embedding) by cosine distance,
    none beyond ``most``. Vectors are compared in Arrow batches by matrix products, a task
    keeps k rows a query, and these are merged. Null vectors are left out.

    With ``reading`` vectors have a ``cell`` too, and a query meets those of some cells
    only: for a block of queries of length 1 it gives a row a cell, true for the queries
    that read it."""
    spark = vectors.sparkSession
    held = vectors.filter(F.col("embedding").isNotNull()).select("id", "embedding", *(["cell"] if reading else []))
    rows = queries.filter(F.col("query_embedding").isNotNull()).select("query_id", "query_embedding").toLocalIterator()
    parts = []
    while block := list(itertools.islice(rows, BLOCK)):
        names = np.array([r.query_id for r in block], dtype=np.int64)
        asked = np.array([r.query_embedding for r in block], dtype=np.float64)
        asked /= np.linalg.norm(asked, axis=1, keepdims=True)
        read = np.packbits(reading(asked), axis=1) if reading else None

        def compared(batches: Iterator[pa.RecordBatch], names=names, asked=asked, read=read) -> Iterator[pa.RecordBatch]:
            best, every = _Best(len(names), k, most, digits), np.arange(len(names))
            for batch in batches:
                ids, v = batch.column("id").to_numpy(), matrix(batch.column("embedding"), asked.shape[1])
                with np.errstate(invalid="ignore", divide="ignore"):  # a vector without a direction is near nothing
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                cells = None if read is None else batch.column("cell").to_numpy()
                for piece in _pieces(cells, batch.num_rows):
                    some = every if cells is None else np.flatnonzero(np.unpackbits(read[cells[piece.start]], count=len(names)))
                    if len(some):
                        best.add(some, ids[piece], 1 - asked[some] @ v[piece].T)
            query, found, distance = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[query], found, distance)], names=["query_id", "id", "vector_distance"])

        parts.append(held.mapInArrow(compared, "query_id long, id long, vector_distance double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, vector_distance double, vector_rank int")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("vector_distance", "id"))
    return every.withColumn("vector_rank", place).filter(F.col("vector_rank") <= k)
