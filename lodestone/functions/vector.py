"""Vector expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def literal(values) -> Column:
    """A vector as one literal."""
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_distance(a: Column, b: Column, digits: int = 9) -> Column:
    """1 - cosine similarity, rounded, never -0.0; null where either is null."""
    return F.round(1 - dot(a, b) / (norm(a) * norm(b)), digits) + F.lit(0.0)


def distance_to(a: Column, query, digits: int = 9, length: Column | None = None) -> Column:
    """cosine_distance() to a constant vector, whose norm is computed here once; ``length``
    is the norm of ``a`` where it is stored."""
    own = math.sqrt(sum(float(v) ** 2 for v in query))
    return F.round(1 - dot(a, literal(query)) / ((norm(a) if length is None else length) * F.lit(own)), digits) + F.lit(0.0)


def rrf(rank: Column, k: int = 60) -> Column:
    """1 / (k + rank), 0 where the rank is null."""
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank), F.lit(0.0))
