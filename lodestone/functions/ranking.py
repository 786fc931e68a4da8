"""The rank of full-text matches from the places of their lexemes.

One lexeme: the sum of 1 / j^2 over its j places, by the limit of that sum. Several: 1
less the product of (1 - r) over all pairs of places of two different lexemes, where r
falls with their distance and is next to nothing beyond 100 places. Every place has the
weight of an unlabelled text, 0.1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published rank formula.
WEIGHT = 0.1
FARTHEST = 100
LIMIT = 1.64493406685

#: What a rank can be divided by, as bits of one number.
LOG_LENGTH, LENGTH, DISTINCT, LOG_DISTINCT, SQUASHED = 1, 2, 8, 16, 32


def _pair(distance: Column) -> Column:
    """r of two places at a distance of at most FARTHEST."""
    return WEIGHT * F.sqrt(1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))


def single_rank(count: Column) -> Column:
    """The rank of one lexeme with ``count`` places."""
    squares = F.aggregate(F.sequence(F.lit(1), count.cast("int")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j).cast("double"))
    return F.when(count > 0, WEIGHT * squares / LIMIT).otherwise(0.0)


def pair_rank(places: Column) -> Column:
    """The rank of several lexemes. ``places`` is an array<struct<place, word>> sorted by
    place; a place holds one word, so a pair within reach is at most FARTHEST elements on."""

    def near(here: Column, i: Column) -> Column:
        after = F.slice(places, i + 2, FARTHEST)
        both = F.filter(after, lambda p: (p["place"] - here["place"] <= FARTHEST) & (p["word"] != here["word"]))
        return F.aggregate(both, F.lit(0.0), lambda s, p: s + F.log1p(-_pair(p["place"] - here["place"])))

    logs = F.transform(places, near)
    return -F.expm1(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x))


def ts_rank(places: Column, words: Column, flags: int = 0, length: Column | None = None, distinct: Column | None = None) -> Column:
    """The rank of a match of ``words`` different lexemes, 9 digits; ``flags`` choose what
    it is divided by, of a text of ``length`` lexemes that are ``distinct``."""
    rank = F.when(words == 1, single_rank(F.size(places))).otherwise(pair_rank(places))
    if flags & LOG_LENGTH:
        rank = rank / (1 + F.log(length))
    if flags & LENGTH:
        rank = rank / length
    if flags & DISTINCT:
        rank = rank / distinct
    if flags & LOG_DISTINCT:
        rank = rank / (1 + F.log2(distinct))
    if flags & SQUASHED:
        rank = rank / (rank + 1)
    return F.round(rank, 9)
