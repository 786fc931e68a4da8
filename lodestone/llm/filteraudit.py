"""How filters of a corpus interact: what each removes in every order of application.

Every document gets a mask of the filters that it fails. The numbers of documents by part
and mask are all that a corpus leaves behind, however large it is: 2^f rows a part for f
filters. From them each part's removal polynomial is formed, the multilinear extension of
"how many documents does a set of filters remove":

    R(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i))

Its value at a corner (every x_i 0 or 1) is the number removed by that set of filters, so
survivors after each step of an order are the part's documents less a corner. The Shapley
value of a filter is the integral of the partial derivative along the diagonal from 0 to
1, taken term by term in exact rationals; times f! it is the filter's removals summed over
all orders. Good and toxic documents have polynomials of their own.

Masks are counted with partial aggregates; a text's least id is joined by text and id, so
copies of one text, however many, are dealt over all tasks.

Defined results: a null part is the empty string, a null text the empty text. A row with a
null id doesn't fail the copy filter, and neither do rows that repeat the least id of
their text. Labels repeated for an id count once, as 1 if any of them is 1; without labels
nothing is good or toxic. An empty table has no parts and gives no rows. Other columns of
the table aren't read. Texts are judged whole, in one projection over the row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Filters have at most this many letters, so that a part has at most 120 orders.
MOST_FILTERS = 5
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

Polynomial = dict[int, int]


def few_words(words: Column, least: int) -> Column:
    return F.size(words) < least


def repetitive(words: Column, percent: int) -> Column:
    """Whether distinct words are less than ``percent`` of all."""
    return F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * percent


def class_share_above(text: Column, pattern: str, percent: int) -> Column:
    """Whether characters of a class are more than ``percent`` of all."""
    others = F.length(F.regexp_replace(text, pattern, ""))
    return (F.length(text) - others).cast("long") * 100 > F.length(text).cast("long") * percent


def holds(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def copies(docs: DataFrame, key: str, digest: str) -> DataFrame:
    """docs with ``_copy``: whether a smaller key has the same digest."""
    first = docs.groupBy(digest).agg(F.min(key).alias(key)).filter(F.col(key).isNotNull()).withColumn("_first", F.lit(True))
    return docs.join(first, [digest, key], "left").withColumn("_copy", F.col(key).isNotNull() & F.col("_first").isNull()).drop("_first")


def masks(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], copy: str | None, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the set of filters that they
    fail, bit i for the i-th letter in order. ``conditions`` maps letters to expressions
    over ``_text`` and ``_words``; ``copy`` is the letter of the filter of copies."""
    letters = sorted([*conditions, *([copy] if copy else [])])
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters")
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("_text"), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("_words"))
    plain = sum((F.when(fails, bit[letter]).otherwise(0) for letter, fails in conditions.items()), F.lit(0))
    judged = read.select("_key", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest"), plain.cast("int").alias("mask"))
    if copy:
        judged = copies(judged, "_key", "_digest").withColumn("mask", F.col("mask") + F.when(F.col("_copy"), bit[copy]).otherwise(0))
    one = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias(name)
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(one("quality"), one("toxic"))
    rows = judged.select("_key", "part", "mask").join(marks, "_key", "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"))


def polynomial(counts: Mapping[int, int]) -> Polynomial:
    """Coefficients of the removal polynomial by the set of its variables, from counts by
    mask. 1 - product of (1 - x_i) is the sum over nonempty subsets, odd sizes positive."""
    found: Polynomial = {}
    for mask, n in counts.items():
        subset = mask
        while subset:
            found[subset] = found.get(subset, 0) + (n if subset.bit_count() % 2 else -n)
            subset = (subset - 1) & mask
    return found


def corner(p: Polynomial, filters: int) -> int:
    """R where the variables of ``filters`` are 1 and the others 0."""
    return sum(c for subset, c in p.items() if subset & ~filters == 0)


def shapley(p: Polynomial, i: int) -> Fraction:
    """The integral over t from 0 to 1 of dR/dx_i at (t, ..., t): a term of d variables
    becomes t^(d-1), whose integral is 1/d."""
    return sum((Fraction(c, subset.bit_count()) for subset, c in p.items() if subset >> i & 1), Fraction(0))


def audit_rows(part: str, letters: Sequence[str], counts: Mapping[int, tuple[int, int, int]]) -> Iterator[dict]:
    """A row for every order and step of one part, from (n, good, toxic) by mask."""
    removed, good, toxic = (polynomial({m: c[k] for m, c in counts.items()}) for k in range(3))
    total, every, orders = sum(c[0] for c in counts.values()), (1 << len(letters)) - 1, math.factorial(len(letters))
    at = {name: [corner(p, s) for s in range(every + 1)] for name, p in (("removed", removed), ("good", good), ("toxic", toxic))}
    value = [shapley(removed, i) * orders for i in range(len(letters))]
    assert all(v.denominator == 1 for v in value)
    for order in itertools.permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = at["removed"][after] - at["removed"][before]
            yield {
                "part": part,
                "filter_order": "".join(letters[j] for j in order),
                "step": step,
                "kept": total - at["removed"][after],
                "removed": here,
                "redundant": at["removed"][1 << i] - here,
                "unique_fails": at["removed"][every] - at["removed"][every & ~(1 << i)],
                "good_lost": at["good"][after] - at["good"][before],
                "toxic_lost": at["toxic"][after] - at["toxic"][before],
                "shapley": int(value[i]),
            }
            before = after


_ARROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])


def audit(counted: DataFrame, letters: Sequence[str]) -> DataFrame:
    """The audit of masks(): one row per part, order of the filters and step. A part is one
    row of at most 2^f counts here, and parts are read one after the other."""
    letters = sorted(letters)
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in r["counts"]}
                yield pa.RecordBatch.from_pylist(list(audit_rows(r["part"], letters, counts)), schema=_ARROW)

    return by_part.mapInArrow(rows, RESULT)
