"""Rows of a large table that a small one can meet, told before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map that says which keys are there.
BITS = 25


def _slot(on: tuple[str, ...]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*on), 64 - BITS)


def possible(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows whose columns ``on``, of equal types in both, keys may hold: all that it
    does and, by hash, some others; an equi join still has to follow. A map of 2**BITS bits
    is broadcast, 2**BITS / 64 rows whatever the number of keys; more keys make it let more
    through, never less."""
    slot = _slot(on)
    one = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    marks = keys.select(slot.alias("_slot")).select(F.shiftright("_slot", 6).alias("_word"), one.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    near = rows.withColumn("_word", F.shiftright(slot, 6)).withColumn("_at", slot.bitwiseAND(F.lit(63)).cast("int"))
    return near.join(F.broadcast(marks), "_word").filter(F.expr("shiftrightunsigned(_bits, _at) & 1L = 1L")).select(*rows.columns)
