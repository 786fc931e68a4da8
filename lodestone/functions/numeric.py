"""Rounding of binary doubles by their exact value, half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
_SPLIT = 134_217_729.0
#: Doubles from here on are whole numbers.
_WHOLE = float(1 << 52)


def _halves(x: float) -> tuple[float, float]:
    c = _SPLIT * x
    high = c - (c - x)
    return high, x - high


def exact_round(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` (0 to 15) decimals as its exact binary value asks
    for: 2.675 is a little less than it looks and gives 2.67, 0.125 is a tie and gives
    0.12. Spark's own round works on the shortest decimal.

    The product with the power of ten is taken with its rounding error, so that a product
    that looks like a tie is told from one that is. Values whose product is 2^52 or more
    have no such digits and stay as they are; so do null, NaN and infinities.
    """
    if not 0 <= digits <= 15:
        raise ValueError("0 to 15 digits")
    power = float(10**digits)
    high, low = _halves(power)

    def rounded(v: Column) -> Column:
        x = F.abs(v)
        return F.element_at(F.transform(F.array(F.struct(x.alias("x"), (x * power).alias("p"), (x * _SPLIT - (x * _SPLIT - x)).alias("h"))), settled), 1) * F.when(v < 0, -1.0).otherwise(1.0)

    def settled(s: Column) -> Column:
        x, p, h = s["x"], s["p"], s["h"]
        rest = x - h
        error = ((h * high - p) + h * low + rest * high) + rest * low  # x * power is p + error, exactly
        floor = F.floor(p).cast("double")
        side = p - floor - 0.5
        up = (side > 0) | ((side == 0) & ((error > 0) | ((error == 0) & (floor % 2 == 1))))
        return F.when(p < _WHOLE, (floor + F.when(up, 1.0).otherwise(0.0)) / power).otherwise(x)

    number = value.cast("double")
    return F.element_at(F.transform(F.array(number), lambda v: F.when(v.isNull() | F.isnan(v), v).otherwise(rounded(v))), 1)
