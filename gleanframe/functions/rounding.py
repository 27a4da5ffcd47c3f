"""Decimal rounding of doubles by their exact binary value, half to even, in plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products with small numbers are exact (Veltkamp).
_SPLITTER = float((1 << 27) + 1)


def exact_round(x: Column, digits: int) -> Column:
    """x to `digits` decimals. Spark's round() works on the shortest decimal that reads back as x instead,
    so it rounds 2.675, which is a little less, up."""
    m = F.lit(10.0**digits)
    x = x.cast("double")
    high = x * _SPLITTER - (x * _SPLITTER - x)
    below = F.floor(x * m)
    past_half = (high * m - (below + 0.5)) + (x - high) * m
    up = (past_half > 0) | ((past_half == 0) & (F.pmod(below, F.lit(2)) == 1))
    return (below + up.cast("int")) / m
