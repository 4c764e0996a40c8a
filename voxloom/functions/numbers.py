"""Rounding that agrees with exact (binary-value, half-even) decimal rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two exact halves


def exact_round(value: Column, digits: int = 2) -> Column:
    """Round the exact binary value of a double, ties to even.

    Spark's ``round`` works on the shortest decimal form, so 2.675 becomes
    2.68 although the double lies below the tie. Here the product with
    10**digits is taken with its rounding error, and the error settles ties.
    """
    scale = float(10**digits)
    p = value * scale
    big = value * _SPLIT
    hi = big - (big - value)
    err = (hi * scale - p) + (value - hi) * scale
    low = F.floor(p)
    frac = p - low
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (F.abs(low % 2) == 1))))
    return (low + F.when(up, 1).otherwise(0)).cast("double") / scale
