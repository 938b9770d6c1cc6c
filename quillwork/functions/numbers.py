"""Rounding that follows the binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float(2**27 + 1)


def round_binary(c: Column, digits: int = 0) -> Column:
    """Round to `digits`, judging the stored value and not its shortest decimal.

    `round` sees 0.72125 as a tie although the double lies below it. Here the
    double is split into two short halves, whose products with 2 * 10^digits are
    exact, and compared with the midpoint; true ties go to the even digit.
    """
    scale = float(10**digits)
    n = F.floor(c * scale).cast("double")
    big = c * _SPLIT
    high = big - (big - c)
    gap = (high * (2 * scale) - (2 * n + 1)) + (c - high) * (2 * scale)
    up = (gap > 0) | ((gap == 0) & (n % 2 != 0))
    return F.when(up, n + 1).otherwise(n) / scale


def steady_mean(c: Column) -> Column:
    """Mean that does not depend on the order of the rows: summed as decimals."""
    return F.sum(c.cast("decimal(20,12)")).cast("double") / F.count(c)
