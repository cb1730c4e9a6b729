"""Expressions over marker positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def available(*axes: str) -> Column:
    """Whether a reading is there: no axis null or NaN, and not all axes exactly 0."""
    there = F.lit(True)
    zero = F.lit(True)
    for c in axes:
        there = there & F.col(c).isNotNull() & ~F.isnan(c)
        zero = zero & (F.col(c) == 0)
    return F.coalesce(there & ~zero, F.lit(False))


def finite(value: str | Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
