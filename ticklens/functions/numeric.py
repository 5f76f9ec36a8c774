"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, digits: int) -> Column:
    """Round half up on the binary value: the same few operations in every engine."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den``, or ``default`` where ``den`` is null or not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))
