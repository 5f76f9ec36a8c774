"""Platt scaling of a probability column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-7


def logit(p: Column) -> Column:
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return F.log(clipped / (1 - clipped))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def platt(p: Column, a: float | Column, b: float | Column) -> Column:
    a = F.lit(a) if isinstance(a, (int, float)) else a
    b = F.lit(b) if isinstance(b, (int, float)) else b
    return sigmoid(a * logit(p) + b)
