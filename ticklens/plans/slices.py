"""Time slices: windows and running values that never need one key in one task.

A key may hold any share of all rows, so nothing here partitions by key alone.
Rows are cut into time slices and every window runs over ``(key, slice)``.

* Bounded frames (``(t-w, t]``, ``[t, t+h]``): ``with_slices`` copies a row into
  the neighbouring slices whose frames can reach it; the copies are dropped
  after the window has been taken (``home_rows``).
* Unbounded frames (running sum, max, last value): ``running`` takes one partial
  per ``(key, slice)``, scans the partials (few rows per key), and puts what comes
  into a slice in front of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "slice"


def slice_of(ts: Column, slice_ms: int) -> Column:
    return F.floor(ts / F.lit(slice_ms)).cast("long")


def with_slices(
    df: DataFrame, ts: str, slice_ms: int, back_ms: int = 0, forward_ms: int = 0
) -> DataFrame:
    """Copy each row into every slice whose backward/forward frames can see it.

    ``back_ms``: anchors look back to ``t - back_ms`` inclusive;
    ``forward_ms``: anchors look ahead to ``t + forward_ms`` inclusive.
    """
    t = F.col(ts)
    first = slice_of(t - F.lit(forward_ms), slice_ms)
    last = slice_of(t + F.lit(back_ms), slice_ms)
    if not back_ms and not forward_ms:
        return df.withColumn(SLICE, slice_of(t, slice_ms))
    return df.withColumn(SLICE, F.explode(F.sequence(first, last)))


def home_rows(df: DataFrame, ts: str, slice_ms: int) -> DataFrame:
    """Drop the copies made by ``with_slices`` (and the slice column)."""
    return df.filter(F.col(SLICE) == slice_of(F.col(ts), slice_ms)).drop(SLICE)


@dataclass(frozen=True)
class Run:
    """One running value. ``kind`` is sum, max, min, or last (last non-null)."""

    out: str
    kind: str
    expr: Column
    inclusive: bool = True


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    slice_expr: Column,
    order: Sequence[str],
    runs: Sequence[Run],
) -> DataFrame:
    """Add running values over all earlier rows of a key, in two levels.

    ``order`` must be total within a key and start with the column that
    ``slice_expr`` grows with. With ``inclusive=False`` the row itself is left out.
    Null keys are keys like any other; rows without a place in time come first.
    """
    keys = list(keys)
    cell = [*keys, "_sl"]
    base = df.withColumn("_sl", slice_expr)
    order_key = F.struct(*[F.col(c) for c in order])

    partials = []
    for i, r in enumerate(runs):
        if r.kind == "last":
            p = F.max_by(r.expr, F.when(r.expr.isNotNull(), order_key))
        else:
            p = _AGG[r.kind](r.expr)
        partials.append(p.alias(f"_p{i}"))
    level = base.groupBy(*cell).agg(*partials)
    kinds = [level.schema[f"_p{i}"].dataType for i in range(len(runs))]

    before = Window.partitionBy(*keys).orderBy("_sl").rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for i, r in enumerate(runs):
        c = F.col(f"_p{i}")
        v = F.last(c, ignorenulls=True) if r.kind == "last" else _AGG[r.kind](c)
        carried.append(v.over(before).cast(kinds[i]).alias(f"_e{i}"))
    level = level.select(*cell, *carried)

    # What comes into a cell is its first row, so one sort serves all and nothing is joined; windows take null keys as keys.
    comes = reduce(or_, (F.col(f"_e{i}").isNotNull() for i in range(len(runs))))
    first = level.filter(comes).withColumn("_at", F.lit(0))
    rows = base.select("*", *(r.expr.cast(kinds[i]).alias(f"_e{i}") for i, r in enumerate(runs)), F.lit(1).alias("_at"))
    both = rows.unionByName(first, allowMissingColumns=True)
    inside = Window.partitionBy(*cell).orderBy("_at", *order)
    local = []
    for i, r in enumerate(runs):
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
        c = F.col(f"_e{i}")
        v = F.last(c, ignorenulls=True) if r.kind == "last" else _AGG[r.kind](c)
        v = F.coalesce(v.over(frame), F.lit(0)) if r.kind == "sum" else v.over(frame)
        local.append(v.cast(kinds[i]).alias(r.out))
    return both.select(*df.columns, "_at", *local).filter("_at = 1").drop("_at")
