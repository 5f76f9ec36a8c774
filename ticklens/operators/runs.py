"""Unbroken runs of a status (gaps and islands) over time slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklens.plans.slices import SLICE, slice_of
from ticklens.session import cut_lineage


def status_runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    status: str = "status",
    slice_ms: int = 3_600_000,
    tie: Sequence[str] = (),
    materialize: bool = False,
) -> DataFrame:
    """Add ``status_since`` (start of the current unbroken run) and ``status_ms`` (its age)."""
    keys = list(keys)
    df = cut_lineage(df) if materialize else df  # rows and slice heads both read it
    order = [ts, *tie]
    rows = df.withColumn(SLICE, slice_of(F.col(ts), slice_ms))
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    changed = F.lag(F.struct(status)).over(w)
    rows = rows.withColumn(
        "_chg", F.when(changed.isNotNull() & ~changed[status].eqNullSafe(F.col(status)), F.col(ts))
    )
    key = F.struct(*order)
    level = rows.groupBy(*keys, SLICE).agg(
        F.min_by(F.struct(status), key).alias("head"),
        F.max_by(F.struct(status), key).alias("tail"),
        F.min(ts).alias("head_ts"),
        F.max("_chg").alias("last_chg"),
    )
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    broken = ~F.coalesce(F.lag("tail").over(by_slice).eqNullSafe(F.col("head")), F.lit(False))
    level = level.withColumn("broken", broken | F.lag("tail").over(by_slice).isNull())
    since_end = F.coalesce("last_chg", F.when(F.col("broken"), F.col("head_ts")))
    carried = F.last(since_end, ignorenulls=True).over(
        by_slice.rowsBetween(Window.unboundedPreceding, -1)
    )
    cell = F.struct(*keys, SLICE).alias("_cell")  # nulls in a struct meet each other
    level = level.select(cell, F.when(F.col("broken"), F.col("head_ts")).otherwise(carried).alias("_in"))
    inside = F.last("_chg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_cell", cell).join(level, "_cell").withColumn("status_since", F.coalesce(inside, "_in"))
    return out.select(
        *df.columns, "status_since", (F.col(ts) - F.col("status_since")).alias("status_ms")
    )
