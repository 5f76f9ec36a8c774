"""Isotonic calibration: pool adjacent violators, slice by slice, until nothing violates.

Rows are first counted per distinct score. The distinct scores of a head are cut into slices of a bounded number of
rows; each slice pools its own blocks on a stack. Then blocks are counted off anew, every other time by half a slice
further, so that what met at a boundary lies inside, and the pooling goes on until no block's mean is at or above the
mean of the block after it. Whatever the order of pooling, the blocks that are left are the same, so the result does
not depend on the slices. Means are compared as products of whole numbers.

A score that is null or NaN, or a label that is neither 0 nor 1, takes no part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.operators.metrics import SCORE_SLICES
from ticklens.plans.cells import by_cell_arrays, column
from ticklens.plans.slices import SLICE, Run, running
from ticklens.session import cut_lineage

SLICE_ROWS = 100_000


def _cell(score: str, sign: int = 1):
    return F.floor(F.col(score) * (sign * SCORE_SLICES)).cast("long")


def pooled(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks of each (by, slice), pooled until their means grow strictly within the slice."""

    def pool(table: pa.Table, starts: np.ndarray) -> dict[str, object]:
        lo, hi, n, pos = (column(table, c).tolist() for c in ("lo", "hi", "n", "pos"))
        first, out = set(starts.tolist()), []
        for i in range(len(lo)):
            if i in first:
                floor = len(out)  # blocks of the slices before stay
            out.append((i, lo[i], hi[i], n[i], pos[i]))
            while len(out) > floor + 1 and out[-2][4] * out[-1][3] >= out[-1][4] * out[-2][3]:
                b, a = out.pop(), out.pop()
                out.append((a[0], a[1], b[2], a[3] + b[3], a[4] + b[4]))
        at, *columns = zip(*out, strict=True)
        keys = table.select(list(by)).take(pa.array(at))
        return {c: keys.column(c).combine_chunks() for c in by} | dict(zip(("lo", "hi", "n", "pos"), columns, strict=True))

    keep = blocks.select(*by, "lo", "hi", "n", "pos").schema
    return by_cell_arrays(blocks, [*by, SLICE], ["lo"], pool, keep)


def _violations(blocks: DataFrame, by: Sequence[str]) -> int:
    was = Run("was", "last", F.struct("pos", "n"), inclusive=False)
    rows = running(blocks, by, _cell("lo"), ["lo"], [was])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return rows.filter(big("was.pos") * big("n") >= big("pos") * big("was.n")).count()


def isotonic_fit(long: DataFrame, by: Sequence[str] = ("head",), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Blocks per ``by``: lowest and highest score, rows, positives and their share; shares grow strictly."""
    by = list(by)
    ok = F.col("score").isNotNull() & ~F.isnan("score") & F.col("y").isin(0, 1)
    blocks = (
        long.filter(ok)
        .groupBy(*by, F.col("score").cast("double").alias("lo"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
        .withColumn("hi", F.col("lo"))
    )
    shift = 0
    while True:
        place = Run("place", "sum", F.lit(1), inclusive=False)
        rows = running(blocks, by, _cell("lo"), ["lo"], [place])
        rows = rows.withColumn(SLICE, F.floor((F.col("place") + shift) / slice_rows).cast("long"))
        blocks = cut_lineage(pooled(rows, by))
        if not _violations(blocks, by):
            return blocks.withColumn("value", F.col("pos") / F.col("n"))
        shift = slice_rows // 2 - shift


def isotonic_apply(long: DataFrame, fit: DataFrame, by: Sequence[str] = ("head",)) -> DataFrame:
    """Add ``calibrated``: a block's share inside of it, straight lines between blocks, the end blocks' shares beyond.

    A group without blocks keeps its raw score; so does a null score. Blocks meet the rows in their order, in
    slices of the score, no pairs are made.
    """
    by = list(by)
    block = F.struct("lo", "hi", "value").alias("_block")
    marks = fit.select(*by, F.col("lo").alias("score"), block, F.lit(0).alias("_kind"))
    rows = long.select("*", F.lit(None).cast(marks.schema["_block"].dataType).alias("_block"), F.lit(1).alias("_kind"))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_down", -F.col("score"))
    both = running(both, by, _cell("score"), ["score", "_kind"], [Run("_a", "last", F.col("_block"))])
    both = running(both, by, _cell("score", -1), ["_down", "_kind"], [Run("_b", "last", F.col("_block"))])
    x, a, b = F.col("score"), F.col("_a"), F.col("_b")
    between = a["value"] + (b["value"] - a["value"]) * ((x - a["hi"]) / (b["lo"] - a["hi"]))
    value = (
        F.when(x.isNull() | (a.isNull() & b.isNull()), x)
        .when(a.isNull(), b["value"])
        .when(b.isNull() | (x <= a["hi"]), a["value"])
        .otherwise(between)
    )
    out = both.filter("_kind = 1").withColumn("calibrated", value)
    return out.select(*long.columns, "calibrated")
