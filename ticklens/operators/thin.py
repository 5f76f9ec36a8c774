"""Greedy thinning: keep a row, then the next one at least ``gap_ms`` later.

What is kept depends on what was kept before, so it is no window function. It is
still done in parallel on time slices of a key: a slice is reduced to a small
table "first kept here -> last kept here", the tables of a key are chained, and
with its entry known every slice is walked on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.plans.cells import by_cell_arrays, column
from ticklens.plans.slices import SLICE, slice_of
from ticklens.session import cut_lineage

THIN_SLICE_MS = 10_800_000
NEVER = -(2**62)  # before any stamp


def _steps(t: np.ndarray, starts: np.ndarray, gap_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """For each stamp of the sorted cells the place of the next one that may be kept, and the end of its cell."""
    n = len(t)
    sizes = np.diff(np.append(starts, n))
    cell, ends = np.repeat(np.arange(len(starts)), sizes), np.repeat(np.append(starts[1:], n), sizes)
    # Cells lie one after the other on one line, farther apart than any step reaches.
    line = (t - t[starts][cell]) + cell * (int((t - t[starts][cell]).max(initial=0)) + gap_ms + 1)
    return np.searchsorted(line, line + gap_ms), ends


def _last_kept(t: np.ndarray, starts: np.ndarray, gap_ms: int) -> np.ndarray:
    """For each stamp, the last one kept in its cell if it is kept itself."""
    step, ends = _steps(t, starts, gap_ms)
    step = np.where(step < ends, step, np.arange(len(t)))
    while True:
        further = step[step]
        if np.array_equal(further, step):
            return t[step]
        step = further


def thin_stamps(
    stamps: DataFrame, keys: Sequence[str], gap_ms: int, slice_ms: int = THIN_SLICE_MS
) -> DataFrame:
    """Kept stamps of distinct (keys, t)."""
    if not keys:
        one = stamps.select(F.lit(0).alias("_all"), "t")
        return thin_stamps(one, ["_all"], gap_ms, slice_ms).drop("_all")
    keys = list(keys)
    cells = [*keys, SLICE]
    stamps = stamps.select(*keys, "t").withColumn(SLICE, slice_of(F.col("t"), slice_ms))
    stamps = cut_lineage(stamps)  # read twice below
    key_fields = [stamps.schema[k] for k in cells]
    schema = lambda *names: T.StructType(
        key_fields + [T.StructField(n, T.LongType()) for n in names]
    )

    def taken(table: pa.Table, names: list[str], at: np.ndarray) -> dict[str, object]:
        some = table.select(names).take(pa.array(at))
        return {c: some.column(c).combine_chunks() for c in names}

    def transfer(table: pa.Table, starts: np.ndarray) -> dict[str, object]:
        t = column(table, "t")
        last = _last_kept(t, starts, gap_ms)
        # The carried-in stamp is older than a cell's first, so that or one up to a gap later, and one more, is kept first.
        first = np.repeat(t[starts], np.diff(np.append(starts, len(t))))
        able = np.ones(len(t), bool)
        able[1:] = t[:-1] < first[1:] + gap_ms
        able[starts] = True
        ends = np.append((last[1:] != last[:-1]) | ~able[1:], True)
        ends[starts[1:] - 1] = True
        at = np.flatnonzero(able & ends)
        return taken(table, cells, at) | {"from_t": t[at], "last_t": last[at]}

    def chain(table: pa.Table, starts: np.ndarray) -> dict[str, object]:
        slices, first, last = (column(table, c).tolist() for c in (SLICE, "from_t", "last_t"))
        fresh, at, entries, ready, open_slice = set(starts.tolist()), [], [], NEVER, False
        for i in range(len(slices)):
            if i in fresh:
                ready = NEVER  # earliest stamp that may be kept next
            if i in fresh or slices[i] != slices[i - 1]:
                at.append(i)
                entries.append(ready)
                open_slice = True
            if open_slice and first[i] >= ready:
                ready, open_slice = last[i] + gap_ms, False
        return taken(table, cells, np.array(at)) | {"ready": entries}

    def walk(table: pa.Table, starts: np.ndarray) -> dict[str, object]:
        """The first row of a cell has its entry."""
        t, ready = column(table, "t"), column(table, "ready")
        own = np.ones(len(t), bool)
        own[starts] = False
        ends = np.append(starts[1:], len(t))
        some = ends > starts + 1
        at_t = np.flatnonzero(own)
        first = (starts - np.arange(len(starts)))[some]  # where cells start among the stamps
        stamps, limit = t[at_t], ready[starts][some]
        step, over = _steps(stamps, first, gap_ms)
        sizes = np.diff(np.append(first, len(stamps)))
        here = first + np.add.reduceat(stamps < np.repeat(limit, sizes), first) if len(first) else first
        kept, end = np.zeros(len(stamps) + 1, bool), np.append(first[1:], len(stamps))
        while len(here := here[(ok := here < end)]):
            kept[here], end = True, end[ok]
            here = step[here]
        return taken(table, [*cells, "t"], at_t[kept[:-1]])

    tables = by_cell_arrays(stamps, cells, ["t"], transfer, schema("from_t", "last_t"))
    entries = by_cell_arrays(tables, keys, [SLICE, "from_t"], chain, schema("ready"))
    both = stamps.unionByName(entries, allowMissingColumns=True)
    low = F.coalesce("ready", F.lit(0)).alias("ready")
    both = both.select(*cells, F.coalesce("t", F.lit(NEVER)).alias("t"), low, F.col("t").isNotNull().alias("own"))
    kept = by_cell_arrays(both, cells, ["own", "t"], walk, schema("t"))
    return kept.drop(SLICE)


def thin_by_gap(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap_ms: int,
    order: Sequence[str] = (),
    slice_ms: int = THIN_SLICE_MS,
) -> DataFrame:
    """Rows kept by greedy thinning; ``order`` picks the row among equal (keys, ts)."""
    keys = list(keys)
    stamps = df.select(*keys, F.col(ts).cast("long").alias("t")).distinct()
    kept = thin_stamps(stamps, keys, gap_ms, slice_ms).withColumnRenamed("t", ts)
    out = df.join(kept, [*keys, ts], "left_semi")
    if not order:
        return out
    w = Window.partitionBy(*keys, ts).orderBy(*order)
    return out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def snapshot_ticks(
    tape: DataFrame, cadence_ms: int = 1_000, order: Sequence[str] = ("ts", "recv_ts", "seq")
) -> tuple[DataFrame, DataFrame]:
    """Data-driven instants of one global clock, for replays.

    An instant is the ts of the first event at least a cadence after the last
    instant; every symbol known by that event is emitted. Returns the (symbol, ts)
    pairs and the cut (ts, by): the event that set the instant off.
    """
    place = F.struct(*order)
    at = thin_stamps(tape.select(F.col("ts").alias("t")).distinct(), [], cadence_ms)
    cut = (
        tape.join(at.withColumnRenamed("t", "ts"), "ts", "left_semi")
        .groupBy("ts")
        .agg(F.min(place).alias("by"))
    )
    # Symbols meet the instants slice by slice; the pairs are the result itself.
    slice_ms = 600_000
    cut_sl = cut.withColumn(SLICE, slice_of(F.col("ts"), slice_ms))
    last = cut_sl.agg(F.max(SLICE)).scalar()
    lives = tape.groupBy("symbol").agg(F.min(place).alias("first"))
    start = slice_of(F.col("first.ts"), slice_ms)
    lives = lives.filter(start <= last).withColumn(SLICE, F.explode(F.sequence(start, last)))
    pairs = lives.join(cut_sl, SLICE).filter(F.col("by") >= F.col("first")).select("symbol", "ts")
    return pairs, cut
