"""Robust z-scores: how far a value lies from the moving median, in units of the moving median deviation.

A key may hold any share of the rows, so it is cut into time slices with the rows that a window can reach. Within a
slice the window is an order-statistic tree over the slice's values: a row that enters or leaves costs the logarithm
of the number of values, the median is read by rank, and the median deviation is found by halving among the
ranks on both sides of it. No frame is ever scanned again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.plans.cells import by_cell_arrays, column
from ticklens.plans.slices import SLICE, home_rows, with_slices

NORMAL = 1.4826  # median deviation to standard deviation of a normal distribution


class RankTree:
    """Counts of sorted values with the k-th smallest in logarithmic time."""

    def __init__(self, values: np.ndarray):
        self.values = values.tolist()
        self.size = len(self.values)
        self.tree = [0] * (self.size + 1)
        self.top = 1 << max(0, self.size.bit_length() - 1)
        self.n = 0

    def add(self, rank: int, by: int) -> None:
        self.n += by
        i, tree, size = rank + 1, self.tree, self.size
        while i <= size:
            tree[i] += by
            i += i & -i

    def kth(self, k: int) -> float:
        """The value at place ``k`` (from 0) of those that are in."""
        at, step, tree, size = 0, self.top, self.tree, self.size
        while step:
            to = at + step
            if to <= size and tree[to] <= k:
                at, k = to, k - tree[to]
            step >>= 1
        return self.values[at]

    def median(self) -> float:
        half = self.n // 2
        return self.kth(half) if self.n % 2 else (self.kth(half - 1) + self.kth(half)) / 2

    def _deviation(self, m: float, k: int) -> float:
        """The k-th smallest distance (from 0) to ``m``, the median of those that are in.

        Places below the middle lie at or below ``m``, the others at or above it; of both sides, read outwards, the
        ``k + 1`` nearest have ``low`` places on the left.
        """
        middle, n, kth = self.n // 2, self.n, self.kth
        low, high = max(0, k + 1 - (n - middle)), min(middle, k + 1)
        while low < high:  # how many of the nearest are on the left: halve until the next left one is not nearer
            left = (low + high) // 2
            right = k - left  # the last one on the right if only ``left`` come from the left
            if m - kth(middle - 1 - left) < kth(middle + right) - m:
                low = left + 1
            else:
                high = left
        found = [m - kth(middle - low)] if low else []
        if k + 1 - low:
            found.append(kth(middle + k - low) - m)
        return max(found)

    def deviation(self, m: float) -> float:
        half = self.n // 2
        return self._deviation(m, half) if self.n % 2 else (self._deviation(m, half - 1) + self._deviation(m, half)) / 2


def robust_z(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, window_ms: int, slice_ms: int | None = None
) -> DataFrame:
    """Add ``n``, ``median``, ``mad`` and ``robust_z`` over the rows of the key in ``(ts - window_ms, ts]``.

    All rows of one instant see each other. Null and NaN values are in no window, and their own score is null, as is
    the score where the deviation is 0 and the value is the median; elsewhere it is infinite then.
    """
    keys, names = list(keys), df.columns
    slice_ms = slice_ms or 4 * window_ms
    x = F.col(value).cast("double")
    rows = df.withColumns({"_x": F.when(~F.isnan(x), x), "_t": F.col(ts).cast("long")})
    rows = with_slices(rows, "_t", slice_ms, back_ms=window_ms - 1)

    def score(table: pa.Table, starts: np.ndarray) -> dict[str, object]:
        t, xs = column(table, "_t"), column(table, "_x").astype("f8")
        n, median, mad = np.zeros(len(t), "i8"), np.full(len(t), np.nan), np.full(len(t), np.nan)
        for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
            _window(t[a:b], xs[a:b], n[a:b], median[a:b], mad[a:b])
        out = {c: table.column(c).combine_chunks() for c in table.column_names}
        return out | {"n": n, "median": pa.array(median, from_pandas=True), "mad": pa.array(mad, from_pandas=True)}

    def _window(t: np.ndarray, xs: np.ndarray, n: np.ndarray, median: np.ndarray, mad: np.ndarray) -> None:
        there = ~np.isnan(xs)
        values, ranks = np.unique(xs[there], return_inverse=True)
        rank = np.full(len(t), -1)
        rank[there] = ranks
        rank, tree, out = rank.tolist(), RankTree(values), 0
        instants = np.flatnonzero(np.append(True, t[1:] != t[:-1])).tolist()
        gone = np.searchsorted(t, t[instants] - window_ms, side="right").tolist()
        for a, b, first in zip(instants, [*instants[1:], len(t)], gone, strict=True):
            for i in range(a, b):
                if rank[i] >= 0:
                    tree.add(rank[i], 1)
            for i in range(out, first):
                if rank[i] >= 0:
                    tree.add(rank[i], -1)
            out = max(out, first)
            n[a:b] = tree.n
            if tree.n:
                median[a:b] = m = tree.median()
                mad[a:b] = tree.deviation(m)

    schema = rows.schema.add("n", "long").add("median", "double").add("mad", "double")
    done = home_rows(by_cell_arrays(rows, [*keys, SLICE], ["_t"], score, schema), "_t", slice_ms)
    far = F.col("_x") - F.col("median")
    z = F.when(F.col("mad") > 0, far / (NORMAL * F.col("mad"))).when(far != 0, F.signum(far) * float("inf"))
    return done.select(*names, "n", "median", "mad", z.alias("robust_z"))
