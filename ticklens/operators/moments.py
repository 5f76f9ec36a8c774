"""Moving second moments: realized volatility, correlation and beta against a reference symbol.

The window ``(t - w, t]`` is the end of one time slice of length w and the beginning of the next. Either part is a growing
frame, whose moments Spark updates row by row around the running mean; both parts are merged by the exact formula
for the moments of a union. Nothing is a difference of large sums, so nothing cancels, and no frame is scanned again.
Windows run per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.plans.slices import SLICE, Run, running, slice_of

_PARTS = ("n", "x", "y", "xx", "yy", "xy")


def _parts(w, x: Column, y: Column) -> Column:
    """Count, means and summed products around the means over a growing frame."""
    n = F.count(x).over(w)
    each = (
        n,
        F.avg(x).over(w),
        F.avg(y).over(w),
        F.var_pop(x).over(w) * n,
        F.var_pop(y).over(w) * n,
        F.covar_pop(x, y).over(w) * n,
    )
    return F.struct(*(c.cast("double").alias(name) for c, name in zip(each, _PARTS, strict=True)))


def _merged(a: Column, b: Column) -> Column:
    """The parts of two frames together."""
    n = a["n"] + b["n"]
    dx, dy, share = b["x"] - a["x"], b["y"] - a["y"], a["n"] * b["n"] / n
    both = F.struct(
        n.alias("n"),
        (a["x"] + dx * (b["n"] / n)).alias("x"),
        (a["y"] + dy * (b["n"] / n)).alias("y"),
        (a["xx"] + b["xx"] + dx * dx * share).alias("xx"),
        (a["yy"] + b["yy"] + dy * dy * share).alias("yy"),
        (a["xy"] + b["xy"] + dx * dy * share).alias("xy"),
    )
    none = lambda p: p.isNull() | (p["n"] == 0)
    return F.when(none(a), b).when(none(b), a).otherwise(both)


def moving_moments(
    df: DataFrame, keys: Sequence[str], ts: str, x: Column, y: Column, window_ms: int, out: str = "moments"
) -> DataFrame:
    """Add a struct of n, means and summed products of ``x`` and ``y`` over ``(ts - window_ms, ts]``.

    Rows where either is null or NaN are in no window. Rows of one instant see each other.
    """
    keys = list(keys)
    there = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    rows = df.withColumns(
        {"_x": F.when(there, x.cast("double")), "_y": F.when(there, y.cast("double")), SLICE: slice_of(F.col(ts), window_ms)}
    )
    cell = Window.partitionBy(*keys, SLICE)
    grown = cell.orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    left = cell.orderBy(F.col(ts).desc()).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*", _parts(grown, F.col("_x"), F.col("_y")).alias("_own"), _parts(left, F.col("_x"), F.col("_y")).alias("_end"),
        F.col(ts).alias("_pos"), F.lit(0).alias("_kind"),
    )
    # What a slice has left at an instant goes to the rows a window later that still see it.
    marks = rows.select(
        *keys, (F.col(SLICE) + 1).alias(SLICE), (F.col("_pos") + window_ms).alias("_pos"), F.lit(1).alias("_kind"),
        F.col("_end").alias("_before"),
    ).dropDuplicates([*keys, SLICE, "_pos"])
    both = rows.unionByName(marks, allowMissingColumns=True)
    seen = cell.orderBy(F.col("_pos").desc(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_before", F.last("_before", ignorenulls=True).over(seen)).filter("_kind = 0")
    return both.select(*df.columns, _merged(F.col("_before"), F.col("_own")).alias(out))


def log_returns(df: DataFrame, keys: Sequence[str], ts: str, price: str, slice_ms: int) -> DataFrame:
    """Add ``ret``, the logarithm of the price over that of the row before of the key; null for prices not above 0."""
    was = Run("_was", "last", F.col(price), inclusive=False)
    rows = running(df, keys, slice_of(F.col(ts), slice_ms), [ts], [was])
    ok = (F.col(price) > 0) & (F.col("_was") > 0)
    return rows.withColumn("ret", F.when(ok, F.log(F.col(price) / F.col("_was")))).drop("_was")


def realized_vol(df: DataFrame, keys: Sequence[str], ts: str, price: str, window_ms: int) -> DataFrame:
    """Add ``n_returns`` and ``realized_vol``, the sample deviation of the log returns in the window (null below two)."""
    rows = log_returns(df, keys, ts, price, window_ms)
    rows = moving_moments(rows, keys, ts, F.col("ret"), F.col("ret"), window_ms, "_m")
    m = F.col("_m")
    vol = F.when(m["n"] >= 2, F.sqrt(m["xx"] / (m["n"] - 1)))
    return rows.select(*df.columns, m["n"].cast("long").alias("n_returns"), vol.alias("realized_vol"))


def market_beta(
    df: DataFrame, reference: str, ts: str = "ts", symbol: str = "symbol", price: str = "mid", window_ms: int = 60_000
) -> DataFrame:
    """Add ``beta`` and ``corr`` of the log returns against those of one symbol at the same instants.

    The reference is one row per instant and meets the rows by instant, so it is dealt like they are; where it is
    small, Spark finds so at run time and sends it to all tasks. Instants without a return of the reference are in no
    window. Null where either deviation is 0 or fewer than two returns are in.
    """
    rows = log_returns(df, [symbol], ts, price, window_ms)
    ref = rows.filter(F.col(symbol) == reference).groupBy(ts).agg(F.max("ret").alias("_ref"))
    rows = rows.join(ref, ts, "left")
    rows = moving_moments(rows, [symbol], ts, F.col("ret"), F.col("_ref"), window_ms, "_m")
    m = F.col("_m")
    known = (m["n"] >= 2) & (m["yy"] > 0)
    beta = F.when(known, m["xy"] / m["yy"])
    corr = F.when(known & (m["xx"] > 0), m["xy"] / (F.sqrt(m["xx"]) * F.sqrt(m["yy"])))
    return rows.select(*df.columns, m["n"].cast("long").alias("n_returns"), beta.alias("beta"), corr.alias("corr"))
