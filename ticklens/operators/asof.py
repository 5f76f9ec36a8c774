"""As-of joins by union and running values; no pair of rows is ever formed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.plans.slices import Run, running, slice_of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    value: str = "match",
    slice_ms: int = 600_000,
    direction: str = "backward",
    strict: bool = False,
    tie: str | None = None,
) -> DataFrame:
    """Add ``value``: the right row (struct of its non-key columns) nearest in ``ts``.

    ``backward``: last right row with ts <= left ts; ``forward``: first one with
    ts >= left ts. ``strict`` leaves equal timestamps out. ``tie`` is a right column
    that orders rows of one timestamp. Null where there is none.
    """
    keys = list(keys)
    sign = 1 if direction == "backward" else -1
    cols = [c for c in right.columns if c not in keys]
    a = left.select(
        *keys,
        (F.col("ts") * sign).alias("_t"),
        F.lit(0 if strict else 1).alias("_side"),
        F.lit(0).cast("long").alias("_tie"),
        F.struct(*left.columns).alias("_l"),
    )
    order = F.lit(0) if tie is None else F.col(tie) * sign
    b = right.select(
        *keys,
        (F.col("ts") * sign).alias("_t"),
        F.lit(1 if strict else 0).alias("_side"),
        order.cast("long").alias("_tie"),
        F.struct(*cols).alias("_r"),
    )
    rows = a.unionByName(b, allowMissingColumns=True)
    run = Run("_m", "last", F.col("_r"))
    out = running(rows, keys, slice_of(F.col("_t"), slice_ms), ["_t", "_side", "_tie"], [run])
    return out.filter(F.col("_l").isNotNull()).select("_l.*", F.col("_m").alias(value))


def future_prices(samples: DataFrame, trades: DataFrame, lookahead_ms: int) -> DataFrame:
    """Range join ``t <= p.ts <= t + lookahead`` reduced to highest and lowest price."""
    from ticklens.operators.labels import forward_extremes

    return forward_extremes(samples, trades, {"look": lookahead_ms})
