"""Order budgets: a token bucket, the throttle and pause rules on it, and cool-downs after fills.

The bucket holds up to ``capacity`` orders and refills with time; an order takes one. What an order leaves is
``min(capacity, before + refilled) - 1``, a map of the form ``min(a, x + b)``. Such maps compose to maps of the same
form, so the level after any number of orders is a running minimum of what each order would leave if the bucket
had been full before it: a (min, plus) prefix scan, taken in two levels over time slices. Levels are whole
thousandths of an order, so they are exact in any order of summation. Demand beyond the budget shows as a level below 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.plans.slices import Run, running, slice_of

MILLI = 1_000


def order_budget(
    orders: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("ts", "order_id"),
    capacity: int = 50,
    per_second: int = 5,
    buffer: int = 10,
    slice_ms: int = 600_000,
) -> DataFrame:
    """Add ``remaining`` (orders left after this one) and ``throttled``.

    An account is throttled from where at most ``buffer`` orders remain until more than twice as many do. ``order``
    is total within a key and starts with the time in ms.
    """
    keys, order = list(keys), list(order)
    ts = F.col(order[0])
    cell = slice_of(ts, slice_ms)
    placed = running(orders, keys, cell, order, [Run("_placed", "sum", F.lit(1))])
    # In thousandths: what is left of a full bucket at this order, less what all orders and the refill add up to so far.
    spent = F.col("_placed") * MILLI - ts * per_second
    full = F.lit(capacity * MILLI - MILLI) + spent
    rows = running(placed.withColumn("_full", full), keys, cell, order, [Run("_least", "min", F.col("_full"))])
    rows = rows.withColumn("_level", F.col("_least") - spent)
    crossed = F.when(F.col("_level") <= buffer * MILLI, True).when(F.col("_level") > 2 * buffer * MILLI, False)
    rows = running(rows.withColumn("_crossed", crossed), keys, cell, order, [Run("throttled", "last", F.col("_crossed"))])
    return rows.select(
        *orders.columns, (F.col("_level") / MILLI).alias("remaining"), F.coalesce("throttled", F.lit(False)).alias("throttled")
    )


def order_churn(
    orders: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("ts", "order_id"),
    window_ms: int = 10_000,
    max_orders: int = 20,
) -> DataFrame:
    """Add ``in_window``, the orders of the key's fixed window up to this one, and ``paused``: until the window resets."""
    keys, order = list(keys), list(order)
    window = slice_of(F.col(order[0]), window_ms)
    rows = orders.withColumn("_window", window)
    # A window of a busy account may hold any number of orders: counted in two levels by the time within it.
    rows = running(rows, [*keys, "_window"], slice_of(F.col(order[0]), max(1, window_ms // 16)), order, [Run("in_window", "sum", F.lit(1))])
    return rows.select(*orders.columns, "in_window", (F.col("in_window") > max_orders).alias("paused"))


def cooldown(
    rows: DataFrame,
    since: DataFrame,
    keys: Sequence[str],
    cooldown_ms: int,
    ts: str = "ts",
    slice_ms: int = 600_000,
    reason: str = "cooldown",
) -> DataFrame:
    """Add ``last_ts``, the last row of ``since`` (keys, ts) at or before each row, and ``reason`` as a flag.

    Serves the pause after a fill and the grace after a reconnection: the rule holds while less than ``cooldown_ms`` have passed.
    """
    keys = list(keys)
    marks = since.select(*keys, F.col(ts).alias("_t"), F.col(ts).alias("_mark"), F.lit(0).alias("_kind"))
    own = rows.withColumns({"_t": F.col(ts), "_mark": F.lit(None).cast("long"), "_kind": F.lit(1)})
    both = own.unionByName(marks, allowMissingColumns=True)
    both = running(both, keys, slice_of(F.col("_t"), slice_ms), ["_t", "_kind"], [Run("last_ts", "last", F.col("_mark"))])
    paused = F.coalesce(F.col(ts) - F.col("last_ts") < cooldown_ms, F.lit(False))
    return both.filter("_kind = 1").select(*rows.columns, "last_ts", paused.alias(reason))
