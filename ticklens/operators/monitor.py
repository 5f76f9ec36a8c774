"""Monitoring over a metrics table (ts, instance, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.operators.runs import status_runs
from ticklens.plans.slices import SLICE, Run, home_rows, running, slice_of, with_slices

KEYS = ["instance", "metric"]
DEFAULT_SLICE_MS = 600_000


def counter_growth(m: DataFrame, slice_ms: int = DEFAULT_SLICE_MS) -> DataFrame:
    """Add ``growth``: positive change since the sample before; a reset adds nothing."""
    run = Run("_was", "last", F.col("value"), inclusive=False)
    rows = running(m, KEYS, slice_of(F.col("ts"), slice_ms), ["ts"], [run])
    grown = F.greatest(F.col("value") - F.col("_was"), F.lit(0.0))
    return rows.withColumn("growth", F.coalesce(grown, F.lit(0.0))).drop("_was")


def counter_increase(m: DataFrame, window_ms: int, slice_ms: int | None = None) -> DataFrame:
    """Add ``increase`` over ``(t - window, t]``.

    A slice is as long as the window, so the frame is the difference of two growing
    sums over the own slice and the one before.
    """
    slice_ms = window_ms if slice_ms is None else slice_ms
    rows = with_slices(counter_growth(m, slice_ms), "ts", slice_ms, back_ms=window_ms - 1)
    w = Window.partitionBy(*KEYS, SLICE).orderBy("ts")
    upto = F.sum("growth").over(w.rangeBetween(Window.unboundedPreceding, 0))
    gone = F.sum("growth").over(w.rangeBetween(Window.unboundedPreceding, -window_ms))
    rows = rows.withColumn("increase", upto - F.coalesce(gone, F.lit(0.0)))
    return home_rows(rows, "ts", slice_ms)


def counter_rate(m: DataFrame, window_ms: int) -> DataFrame:
    """Add ``rate`` per second."""
    return counter_increase(m, window_ms).withColumn("rate", F.col("increase") / (window_ms / 1000))


def ratio_breach(
    m: DataFrame,
    num: str,
    den: str,
    limit: float,
    for_ms: int,
    floor: float = 1.0,
    slice_ms: int = DEFAULT_SLICE_MS,
) -> DataFrame:
    """Samples where ``num / max(den, floor) >= limit`` has held for ``for_ms``."""
    wide = m.filter(F.col("metric").isin(num, den)).groupBy("instance", "ts").agg(
        F.max(F.when(F.col("metric") == num, F.col("value"))).alias("num"),
        F.max(F.when(F.col("metric") == den, F.col("value"))).alias("den"),
    )
    ratio = F.col("num") / F.greatest(F.col("den"), F.lit(floor))
    wide = wide.withColumn("ratio", ratio).withColumn("over", F.coalesce(ratio >= limit, F.lit(False)))
    rows = status_runs(wide, ["instance"], "ts", "over", slice_ms)
    return rows.filter(F.col("over") & (F.col("status_ms") >= for_ms)).drop("over")


def max_rate_per_min(samples: DataFrame, by: Sequence[str], horizon_ms: int = 60_000) -> DataFrame:
    """Largest per-minute rate from each sample to the first one a minute or more later.

    ``samples``: by, ts, count (cumulative).
    """
    from ticklens.operators.asof import asof_join

    later = samples.select(*by, "ts", F.col("count").alias("later_count"))
    asked = samples.select(*by, (F.col("ts") + horizon_ms).alias("ts"), "count")
    rows = asof_join(asked, later, by, "hit", direction="forward")
    span = (F.col("hit.ts") - F.col("ts") + horizon_ms) / 60000.0
    rate = (F.col("hit.later_count") - F.col("count")) / span
    return rows.groupBy(*by).agg(F.greatest(F.max(rate), F.lit(0.0)).alias("max_rate_per_min"))


def check_thresholds(summary: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per rule: field, kind (max/min), limit, value, result OK / FAIL / MISSING.

    ``summary``: one row per run with metric columns, and any id columns.
    """
    have = set(summary.columns)
    rules = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.lit(kind).alias("kind"),
                F.lit(float(limit)).alias("limit"),
                (F.col(f).cast("double") if f in have else F.lit(None).cast("double")).alias("value"),
            )
            for f, (kind, limit) in limits.items()
        ]
    )
    ids = [c for c in summary.columns if c not in limits]
    rows = summary.select(*ids, F.inline(rules))
    bad = F.when(F.col("kind") == "max", F.col("value") > F.col("limit")).otherwise(
        F.col("value") < F.col("limit")
    )
    result = F.when(F.col("value").isNull(), "MISSING").when(bad, "FAIL").otherwise("OK")
    return rows.withColumn("result", result)


def run_summary(ev: DataFrame, snaps: DataFrame, preds: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per run: events, rate, latency, and rows per stage. Needs ``run_id`` everywhere."""
    lat = F.greatest(F.lit(0), F.col("recv_ts") - F.col("ts"))
    base = ev.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("market_events"),
        F.avg(lat).alias("avg_latency_ms"),
        F.max(lat).alias("max_latency_ms"),
        F.min("ts").alias("start_ts"),
    )
    n = lambda df, name: df.groupBy("run_id").agg(
        F.count(F.lit(1)).alias(name), F.max("ts").alias(f"{name}_ts")
    )
    out = base
    for df, name in ((snaps, "snapshots"), (preds, "predictions"), (alerts, "alerts")):
        out = out.join(n(df, name), "run_id", "left")
    seconds = (F.col("snapshots_ts") - F.col("start_ts")) / 1000
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "run_id",
        "market_events",
        F.when(seconds > 0, F.col("market_events") / seconds).otherwise(0.0).alias("events_per_second"),
        count("snapshots"),
        count("predictions"),
        count("alerts"),
        "avg_latency_ms",
        "max_latency_ms",
    )


def readiness(snaps: DataFrame, now_ms: int | Column, stale_ms: int = 30_000) -> DataFrame:
    """One row: last_ts, age, ready."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    last = snaps.agg(F.max("ts").alias("last_ts"))
    age = now - F.col("last_ts")
    return last.select(
        "last_ts", age.alias("age_ms"), F.coalesce(age <= stale_ms, F.lit(False)).alias("ready")
    )
