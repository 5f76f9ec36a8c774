"""Routing of events: filters, staleness, late rows, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.plans.slices import Run, running, slice_of


def filter_symbols(ev: DataFrame, universe: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows of known symbols, and the dropped ones. ``None`` keeps all."""
    if universe is None:
        return ev, ev.limit(0)
    names = universe.select("symbol").distinct()
    return ev.join(names, "symbol", "left_semi"), ev.join(names, "symbol", "left_anti")


def stale(now: Column, ts: Column, threshold_ms: int = 5_000) -> Column:
    return now - ts > threshold_ms


def flag_stale(
    ev: DataFrame, threshold_ms: int = 5_000, drop: bool = False, now: str = "recv_ts"
) -> DataFrame:
    out = ev.withColumn("stale", stale(F.col(now), F.col("ts"), threshold_ms))
    return out.filter(~F.col("stale")) if drop else out


def event_latency() -> Column:
    return F.greatest(F.lit(0), F.col("recv_ts") - F.col("ts"))


def flag_late(ev: DataFrame, slice_ms: int = 600_000, late_ms: int = 0) -> DataFrame:
    """Add ``late``: an earlier arrival of the symbol had a larger ts (by more than ``late_ms``)."""
    run = Run("_seen", "max", F.col("ts"), inclusive=False)
    rows = running(ev, ["symbol"], slice_of(F.col("recv_ts"), slice_ms), ["recv_ts", "seq"], [run])
    late = F.coalesce(F.col("_seen") - F.col("ts") > late_ms, F.lit(False))
    return rows.withColumn("late", late).drop("_seen")


def late_events(ev: DataFrame, slice_ms: int = 600_000) -> DataFrame:
    return flag_late(ev, slice_ms).filter("late")


def router_metrics(
    ev: DataFrame,
    universe: DataFrame | None = None,
    threshold_ms: int = 5_000,
    drop_stale: bool = False,
    now: str = "recv_ts",
) -> DataFrame:
    """One row of routing metrics. Late rows are judged among the routed ones only."""
    known, unknown = filter_symbols(ev, universe)
    flagged = flag_stale(known, threshold_ms, now=now)
    kept = flagged.filter(~F.col("stale")) if drop_stale else flagged
    rows = flag_late(kept.withColumn("dropped", F.lit(False)))
    cols = ["symbol", "ts", "recv_ts", "stale", "late", "dropped", "unknown"]
    rows = rows.withColumn("unknown", F.lit(False)).select(*cols)
    no = F.lit(False)
    if drop_stale:
        gone = flagged.filter("stale").withColumns({"late": no, "dropped": F.lit(True), "unknown": no})
        rows = rows.unionByName(gone.select(*cols))
    if universe is not None:
        out = unknown.withColumns({"stale": no, "late": no, "dropped": F.lit(True), "unknown": F.lit(True)})
        rows = rows.unionByName(out.select(*cols))
    return summarize(partial_metrics(rows))


def partial_metrics(rows: DataFrame) -> DataFrame:
    """Mergeable sums per symbol: what two routers would add up."""
    lat = F.when(~F.col("unknown"), event_latency())
    n = F.count(F.lit(1))
    return rows.groupBy("symbol").agg(
        n.alias("received"),
        F.count_if(~F.col("dropped")).alias("routed"),
        F.count_if("dropped").alias("dropped"),
        F.coalesce(F.sum(F.when(lat > 0, lat)), F.lit(0)).alias("latency_sum"),
        F.count_if(lat > 0).alias("latency_n"),
        F.coalesce(F.max(lat), F.lit(0)).alias("latency_max"),
        F.count_if("stale").alias("stale"),
        F.count_if("late").alias("late"),
        F.count_if("unknown").alias("unknown"),
    )


def merge_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two partial metric tables as one."""
    sums = [c for c in a.columns if c not in ("symbol", "latency_max")]
    return (
        a.unionByName(b)
        .groupBy("symbol")
        .agg(*[F.sum(c).alias(c) for c in sums], F.max("latency_max").alias("latency_max"))
    )


def summarize(partial: DataFrame) -> DataFrame:
    total = partial.agg(
        F.sum("received").alias("events_received"),
        F.sum("routed").alias("events_routed"),
        F.sum("dropped").alias("events_dropped"),
        F.sum("latency_sum").alias("s"),
        F.sum("latency_n").alias("k"),
        F.max("latency_max").alias("max_latency_ms"),
        F.sum("stale").alias("stale_events"),
        F.sum("late").alias("late_events"),
        F.sum("unknown").alias("unknown_symbols"),
        F.count_if(F.col("received") > F.col("unknown")).alias("symbol_count"),
    )
    share = lambda c: F.when(
        F.col("events_received") > 0, F.col(c) / F.col("events_received")
    ).otherwise(0.0)
    return total.select(
        "*",
        F.when(F.col("k") > 0, F.col("s") / F.col("k")).otherwise(0.0).alias("avg_latency_ms"),
        share("events_dropped").alias("drop_rate"),
        share("stale_events").alias("stale_rate"),
    ).drop("s", "k")


def events_per_symbol(ev: DataFrame) -> DataFrame:
    return ev.groupBy("symbol").agg(F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("last_ts"))


def order_events(ev: DataFrame) -> DataFrame:
    """Total order (ts, recv_ts, seq): a range-partitioned sort."""
    return ev.orderBy("ts", "recv_ts", "seq")
