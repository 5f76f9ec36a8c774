"""Alerts from predictions: stable status, cooldown, global cap; reused texts."""

from __future__ import annotations

import json
import math
from collections import deque
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklens.config import STATUS_ALERTS, AlertConfig
from ticklens.operators.runs import status_runs
from ticklens.operators.thin import thin_by_gap
from ticklens.plans.handoff import handoff_fold
from ticklens.plans.slices import SLICE, Run, home_rows, running, slice_of, with_slices
from ticklens.session import cut_lineage

MINUTE_MS = 60_000


def minute_counts(accepted: DataFrame, slice_ms: int) -> DataFrame:
    """Accepted rows per instant and in the closed minute that ends with it."""
    per_ts = accepted.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    rows = with_slices(per_ts, "ts", slice_ms, back_ms=MINUTE_MS)
    w = Window.partitionBy(SLICE).orderBy("ts").rangeBetween(-MINUTE_MS, 0)
    return home_rows(rows.withColumn("in_minute", F.sum("n").over(w)), "ts", slice_ms)


def candidates(pred: DataFrame, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Rows whose status can raise an alert, with the alert type and ``stable``."""
    runs = status_runs(pred, ["symbol"], slice_ms=cfg.slice_ms, materialize=True)
    kind = F.create_map(*[F.lit(x) for kv in STATUS_ALERTS.items() for x in kv])
    issue = F.col("status") == "DATA_ISSUE"
    held = F.when(
        issue, (F.col("status_ms") > 0) & (F.col("status_ms") >= cfg.data_issue_ms)
    ).otherwise(F.col("status_ms") >= cfg.stable_ms)
    return (
        runs.filter(F.col("status").isin(*STATUS_ALERTS))
        .withColumn("event", kind[F.col("status")])
        .withColumn("stable", held)
    )


class _Accepted:
    """Cap and cooldown on their way through the candidates of a slice."""

    def __init__(self, cfg: AlertConfig, state: str) -> None:
        self.cfg = cfg
        self.last = {(s, e): t for t, s, e in json.loads(state or "[]")}
        self.recent = deque(sorted(self.last.values()))

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        cfg, last, recent, got = self.cfg, self.last, self.recent, []
        for t, s, e in zip(rows["ts"].tolist(), rows["symbol"], rows["event"], strict=True):
            while recent and recent[0] < t - MINUTE_MS:
                recent.popleft()
            if len(recent) >= cfg.max_per_min or t - last.get((s, e), -(2**62)) < cfg.cooldown_ms:
                continue
            last[(s, e)] = t
            recent.append(t)
            got.append((t, s, e))
        return pd.DataFrame(got, columns=["ts", "symbol", "event"])

    def state(self, end_ms: int) -> str:
        keep = max(self.cfg.cooldown_ms, MINUTE_MS + 1)
        live = sorted(([t, s, e] for (s, e), t in self.last.items() if t > end_ms - keep), key=json.dumps)
        return json.dumps(live) if live else ""


def accept(
    stable: DataFrame, cfg: AlertConfig = AlertConfig(), materialized: bool = False
) -> DataFrame:
    """(ts, symbol, event) of the alerts that pass the cap and the cooldown.

    Without the global cap this is thinning per (symbol, event), in parallel. If no
    minute then holds more than the cap, the cap never binds and that is the
    result. Otherwise the sequential rule runs as a handoff fold.
    """
    slim = stable.select("ts", "symbol", "event")
    slim = slim if materialized else cut_lineage(slim)
    free = thin_by_gap(slim, ["symbol", "event"], "ts", cfg.cooldown_ms)
    over = minute_counts(free, cfg.slice_ms).filter(F.col("in_minute") > cfg.max_per_min)
    if over.isEmpty():
        return free

    if cfg.cooldown_ms < MINUTE_MS:
        raise ValueError("the cooldown must cover the cap window")
    # At most ``cap`` pairs a minute start to cool down, so of an instant's candidates, in their order, no
    # more than that many times the minutes of a cooldown can be passed over before the cap is reached.
    enough = cfg.max_per_min * (math.ceil(cfg.cooldown_ms / MINUTE_MS) + 2)
    place = F.dense_rank().over(Window.partitionBy("ts").orderBy("symbol", "event"))
    slim = slim.withColumn("_n", place).filter(F.col("_n") <= enough).drop("_n")
    warm = max(cfg.cooldown_ms, MINUTE_MS) + MINUTE_MS
    return handoff_fold(slim, cfg.slice_ms, warm, partial(_Accepted, cfg), slim.schema, slice_rows=cfg.slice_rows)


def alert_decisions(
    pred: DataFrame, cfg: AlertConfig = AlertConfig(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Decision log: generated, stability, rate_limit or cooldown for each candidate.

    The order of the checks is stability, cap, cooldown; a global tie goes by symbol.
    """
    rows = cut_lineage(candidates(pred, cfg))  # read several times below
    taken = accept(rows.filter("stable"), cfg, True).withColumn("taken", F.lit(True))
    # What the cap sees: the minute before the instant, and the accepted symbols of the
    # instant itself (never more than the cap).
    names = taken.groupBy("ts").agg(F.collect_set("symbol").alias("names"))
    rows = rows.join(taken, ["ts", "symbol", "event"], "left")
    stamps = rows.groupBy("ts").agg(F.count("taken").alias("n"))
    near = with_slices(stamps, "ts", cfg.slice_ms, back_ms=MINUTE_MS)
    w = Window.partitionBy(SLICE).orderBy("ts").rangeBetween(-MINUTE_MS, -1)
    near = home_rows(near.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))), "ts", cfg.slice_ms)
    near = near.join(names, "ts", "left").select("ts", "before", "names")
    ahead = F.coalesce(F.size(F.filter("names", lambda x: x < F.col("symbol"))), F.lit(0))
    ahead = F.when(F.col("names").isNull(), 0).otherwise(ahead)
    decision = (
        F.when(F.col("taken"), "generated")
        .when(~F.col("stable") & (F.col("status") != "DATA_ISSUE"), "stability")
        .when(~F.col("stable"), None)
        .when(F.col("before") + ahead >= cfg.max_per_min, "rate_limit")
        .otherwise("cooldown")
    )
    out = rows.join(near, "ts", "left").withColumn("decision", decision)
    return out.filter(F.col("decision").isNotNull()).select(
        "ts", "symbol", "status", "event", "status_since", "decision", *keep
    )


def alert_metrics(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def cached_text(alerts: DataFrame, text: str = "text", cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Replace ``text`` by the symbol's last text made, which is renewed every 60 s."""
    alerts = cut_lineage(alerts)  # few rows, read twice
    made = thin_by_gap(alerts.select("symbol", "ts"), ["symbol"], "ts", cfg.text_cooldown_ms)
    rows = alerts.join(made.distinct().withColumn("made", F.lit(True)), ["symbol", "ts"], "left")
    run = Run("cached", "last", F.when(F.col("made"), F.col(text)))
    order = ["ts", "event"] if "event" in alerts.columns else ["ts"]
    out = running(rows, ["symbol"], slice_of(F.col("ts"), cfg.slice_ms), order, [run])
    return out.select(
        *[c for c in alerts.columns if c != text],
        F.col("cached").alias(text),
        F.coalesce("made", F.lit(False)).alias("fresh"),
    )
