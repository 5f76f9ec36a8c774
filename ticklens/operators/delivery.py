"""Which rank events are delivered, and the messages they become."""

from __future__ import annotations

import json
from collections import deque
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.config import DeliveryConfig
from ticklens.functions.text import format_event, utc_text
from ticklens.plans.handoff import WAS, Memory, handoff_fold
from ticklens.session import cut_lineage

MINUTE_MS = 60_000


def rank_bucket(rank: Column) -> Column:
    return F.when(rank < 5, "top5").when(rank < 10, "top10").otherwise("other")


def stable_key(symbol: Column, event: Column, status: Column, rank: Column) -> Column:
    status = F.coalesce(status, F.lit("UNKNOWN"))
    return F.concat_ws(":", symbol, event, status, rank_bucket(rank))


class _Deliveries:
    """Cap, cooldown and status memory on their way through the events of a slice."""

    def __init__(self, cfg: DeliveryConfig, state: str) -> None:
        self.cfg = cfg
        self.last = {(s, e): t for t, s, e in json.loads(state or "[]")}
        self.recent = deque(sorted(self.last.values()))
        self.status: dict[str | None, str] = {}  # sent in this slice

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        cfg, last, recent, status = self.cfg, self.last, self.recent, self.status
        said = []
        for t, s, e, now, was in zip(rows["ts"].tolist(), rows["symbol"], rows["event"], rows["status"], rows[WAS], strict=True):
            while recent and recent[0] < t - MINUTE_MS:
                recent.popleft()
            if len(recent) >= cfg.max_per_min:
                said.append("rate_limit")
            elif t - last.get((s, e), -(2**62)) < cfg.cooldown_ms:
                said.append("cooldown")
            elif cfg.transition_only and now and status.get(s, was) == now:
                said.append("duplicate")
            else:
                if now and cfg.transition_only:
                    status[s] = now
                last[(s, e)] = t
                recent.append(t)
                said.append("passed")
        return rows.assign(decision=said)

    def state(self, end_ms: int) -> str:
        keep = max(self.cfg.cooldown_ms, MINUTE_MS + 1)
        live = sorted(([t, s, e] for (s, e), t in self.last.items() if t > end_ms - keep), key=json.dumps)
        return json.dumps(live) if live else ""


def dedupe_deliveries(events: DataFrame, cfg: DeliveryConfig = DeliveryConfig()) -> DataFrame:
    """Every event with its decision: passed, rate_limit, cooldown or duplicate.

    ``events``: ts, symbol, event, status (null or '' without a prediction). The cap
    and the status memory make the rule sequential over a universe; it runs as a
    handoff fold over the events, on event time. The state holds what is inside the
    cooldown or the minute; the last status sent of each symbol is the fold's memory.

    A symbol that an instant passes over for its cooldown or its status was sent before, and the cap bounds
    how many were by then. So behind that many symbols of an instant and the cap itself, the cap is reached:
    such events are rate_limit whatever happened, and stay out of the fold.
    """
    if cfg.cooldown_ms < MINUTE_MS:
        raise ValueError("the cooldown must cover the cap window")
    slim = cut_lineage(events.select("ts", "symbol", "event", F.coalesce("status", F.lit("")).alias("status")))
    first = slim.agg(F.min("ts")).first()[0]
    sent = cfg.max_per_min * (F.floor((F.col("ts") - F.lit(first).cast("long")) / (MINUTE_MS + 1)) + 1)
    place = F.dense_rank().over(Window.partitionBy("ts").orderBy(F.asc_nulls_last("symbol")))
    placed = cut_lineage(slim.withColumn("_beyond", place > sent + cfg.max_per_min))
    open_ = placed.filter("NOT _beyond").drop("_beyond")
    out = T.StructType([*slim.schema.fields, T.StructField("decision", T.StringType())])
    status = F.when(F.col("status") != "", F.col("status"))
    memory = Memory("symbol", status, F.when(F.col("decision") == "passed", status), ("ts", "event"))
    fold = partial(_Deliveries, cfg)
    order = ("ts", "symbol", "event", "status")
    said = handoff_fold(open_, cfg.slice_ms, cfg.cooldown_ms + MINUTE_MS, fold, out, memory, cfg.slice_rows, order)
    return said.unionByName(placed.filter("_beyond").drop("_beyond").withColumn("decision", F.lit("rate_limit")))


def delivery_metrics(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def messages(events: DataFrame, dashboard_url: str = "") -> DataFrame:
    """One message per event in the three formats."""
    kinds = ("text", "html", "markdown")
    return events.select("*", *[format_event(k, dashboard_url=dashboard_url).alias(k) for k in kinds])


def format_digest(events: DataFrame, batch: str, dashboard_url: str = "") -> DataFrame:
    """Several events in one message per ``batch``, under a header with their number.

    A batch is what one delivery sends: the rows that passed the cap.
    """
    rows = messages(events, dashboard_url)
    parts = F.sort_array(F.collect_list(F.struct("ts", "symbol", "event", "text", "html", "markdown")))
    got = rows.groupBy(batch).agg(parts.alias("parts"))
    n = F.size("parts")
    head = F.concat(
        F.lit("=== "),
        n.cast("string"),
        F.lit(" Alerts ("),
        utc_text(F.get("parts", F.lit(0))["ts"]),
        F.lit(") ==="),
    )
    marks = {"text": ("", ""), "html": ("<b>", "</b>"), "markdown": ("*", "*")}
    out = []
    for kind, (a, b) in marks.items():
        body = F.array_join(F.col(f"parts.{kind}"), "\n\n")
        many = F.concat(F.lit(a), head, F.lit(b + "\n\n"), body)
        out.append(F.when(n == 1, body).otherwise(F.rtrim(many)).alias(kind))
    return got.select(batch, n.alias("n"), *out)
