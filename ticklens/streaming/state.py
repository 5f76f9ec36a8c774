"""Keyed state for streams: thinning, hysteresis and alert rules per symbol.

Each function takes rows with ``event_time`` (see ``with_event_time``). State is a few numbers per key. Thinning and
hysteresis drop it once it can decide nothing more; the alert rules keep it, since a run of one status may go on after
any silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticklens.config import STATUS_ALERTS, AlertConfig, RankConfig
from ticklens.operators.ranking import IN, OLD, OUT, _settle


def _sorted(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = list(batches)
    return pd.concat(rows, ignore_index=True).sort_values("ts") if rows else pd.DataFrame()


def thin_stream(df: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Keep a row, then the next one at least ``gap_ms`` later: (key, ts)."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = _sorted(batches)
        last = state.get[0] if state.exists else OLD
        kept = []
        for t in pdf["ts"].tolist():
            if t - last >= gap_ms:
                last = t
                kept.append(t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({key: [k[0]] * len(kept), "ts": kept})

    return df.groupBy(key).applyInPandasWithState(
        fold, f"{key} string, ts long", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def hysteresis_stream(membership: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """ENTER and EXIT events of a membership stream (symbol, ts, member).

    A symbol that is out has no state. One that stays away has left the top k once the watermark is a dwell and an
    exit time behind its last row: its EXIT comes then, with that time.
    """
    away = cfg.min_dwell_ms + cfg.exit_ms

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            s, _, seen = state.get
            state.remove()
            if s in (IN, "PENDING_EXIT"):
                yield pd.DataFrame([(k[0], seen + away, "SYMBOL_EXIT")], columns=["symbol", "ts", "event"])
            return
        pdf = _sorted(batches)
        s, since, seen = state.get if state.exists else (OUT, OLD, OLD)
        ts, member = pdf["ts"].tolist(), pdf["member"].tolist()
        out = []
        was = s
        for i, s, since in _settle(ts, member, s, since, cfg):
            if s == IN and was not in (IN, "PENDING_EXIT"):
                out.append((k[0], ts[i], "SYMBOL_ENTER"))
            elif s == OUT and was in (IN, "PENDING_EXIT"):
                out.append((k[0], ts[i], "SYMBOL_EXIT"))
            was = s
        if s == OUT:
            state.remove()
        else:
            seen = max([seen, *ts])
            state.update((s, since, seen))
            state.setTimeoutTimestamp(max(seen + away, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ts", "event"])

    return membership.groupBy("symbol").applyInPandasWithState(
        fold, "symbol string, ts long, event string", "state string, since long, seen long", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def alert_stream(pred: DataFrame, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Alerts per symbol by stability and cooldown (symbol, ts, event).

    The cap over all symbols is applied behind it, on the few rows that come out
    (``dedupe_deliveries`` in a ``foreachBatch``).
    """
    kinds = sorted(STATUS_ALERTS.values())

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _sorted(batches)
        if state.exists:
            status, since, *last = state.get
        else:
            status, since, last = "", OLD, [OLD] * len(kinds)
        out = []
        for t, now in zip(pdf["ts"].tolist(), pdf["status"].tolist(), strict=True):
            if now != status:
                status, since = now, t
            event = STATUS_ALERTS.get(now)
            if event is None:
                continue
            held = cfg.data_issue_ms if now == "DATA_ISSUE" else cfg.stable_ms
            if t - since < held or (now == "DATA_ISSUE" and t == since):
                continue
            i = kinds.index(event)
            if t - last[i] >= cfg.cooldown_ms:
                last[i] = t
                out.append((k[0], t, event))
        state.update((status, since, *last))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ts", "event"])

    fields = ", ".join(f"last_{i} long" for i in range(len(kinds)))
    return pred.groupBy("symbol").applyInPandasWithState(
        fold, "symbol string, ts long, event string", f"status string, since long, {fields}", "append",
        GroupStateTimeout.NoTimeout,
    )
