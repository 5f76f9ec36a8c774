"""Sequential rules against a plain loop, over many slice lengths."""

import random
from collections import deque
from dataclasses import replace
from decimal import Decimal

import pytest

from ticklens.config import STATUS_ALERTS, AlertConfig, DeliveryConfig, RankConfig
from ticklens.operators import alerts, delivery, ledger, ranking
from ticklens.operators.thin import thin_by_gap
from ticklens.plans.handoff import row_slices


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("slice_ms", [700, 5_000, 10_000_000])
def test_thinning(spark, slice_ms):
    rng = random.Random(slice_ms)
    rows = [("hot", t) for t in sorted(rng.sample(range(20_000), 900))]
    rows += [("cold", t) for t in range(0, 20_000, 999)] + [("hot", 5_000)] * 3
    want = []
    for key in ("hot", "cold"):
        last = None
        for t in sorted({t for k, t in rows if k == key}):
            if last is None or t - last >= 400:
                last = t
                want.append((key, t))
    df = spark.createDataFrame(rows, "k string, ts long").dropDuplicates()
    assert rows_of(thin_by_gap(df, ["k"], "ts", 400, slice_ms=slice_ms), "k", "ts") == sorted(want)


def loop_hysteresis(rows, cfg, absent=False):
    """rows: (ts, symbol, score) -> rank events as the sequential rule gives them; ``absent`` symbols go on with score 0."""
    st, top, out = {}, [], []
    for ts in sorted({r[0] for r in rows}):
        now = {s: x for t, s, x in rows if t == ts}
        ranked = [s for x, s in sorted((-x, s) for s, x in now.items() if x >= cfg.score_threshold)]
        best, events = set(ranked[: cfg.top_k]), []
        for s in {*now, *st} if absent else now:
            q = st.setdefault(s, {"s": "out", "t": ts, "rank": -1})
            inside, age = s in best, ts - q["t"]
            new = q["s"]
            if q["s"] == "out" and inside:
                new = "entering" if cfg.enter_ms else "in"
            elif q["s"] == "entering":
                new = "out" if not inside else ("in" if age >= cfg.enter_ms else "entering")
            elif q["s"] == "in" and not inside and age >= cfg.min_dwell_ms:
                new = "leaving" if cfg.exit_ms else "out"
            elif q["s"] == "leaving":
                new = "in" if inside else ("out" if age >= cfg.exit_ms else "leaving")
            if new == "in" and q["s"] in ("out", "entering"):
                events.append((ts, "SYMBOL_ENTER", s, top.index(s) if s in top else 0))
            if new == "out" and q["s"] in ("in", "leaving"):
                events.append((ts, "SYMBOL_EXIT", s, max(q["rank"], 0)))
            if new != q["s"]:
                q["s"], q["t"] = new, ts
        top = [s for s in ranked if st[s]["s"] != "out"][: cfg.top_k]
        for i, s in enumerate(top):
            st[s]["rank"] = i
        out += events
    return sorted(out)


@pytest.mark.parametrize("slice_ms", [3_000, 17_000, 10_000_000])
@pytest.mark.parametrize("limits", [{}, {"enter_ms": 0, "exit_ms": 0, "min_dwell_ms": 0}])
def test_hysteresis(spark, slice_ms, limits):
    rng = random.Random(7)
    rows = []
    for t in range(1_000, 61_000, 1_000):
        for s in "abcdefg":
            rows.append((t, s, round(0.5 + 0.5 * rng.random() * ((t // 9_000 + ord(s)) % 3) - 0.3, 3)))
    cfg = replace(RankConfig(top_k=2, score_threshold=0.4, slice_ms=slice_ms), **limits)
    df = spark.createDataFrame(rows, "ts long, symbol string, score double")
    got = ranking.rank_events(ranking.ranked_states(df, cfg))
    want = loop_hysteresis(rows, cfg)
    assert want and rows_of(got, "ts", "event", "symbol", "rank") == want


def loop_alerts(rows, cfg):
    st, recent, out = {}, deque(), []
    for t, s, x in sorted(rows):
        q = st.setdefault(s, {"x": None, "t": 0, "last": {}})
        if q["x"] != x:
            q["x"], q["t"] = x, t
        event = STATUS_ALERTS.get(x)
        age = t - q["t"]
        if event is None or (x == "DATA_ISSUE" and (age == 0 or age < cfg.data_issue_ms)):
            continue
        if x != "DATA_ISSUE" and age < cfg.stable_ms:
            out.append((t, s, event, "stability"))
            continue
        while recent and recent[0] < t - 60_000:
            recent.popleft()
        if len(recent) >= cfg.max_per_min:
            said = "rate_limit"
        elif t - q["last"].get(event, -(10**9)) < cfg.cooldown_ms:
            said = "cooldown"
        else:
            said, q["last"][event] = "generated", t
            recent.append(t)
        out.append((t, s, event, said))
    return sorted(out)


@pytest.mark.parametrize("cap,slice_ms,slice_rows", [(3, 50_000, 10**6), (3, 10_000_000, 10**6), (1_000, 50_000, 10**6), (3, 10_000_000, 40)])
def test_alert_decisions(spark, cap, slice_ms, slice_rows):
    rng = random.Random(cap)
    rows, now = [], {}
    for t in range(1_000, 301_000, 1_000):
        for s in "abcdefgh":
            if rng.random() < 0.12:
                now[s] = rng.choice(["TRADEABLE", "TRAP", "DATA_ISSUE", "WATCH", "DEAD"])
            rows.append((t, s, now.get(s, "DEAD")))
    cfg = AlertConfig(max_per_min=cap, slice_ms=slice_ms, slice_rows=slice_rows)
    df = spark.createDataFrame(rows, "ts long, symbol string, status string")
    got = alerts.alert_decisions(df, cfg)
    assert rows_of(got, "ts", "symbol", "event", "decision") == loop_alerts(rows, cfg)


@pytest.mark.parametrize("slice_ms,slice_rows", [(70_000, 10**6), (10_000_000, 10**6), (10_000_000, 25)])
def test_deliveries(spark, slice_ms, slice_rows):
    rng = random.Random(3)
    cfg = DeliveryConfig(max_per_min=4, slice_ms=slice_ms, slice_rows=slice_rows)
    rows = sorted(
        {
            (rng.randrange(600_000), rng.choice("abcdef"), rng.choice("XYZ"), rng.choice(["", "TRAP", "WATCH"]))
            for _ in range(400)
        }
    )
    last, status, recent, want = {}, {}, deque(), []
    for t, s, e, x in rows:
        while recent and recent[0] < t - 60_000:
            recent.popleft()
        if len(recent) >= 4:
            said = "rate_limit"
        elif t - last.get((s, e), -(10**9)) < cfg.cooldown_ms:
            said = "cooldown"
        elif x and status.get(s) == x:
            said = "duplicate"
        else:
            said, last[s, e] = "passed", t
            recent.append(t)
            status[s] = x or status.get(s)
        want.append((t, s, e, said))
    df = spark.createDataFrame(rows, "ts long, symbol string, event string, status string")
    got = delivery.dedupe_deliveries(df, cfg)
    assert rows_of(got, "ts", "symbol", "event", "decision") == sorted(want)


@pytest.mark.parametrize("keep", [False, True])
def test_position_ledger_in_stretches(spark, keep):
    rng = random.Random(11)
    rows = [
        ("s", "hot", i * 1_000, i, 1, rng.choice(["BUY", "SELL"]), Decimal(rng.randrange(1, 5)), Decimal(rng.randrange(90, 110)))
        for i in range(300)
    ]
    schema = (
        "session_id string, symbol string, ts long, order_id long, trade_id long, side string, "
        "fill_qty decimal(20,4), fill_price decimal(20,4)"
    )
    qty = entry = Decimal(0)
    want = []
    for *_, i, _, side, q, p in rows:
        d = q if side == "BUY" else -q
        pnl = Decimal(0)
        if qty * d < 0:
            closed = min(q, abs(qty))
            pnl = closed * (p - entry) if qty > 0 else closed * (entry - p)
        new = qty + d
        if new == 0:
            entry = Decimal(0)
        elif qty == 0:
            entry = p
        elif abs(new) > abs(qty) and (new > 0) == (qty > 0):
            entry = (abs(qty) * entry + q * p) / abs(new)
        elif (new > 0) != (qty > 0) and not keep:
            entry = p
        qty = new
        want.append((i, float(qty), round(float(entry), 6), round(float(pnl), 6)))
    df = spark.createDataFrame(rows, schema)
    got = ledger.position_ledger(df, stretch=7, keep_entry_on_flip=keep).collect()
    have = [(r.order_id, float(r.position_qty), round(float(r.entry_price), 6), round(float(r.realized_pnl), 6)) for r in got]
    assert sorted(have) == want


def test_first_touch_in_small_slices(spark):
    rng = random.Random(5)
    trades = [("s", rng.randrange(5_000), i, float(rng.randrange(95, 106))) for i in range(800)]
    orders = [
        ("s", i, rng.randrange(5_000), 1_000 + i, rng.choice(["BUY", "SELL"]), float(rng.randrange(92, 109)))
        for i in range(200)
    ]
    want = []
    for _, oid, ts, seq, side, price in orders:
        hits = [
            t
            for _, t, q, p in trades
            if (t, q) > (ts, seq if t == ts else -1) and t <= ts + 300 and (p <= price if side == "BUY" else p >= price)
            and (t > ts or q > seq)
        ]
        want.append((oid, min(hits) if hits else None))
    o = spark.createDataFrame(orders, "symbol string, order_id long, ts long, seq long, side string, price double")
    t = spark.createDataFrame(trades, "symbol string, ts long, seq long, price double")
    got = ledger.first_touch_fills(o, t, 300, slice_ms=450)
    assert sorted((r.order_id, r.fill_ts) for r in got.collect()) == want


@pytest.mark.parametrize("slice_ms", [300_000, 3_600_000])
def test_deliveries_remember_null_symbols(spark, slice_ms):
    rows = spark.createDataFrame([(t, None, "X", "TRAP") for t in (0, 700_000, 1_400_000)], "ts long, symbol string, event string, status string")
    got = delivery.dedupe_deliveries(rows, DeliveryConfig(slice_ms=slice_ms))
    assert rows_of(got, "ts", "decision") == [(0, "passed"), (700_000, "duplicate"), (1_400_000, "duplicate")]


@pytest.mark.parametrize("times", [1, 10])
def test_slices_are_bounded_by_rows(spark, times):
    """Ten times the rows in the same span of time: more slices, none longer."""
    rng = random.Random(times)
    rows = spark.createDataFrame([(rng.randrange(60_000),) for _ in range(500 * times)], "ts long")
    own, cuts = row_slices(rows, 3_600_000, 100, 10_000)
    sizes = [r["count"] for r in own.groupBy("slice").count().collect()]
    assert sum(sizes) == 500 * times and len(sizes) >= 3 * times
    second = max(r["count"] for r in rows.groupBy((rows.ts / 1_000).cast("int")).count().collect())
    assert max(sizes) < 100 + second
    spans = sorted((r["_start"], r["_end"]) for r in cuts.collect())
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(0 <= r["_upto"] - r["slice"] <= 4 for r in own.collect())
