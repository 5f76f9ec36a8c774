"""Rolling features and the replay chain against a plain loop over the events."""

import random

import pytest
from pyspark.sql import functions as F

from ticklens.operators import rolling
from ticklens.operators.rolling import feature_columns, limit_symbols, rolling_columns
from ticklens.operators.thin import snapshot_ticks
from ticklens.plans.replay import REPLAY_ORDER, ChainConfig, replay

COLS = "symbol ts recv_ts seq is_trade price qty is_buyer_maker bid ask bid_qty ask_qty".split()
SCHEMA = (
    "symbol string, ts long, recv_ts long, seq long, is_trade boolean, price double, qty double, "
    "is_buyer_maker boolean, bid double, ask double, bid_qty double, ask_qty double"
)


def random_tape(seed, n=500, span=900_000, symbols="AB"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = rng.randrange(span) // 50 * 50  # many equal instants
        head = (rng.choice(symbols), ts, ts + rng.randrange(3), i)
        if rng.random() < 0.7:
            rows.append((*head, True, 100.0 + rng.randrange(20), float(rng.randrange(1, 9)), rng.random() < 0.5, *[None] * 4))
        else:
            mid = 100 + rng.randrange(20)
            rows.append((*head, False, None, None, None, mid - 1.0, mid + 1.0, float(rng.randrange(1, 9)), float(rng.randrange(1, 9))))
    return rows


def loop_features(seen, t):
    """Features at t from the events seen so far, in order."""
    trades = [e for e in seen if e[4]]
    books = [e for e in seen if not e[4]]
    win = lambda w: [e for e in trades if t - w < e[1] <= t]
    out = {}
    b = books[-1] if books else None
    out["spread_bps"] = (b[9] - b[8]) / ((b[8] + b[9]) / 2) * 10000 if b else 0.0
    out["mid"] = (b[8] + b[9]) / 2 if b else 1.0
    ten, five = win(10_000), [e[5] for e in win(300_000)]
    buy, sell = sum(e[6] for e in ten if not e[7]), sum(e[6] for e in ten if e[7])
    out["flow_imbalance"] = (buy - sell) / (buy + sell) if ten else 0.0
    out["natr_14_5m"] = (max(five) - min(five)) / (sum(five) / len(five)) if len(five) > 1 else 0.0
    turns = sum((five[i] - five[i - 1]) * (five[i - 1] - five[i - 2]) < 0 for i in range(2, len(five)))
    trend = len(five) >= 10 and turns / (len(five) - 1) < 0.3
    out["regime_trend"] = "trend" if trend else "chop"
    out["n"], out["turns"] = len(five), turns
    out["w60"] = sum(e[6] for e in win(60_000))
    out["stale_book_ms"] = t - b[1] if b else 0
    out["stale_trades_ms"] = t - trades[-1][1] if trades else 0
    return out


def check(got, want):
    assert {(r["symbol"], r["ts"]) for r in got} == set(want)
    for r in got:
        w = want[r["symbol"], r["ts"]]
        assert r["n_range"] == w["n"] and r["turns_range"] == w["turns"], (r["symbol"], r["ts"])
        for c in ("spread_bps", "mid", "flow_imbalance", "natr_14_5m"):
            assert r[c] == pytest.approx(w[c], abs=1e-12)
        assert r["w60s"]["volume"] == w["w60"]
        for c in ("regime_trend", "stale_book_ms", "stale_trades_ms"):
            assert r[c] == w[c]


def collect(roll):
    roll = roll.select("symbol", "ts", "n_range", "turns_range").join(feature_columns(roll), ["symbol", "ts"])
    return [r.asDict(recursive=True) for r in roll.collect()]


@pytest.mark.parametrize("span", [40_000, 900_000])
def test_grid_features(spark, span):
    rows = sorted(random_tape(span, span=span), key=lambda e: (e[1], e[3]))
    end = -(-max(e[1] for e in rows) // 1_000) * 1_000
    want = {}
    for s in "AB":
        own = [e for e in rows if e[0] == s]
        for t in range(-(-own[0][1] // 1_000) * 1_000, end + 1, 1_000):
            want[s, t] = loop_features([e for e in own if e[1] <= t], t)
    check(collect(rolling_columns(spark.createDataFrame(rows, SCHEMA))), want)


def test_data_ticks_see_only_what_came_before(spark):
    rows = sorted(random_tape(1, span=60_000), key=lambda e: (e[1], e[2], e[3]))
    want, last, known = {}, 0, []
    for i, e in enumerate(rows):
        if e[0] not in known:
            known.append(e[0])
        if e[1] - last >= 1_000 or i == 0:
            last = e[1]
            for s in known:
                want[s, last] = loop_features([x for x in rows[: i + 1] if x[0] == s], last)
    tape = spark.createDataFrame(rows, SCHEMA)
    ticks, cut = snapshot_ticks(tape)
    check(collect(rolling_columns(tape, ticks=ticks, cut=cut, order=REPLAY_ORDER)), want)


def test_shuffled_input_gives_the_same_rows(spark):
    rows = random_tape(2, span=50_000)
    a = rolling_columns(spark.createDataFrame(rows, SCHEMA))
    b = rolling_columns(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_replay_raises_one_alert(spark):
    """A steady climb with buys only: tradeable after two seconds, once."""
    rows, seq = [], 0
    for t in range(1_000_000, 1_006_000, 200):
        px = 100.0 + (t - 1_000_000) / 2_000
        rows.append(("UP", t, t, seq, True, px, 1.0, seq % 7 == 3, *[None] * 4))
        rows.append(("UP", t, t, seq + 1, False, None, None, None, px - 0.001, px + 0.001, 60.0, 40.0))
        seq += 2
    out = replay(spark.createDataFrame(rows, SCHEMA), ChainConfig(data_ticks=True)).collect()
    alerts = [r for r in out if r.event == "ALERT_TRADABLE"]
    assert len(alerts) == 1 and alerts[0].symbol == "UP" and alerts[0].status == "TRADEABLE"


def test_limit_symbols_keeps_the_first(spark):
    rows = random_tape(4, n=60, symbols="ABCDEF")
    tape = spark.createDataFrame(rows, SCHEMA)
    order = []
    for e in sorted(rows, key=lambda e: (e[1], e[2], e[3])):
        if e[0] not in order:
            order.append(e[0])
    got = {r.symbol for r in limit_symbols(tape, 3).select("symbol").distinct().collect()}
    assert got == set(order[:3])


def test_hot_symbol_is_cut_into_bounded_windows(spark):
    """One symbol with nearly all rows: no window partition above what a slice can hold."""
    rng = random.Random(9)
    rows = [("HOT", t, t, t, True, 100.0 + rng.randrange(9), 1.0, t % 2 == 0, *[None] * 4) for t in range(0, 700_000, 10)]
    tape = spark.createDataFrame(rows, SCHEMA)
    roll = rolling_columns(tape)
    at = roll.filter(F.col("ts") == 650_000).first()
    assert at["n_range"] == 30_000 and at["n_w1s"] == 100
    plan = roll._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_window_tasks_follow_the_rows(spark, monkeypatch):
    """Ten times the symbols: more tasks of the window stage, none with more rows, the same values."""
    monkeypatch.setattr(rolling, "TASK_ROWS", 400)
    tape = "CAST(id % {n} AS STRING) symbol; id * 7 % 60000 ts; id seq; id % 3 > 0 is_trade; 100D + id % 5 price; 1D qty; id % 2 = 0 is_buyer_maker; 99D bid; 101D ask; 1D bid_qty; 2D ask_qty"  # noqa: E501
    before = spark.conf.get("spark.sql.shuffle.partitions")
    most, tasks = [], []
    try:
        for n in (30, 300):
            df = spark.range(100 * n).selectExpr(*tape.format(n=n).split("; "))
            sizes = [r["count"] for r in rolling_columns(df).groupBy(F.spark_partition_id()).count().collect()]
            tasks.append(rolling._tasks(df, 1_000))
            most.append(max(sizes))
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == tasks[-1] and len(sizes) > tasks[-1] / 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tasks[1] > 9 * tasks[0] and max(most) <= 400
