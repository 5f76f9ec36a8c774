"""Isotonic calibration, drift, robust scores, moving moments, order budgets and the update throttle against plain loops."""

import math
import random
import statistics
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklens.config import RankConfig
from ticklens.functions.market import depth_slope, microprice, trade_intensity
from ticklens.operators import budget, drift, isotonic, moments, ranking, robust


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# ---- isotonic


def plain_isotonic(rows):
    """(lowest, highest, rows, positives) of the blocks, one row after another."""
    out = []
    for s in sorted({s for s, _ in rows}):
        ys = [y for t, y in rows if t == s]
        out.append((s, s, len(ys), sum(ys)))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            b, a = out.pop(), out.pop()
            out.append((a[0], b[1], a[2] + b[2], a[3] + b[3]))
    return out


@pytest.mark.parametrize("slice_rows", [2, 9, 60, 100_000])
def test_isotonic_blocks_do_not_depend_on_slices(spark, slice_rows):
    rng = random.Random(11)
    heads = {
        "rising": [(round(s, 3), int(rng.random() < s)) for s in (rng.random() for _ in range(400))],
        "falling": [(round(s, 3), int(rng.random() > s)) for s in (rng.random() for _ in range(300))],
        "flat": [(i / 50, i % 2) for i in range(50)],
        "one": [(0.5, 1), (0.5, 0)],
    }
    rows = [(h, s, y) for h, r in heads.items() for s, y in r] + [("rising", None, 1), ("flat", float("nan"), 0), ("one", 0.1, None)]
    df = spark.createDataFrame(rows, "head string, score double, y int").repartition(5)
    fit = isotonic.isotonic_fit(df, slice_rows=slice_rows)
    want = sorted((h, *b) for h, r in heads.items() for b in plain_isotonic(r))
    assert rows_of(fit, "head", "lo", "hi", "n", "pos") == want
    assert all(r.value == r.pos / r.n for r in fit.collect())


def test_isotonic_apply(spark):
    fit = spark.createDataFrame([("a", 0.2, 0.3, 5, 1, 0.2), ("a", 0.5, 0.5, 2, 1, 0.5), ("a", 0.7, 0.9, 1, 1, 1.0)], "head string, lo double, hi double, n long, pos long, value double")
    xs = [("a", x) for x in (0.0, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.95, None)] + [("b", 0.4)]
    got = isotonic.isotonic_apply(spark.createDataFrame(xs, "head string, score double"), fit)
    have = {(r.head, r.score): r.calibrated for r in got.collect()}
    want = [0.2, 0.2, 0.2, 0.2, 0.35, 0.5, 0.75, 1.0, 1.0, None, 0.4]
    assert [None if v is None else round(v, 9) for v in (have[x] for x in xs)] == want


def test_isotonic_of_nothing(spark):
    empty = spark.createDataFrame([], "head string, score double, y int")
    assert isotonic.isotonic_fit(empty).collect() == []
    assert isotonic.isotonic_apply(empty, isotonic.isotonic_fit(empty)).collect() == []


# ---- drift


@pytest.fixture(scope="module")
def values():
    rng = random.Random(2)
    rows = [("same", rng.gauss(0, 1), rng.random() < 0.5) for _ in range(600)]
    rows += [("moved", rng.gauss(b * 0.8, 1), b) for b in (True, False) for _ in range(250)]
    rows += [("ties", float(rng.choice([0, 0, 0, 1, 5])), rng.random() < 0.4) for _ in range(300)]
    rows += [("far", rng.choice([1e300, -1e300, 1e-300, 0.0, -0.0]), i % 2 == 0) for i in range(50)]
    rows += [("lone", 1.0, True), ("lone", 2.0, True), ("same", None, True), ("same", float("nan"), False), ("same", 0.0, None)]
    return rows


def sides(values, f):
    own = [(v, b) for g, v, b in values if g == f and v is not None and v == v and b is not None]
    return sorted(v for v, b in own if b), sorted(v for v, b in own if not b)


def test_ks_distance(spark, values):
    got = {r.feature: r for r in drift.ks_drift(spark.createDataFrame(values, "feature string, value double, is_base boolean")).collect()}
    assert got.keys() == {v[0] for v in values}
    for f, r in got.items():
        base, now = sides(values, f)
        assert (r.n_base, r.n_now) == (len(base), len(now))
        if not now:
            assert r.ks is None and r.drifted is None
            continue
        gap = lambda x: abs(sum(v <= x for v in base) / len(base) - sum(v <= x for v in now) / len(now))  # noqa: E731, B023
        best = max(gap(x) for x in base + now)
        assert abs(r.ks - best) < 1e-12 and r.at_value == min(x for x in base + now if abs(gap(x) - best) < 1e-12)
        assert r.drifted == (r.ks > 1.36 * math.sqrt((len(base) + len(now)) / (len(base) * len(now))))
    assert got["moved"].drifted and not got["same"].drifted


@pytest.mark.parametrize("bins", [2, 10])
def test_psi_on_exact_quantiles(spark, values, bins):
    df = spark.createDataFrame(values, "feature string, value double, is_base boolean")
    got = {(r.feature, r.bin): (r.base, r.now) for r in drift.psi_bins(df, bins=bins).collect()}
    psi = {r.feature: r for r in drift.psi_drift(df, bins=bins).collect()}
    want = {}
    for f in {v[0] for v in values}:
        base, now = sides(values, f)
        edges = [base[-(-j * len(base) // bins) - 1] for j in range(1, bins)]
        place = lambda x: sum(e < x for e in edges)  # noqa: E731, B023
        for k in {place(x) for x in base + now}:
            want[f, k] = (sum(place(x) == k for x in base), sum(place(x) == k for x in now))
        if now:
            shares = [(max(b / len(base), 1e-4), max(c / len(now), 1e-4)) for (g, _), (b, c) in want.items() if g == f]
            assert abs(psi[f].psi - sum((c - b) * math.log(c / b) for b, c in shares)) < 1e-9
    assert got == want and psi["lone"].psi is None and psi["lone"].level is None
    assert psi["same"].level == "OK" and psi["moved"].level == "CRITICAL"


# ---- robust scores


@pytest.mark.parametrize("slice_ms", [100, 1_000, 10**9])
def test_robust_scores(spark, slice_ms):
    rng = random.Random(6)
    rows = [("hot", rng.randrange(3_000), rng.choice([rng.gauss(0, 5), float(rng.randint(0, 3))])) for _ in range(700)]
    rows += [("cold", t * 400, 2.0) for t in range(6)] + [("cold", 2_050, 9.0), (None, 5, 1.0), ("hot", 77, None), ("hot", 78, float("nan"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, ts long, x double").repartition(4)
    got = {r.id: r for r in robust.robust_z(df, ["k"], "ts", "x", 250, slice_ms).collect()}
    assert len(got) == len(rows)
    for i, (k, t, x) in enumerate(rows):
        frame = [y for j, u, y in rows if j == k and t - 250 < u <= t and y is not None and y == y]
        med = statistics.median(frame) if frame else None
        mad = statistics.median([abs(y - med) for y in frame]) if frame else None
        r = got[i]
        assert r.n == len(frame) and r.median == med and (r.mad == mad or abs(r.mad - mad) < 1e-12)
        if x is None or x != x or (mad == 0 and x == med):
            assert r.robust_z is None
        elif mad == 0:
            assert r.robust_z == math.copysign(math.inf, x - med)
        else:
            assert abs(r.robust_z - (x - med) / (1.4826 * mad)) < 1e-9


def test_cells_go_on_over_batches(spark):
    """A cell longer than an Arrow batch is one cell, and many cells of a batch are handed over at once."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows = [(i, "hot", i, float(i % 7)) for i in range(150)] + [(200 + i, f"k{i % 40}", i, 1.0) for i in range(90)]
        df = spark.createDataFrame(rows, "id long, k string, ts long, x double")
        got = {r.id: (r.n, r.median) for r in robust.robust_z(df, ["k"], "ts", "x", 10**6).collect()}
        for i, k, t, _ in rows:
            frame = [y for _, j, u, y in rows if j == k and u <= t]
            assert got[i] == (len(frame), statistics.median(frame))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# ---- moving moments


def test_moments_do_not_cancel(spark):
    rng = random.Random(9)
    rows = [("a", t, 1e9 + rng.random(), -1e9 + rng.random()) for t in sorted(rng.sample(range(2_000), 300))]
    rows += [("b", 100 * t, 5.0, 5.0) for t in range(5)] + [("a", 2_001, None, 1.0), ("a", 2_001, 1e9, -1e9), ("a", 2_002, float("nan"), 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, ts long, x double, y double").repartition(3)
    got = {r.id: r.moments for r in moments.moving_moments(df, ["k"], "ts", F.col("x"), F.col("y"), 170).collect()}
    for i, (k, t, _, _) in enumerate(rows):
        frame = [(x, y) for j, u, x, y in rows if j == k and t - 170 < u <= t and None not in (x, y) and x == x]
        m = got[i]
        if not frame:
            assert m.n == 0
            continue
        a = np.array(frame) - np.array([1e9, -1e9]) * (k == "a")  # exact
        c = np.cov(a.T, bias=True) * len(a) if len(a) > 1 else np.zeros((2, 2))
        assert m.n == len(frame)
        assert np.allclose([m.xx, m.yy, m.xy], [c[0, 0], c[1, 1], c[0, 1]], rtol=1e-5, atol=1e-6)


def test_beta_of_a_multiple(spark):
    rng = random.Random(1)
    price = {"ref": 100.0, "twice": 50.0, "still": 7.0}
    rows = []
    for t in range(200):
        r = rng.gauss(0, 0.01)
        price["ref"] *= math.exp(r)
        price["twice"] *= math.exp(2 * r)
        rows += [(s, t, p) for s, p in price.items()]
    out = moments.market_beta(spark.createDataFrame(rows, "symbol string, ts long, mid double"), "ref", window_ms=20).collect()
    late = [r for r in out if r.ts >= 25]
    assert all(r.n_returns == 20 for r in late)
    assert all(abs(r.beta - {"ref": 1, "twice": 2, "still": 0}[r.symbol]) < 1e-9 for r in late)
    assert all((r.corr is None) if r.symbol == "still" else abs(r.corr - 1) < 1e-9 for r in late)
    vol = moments.realized_vol(spark.createDataFrame(rows, "symbol string, ts long, mid double"), ["symbol"], "ts", "mid", 20)
    assert all((r.realized_vol == 0) == (r.symbol == "still") for r in vol.collect() if r.ts >= 2)


def test_book_shapes(spark):
    df = spark.sql("SELECT array(named_struct('price', 1d, 'qty', 2d), named_struct('price', 2d, 'qty', 4d), named_struct('price', 3d, 'qty', 6d)) AS up")
    one = df.select(
        depth_slope(F.col("up")).alias("rise"),
        depth_slope(F.slice("up", 1, 1)).alias("one"),
        depth_slope(F.array(F.col("up")[0], F.col("up")[0])).alias("flat"),
        depth_slope(F.lit(None).cast(df.schema["up"].dataType)).alias("none"),
        microprice(F.lit(10.0), F.lit(12.0), F.lit(3.0), F.lit(1.0)).alias("micro"),
        microprice(F.lit(10.0), F.lit(12.0), F.lit(0.0), F.lit(0.0)).alias("empty"),
        trade_intensity(F.lit(30), 60_000).alias("rate"),
    ).first()
    assert tuple(one) == (2.0, None, None, None, 11.5, None, 0.5)


# ---- order budgets


@pytest.mark.parametrize("slice_ms", [300, 5_000, 10**9])
def test_order_budget(spark, slice_ms):
    rng = random.Random(4)
    orders = sorted((a, rng.choice([rng.randrange(20_000), rng.randrange(4_000, 5_000)]), i) for i in range(500) for a in [rng.choice("xxy")])
    want, state = [], {}
    for a, t, i in orders:
        level, at, throttled = state.get(a, (30_000, t, False))
        level = min(30_000, level + (t - at) * 7) - 1_000
        throttled = True if level <= 5_000 else False if level > 10_000 else throttled
        state[a] = (level, t, throttled)
        want.append((a, i, level / 1000, throttled))
    df = spark.createDataFrame(orders, "a string, ts long, order_id long").repartition(4)
    got = budget.order_budget(df, ["a"], capacity=30, per_second=7, buffer=5, slice_ms=slice_ms)
    assert rows_of(got, "a", "order_id", "remaining", "throttled") == sorted(want)
    churn = {r.order_id: (r.in_window, r.paused) for r in budget.order_churn(df, ["a"], window_ms=1_000, max_orders=9).collect()}
    for a, t, i in orders:
        n = sum(b == a and u // 1_000 == t // 1_000 and (u, j) <= (t, i) for b, u, j in orders)
        assert churn[i] == (n, n > 9)


@pytest.mark.parametrize("slice_ms", [100, 10**9])
def test_cooldown_after_fills(spark, slice_ms):
    rows = spark.createDataFrame([("a", t) for t in range(0, 2_000, 50)] + [(None, 10)], "k string, ts long")
    fills = spark.createDataFrame([("a", 500), ("a", 620), ("b", 0), (None, 1)], "k string, ts long")
    got = {(r.k, r.ts): (r.last_ts, r.fill_cooldown) for r in budget.cooldown(rows, fills, ["k"], 200, slice_ms=slice_ms, reason="fill_cooldown").collect()}
    for (k, t), seen in got.items():
        last = max((u for u in {"a": (500, 620), None: (1,)}[k] if u <= t), default=None)
        assert seen == (last, last is not None and t - last < 200)


# ---- updates


def loop_throttle(rows, cfg):
    """rows: (ts, symbol, score) -> accepted ticks, one update after another."""
    states, last, out = {}, None, []
    for ts in sorted({r[0] for r in rows}):
        now = {s: x for t, s, x in rows if t == ts}
        moved = max((abs(x - states[s]) for s, x in now.items() if x >= cfg.score_threshold and s in states), default=0.0)
        if last is None or ts - last >= cfg.update_interval_ms or moved >= cfg.burst_delta:
            last = ts
            states = dict.fromkeys(states, 0.0) | now
            out.append(ts)
    return out


@pytest.mark.parametrize("slice_ms", [700, 10**9])
@pytest.mark.parametrize("seed", range(3))
def test_throttle_of_absent_symbols(spark, slice_ms, seed):
    """Uneven ticks, symbols that come and go, and some that are first seen at a skipped update."""
    rng = random.Random(seed)
    ticks = sorted(rng.sample(range(0, 12_000), 160)) + [20_000, 20_001]
    names = {s: rng.randrange(6_000) for s in "abcdefgh"}
    rows = [(t, s, round(rng.random(), 2)) for t in ticks for s, t0 in names.items() if t >= t0 and rng.random() < (0.15, 0.5, 0.9)[seed]]
    cfg = RankConfig(update_interval_ms=500, burst_delta=0.8, score_threshold=0.3, slice_ms=slice_ms)
    df = spark.createDataFrame(rows, "ts long, symbol string, score double").repartition(3)
    got = ranking.throttle(df, cfg)
    want = loop_throttle(rows, cfg)
    assert rows_of(got.filter("accepted"), "ts") == [(t,) for t in want]
    assert 20 < len(want) < len({r[0] for r in rows}) == got.count()


@pytest.mark.parametrize("slice_ms", [3_000, 10**9])
@pytest.mark.parametrize("limits", [{}, {"enter_ms": 0, "exit_ms": 0, "min_dwell_ms": 0}, {"exit_ms": 9_000}])
def test_absent_symbols_go_on(spark, slice_ms, limits):
    from tests.test_folds import loop_hysteresis

    rng = random.Random(8)
    ticks = [t for t in range(1_000, 70_000, 1_000) if t % 13_000 and not 30_000 < t < 37_000]
    cfg = replace(RankConfig(top_k=2, score_threshold=0.4, slice_ms=slice_ms), **limits)
    rows = []
    for s in "abcdefg":
        here, t0 = True, rng.choice([0, 9_000])
        for t in ticks:
            here = here if rng.random() < 0.75 else not here
            if t >= t0 and here:
                rows.append((t, s, round(0.5 + 0.5 * rng.random() * ((t // 9_000 + ord(s)) % 3) - 0.3, 3)))
    df = spark.createDataFrame(rows, "ts long, symbol string, score double")
    got = ranking.rank_events(ranking.ranked_states(df, cfg, absent=True))
    want = loop_hysteresis(rows, cfg, absent=True)
    assert want and rows_of(got, "ts", "event", "symbol", "rank") == want
    dense = len({r[0] for r in rows}) * 7
    if not limits:
        assert ranking.with_absent(ranking.membership(df, cfg), cfg).count() < dense


# ---- training

SNAP = (
    "ts long, symbol string, features struct<spread_bps: double, mid: double, book_imbalance: double, flow_imbalance: double,"
    " natr_14_5m: double, impact_bps_q: double, regime_vol: string, regime_trend: string>"
)


def test_training_rows_look_back_only(spark):
    from ticklens.operators import train

    snap = spark.createDataFrame([(t, "a", (float(t), 1.0, 0.0, 0.0, 0.0, 0.0, "low", "chop")) for t in (1_000, 2_000, 3_000)], SNAP)
    lab = spark.createDataFrame([(999, "a", 1), (1_000, "a", 0), (2_999, "a", 1), (9_000, "a", 0), (9_000, "b", 1)], "ts long, symbol string, y int")
    rows = train.training_rows(snap, lab, 1_500)
    assert rows_of(rows, "ts", "feature_ts", "features.spread_bps") == [(1_000, 1_000, 1_000.0), (2_999, 2_000, 2_000.0), (9_000, 3_000, 3_000.0)]


def test_trained_heads_beat_the_share(spark):
    from ticklens.operators import train
    from ticklens.operators.predict import predict_model

    rng = random.Random(3)
    snaps, labels = [], []
    for t in range(1_500):
        spread, flow = rng.uniform(0, 20), rng.uniform(-1, 1)
        snaps.append((t, "s", (spread, 100.0, 0.1, flow, 0.001, 4.0, "low", "chop")))
        y = int(spread < 8 and rng.random() < 0.9)
        labels.append((t, "s", y, y, 0, int(abs(flow) > 0.5)))
    lab = spark.createDataFrame(labels, "ts long, symbol string, i_tradeable_30s_a int, i_tradeable_2m_a int, i_tradeable_5m_a int, y_toxic int")
    snap = spark.createDataFrame(snaps, SNAP)
    parts = train.split_rows(train.training_rows(snap, lab))
    heads = train.train_heads(parts)
    assert heads["p_inplay_5m"] == 0.0  # one class only
    flat = snap.select("ts", "symbol", *(F.lit(0.5).alias(h) for h in heads))
    got = {r.head: r for r in train.evaluate_heads(parts, heads, flat).collect()}
    for h in ("p_inplay_30s", "p_inplay_2m", "p_toxic"):
        assert got[h].brier < got[h].brier_share / 2 and abs(got[h].brier_baseline - 0.25) < 1e-9
    health = F.struct(F.lit(0).alias("stale_book_ms"), F.lit(0).alias("stale_trades_ms"), F.array().cast("array<string>").alias("missing_streams"))
    pred = predict_model(snap.withColumn("data_health", health), train.as_model(heads))
    low = {bool(r.wide): r.p for r in pred.join(snap.select("ts", (F.col("features.spread_bps") > 9).alias("wide")), "ts").groupBy("wide").agg(F.avg("p_inplay_2m").alias("p")).collect()}
    assert low[False] > 0.6 and low[True] < 0.15
