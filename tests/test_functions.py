"""Hand-computed values of column functions and small operators."""

import random

import pytest
from pyspark.sql import functions as F

from ticklens.config import PolicyConfig, ScoreConfig, SplitConfig
from ticklens.functions import cost, text
from ticklens.functions.calibrate import platt
from ticklens.operators import calibration, explain, metrics, monitor, normalize, policy, predict, ranking, router, split, universe


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def levels(*pairs):
    return F.array(*[F.struct(F.lit(float(p)).alias("price"), F.lit(float(q)).alias("qty")) for p, q in pairs])


def test_impact(spark):
    asks, bids = levels((100.1, 10), (100.2, 10)), levels((99.9, 10), (99.8, 10))
    empty = F.filter(asks, lambda x: F.lit(False))
    mid = F.lit(100.0)
    r = one(
        spark,
        cost.impact_bps(asks, mid, F.lit(500.0)).alias("small"),
        cost.impact_bps(bids, mid, F.lit(500.0), "sell").alias("sell"),
        cost.impact_bps(asks, mid, F.lit(2002.0)).alias("two"),
        cost.impact_bps(asks, mid, F.lit(1e9)).alias("all"),
        cost.impact_bps(empty, mid, F.lit(5.0)).alias("empty"),
        cost.impact_bps(asks, mid, F.lit(0.0)).alias("none"),
    )
    assert r.small == pytest.approx(10.0) and r.sell == pytest.approx(10.0)
    assert 10 < r.two < 15.001 and r["all"] == pytest.approx(15.0)
    assert (r.empty, r.none) == (100.0, 0.0)


def test_numbers_and_spellings(spark):
    r = one(
        spark,
        text.numbers_in_text(F.lit("a 12, -3.5 .5 7. x-1")).alias("n"),
        text.number_strings(F.lit(0.83)).alias("a"),
        text.number_strings(F.lit(2.0)).alias("b"),
    )
    assert r.n == ["12", "-3.5", ".5", "7.", "-1"]
    assert r.a == ["0.83"] and r.b == ["2.0", "2"]


def test_headlines(spark):
    sym, n = F.lit("ABC"), F.lit(180)
    r = one(
        spark,
        text.fallback_headline(sym, F.lit("TRAP"), F.lit(None).cast("string"), n).alias("a"),
        text.fallback_headline(sym, F.lit("TRAP"), F.lit("RC_FLOW_SURGE"), n).alias("b"),
        text.rule_headline(sym, F.lit("DEAD"), F.lit(None).cast("string"), n).alias("c"),
        text.rule_headline(sym, F.lit("DEAD"), F.lit("RC_" + "X" * 80), F.lit(50)).alias("d"),
    )
    assert (r.a, r.b, r.c) == ("ABC: trap.", "ABC: flow surge.", "ABC: dead conditions.")
    assert len(r.d) == 50 and r.d.endswith("...")


def test_versions(spark):
    v = ["1.2.3+abc123d+20260125+a1b2c3d4", "baseline-v1.0.0+0000000", "1.2.3", "1.2.3+xyz1234+20260125+a1b2c3d4"]
    df = spark.createDataFrame([(x,) for x in v], "v string").select(text.parse_model_version(F.col("v")).alias("m"))
    m = [r.m for r in df.collect()]
    assert (m[0].semver, m[0].git_sha, m[0].data_cutoff, m[0].patch) == ("1.2.3", "abc123d", "20260125", 3)
    assert (m[1].semver, m[1].train_hash) == ("1.0.0", "00000000")
    assert m[2] is None and m[3] is None


def test_message(spark):
    df = spark.createDataFrame(
        [(1706140803200, "ALERT_TRAP", "A_B<", 0, 0.25, "DATA_ISSUE", 0.639, None, "hi & bye")],
        "ts long, event string, symbol string, rank int, score double, status string, p_inplay_2m double, "
        "p_toxic double, llm_text string",
    )
    r = df.select(*[text.format_event(k, dashboard_url="http://x/").alias(k) for k in ("text", "html", "markdown")]).first()
    assert r.text.split("\n") == [
        "⚠️ A_B< - Trap - Avoid", "Time: 2024-01-25 00:00:03 UTC", "Rank: #1 | Score: 0.2500",
        "Status: DATA_ISSUE", "p_inplay: 63.90%", "", "hi & bye", "", "Dashboard: http://x",
    ]
    assert "<b>A_B&lt;</b>" in r.html and "hi &amp; bye" in r.html
    assert "*A\\_B<*" in r.markdown and "DATA\\_ISSUE" in r.markdown


def test_explanations(spark):
    schema = (
        "symbol string, status string, score double, reasons array<struct<code:string,value:double,unit:string,evidence:string>>, "
        "spread_bps double, impact_bps double, p_toxic double, max_chars int, headline string, subtext string, "
        "status_label string, tooltips map<string,string>"
    )
    base = ("B", "WATCH", 0.83, [("RC_FLOW_SURGE", 2.1, "z", "")], 8.2, 6.5, 0.21, 180)
    rows = [
        (*base, "score 0.83 and 2.1", "", "Watch", {"a": "8.2"}),
        (*base, "gain 83%", "", "Great", {"a": "0.95"}),
    ]
    got = explain.validate_or_fallback(spark.createDataFrame(rows, schema)).collect()
    assert got[0].was_valid and got[0].headline == rows[0][8]
    assert got[1].violations == ["status_label: Great", "headline: number 83", "tooltip a: number 0.95"]
    assert got[1].headline == "B: flow surge." and got[1].status_label == "Watch"


def test_platt_values(spark):
    r = one(spark, platt(F.lit(0.3), 1.0, 0.0).alias("same"), platt(F.lit(0.0), 1.0, 0.0).alias("edge"))
    assert r.same == pytest.approx(0.3) and 0 < r.edge < 1e-6


def test_config_checks():
    for bad in (lambda: ScoreConfig(w_2m=0.9), lambda: SplitConfig(train_ratio=0.9), lambda: PolicyConfig(inplay_exit_prob=0.7)):
        with pytest.raises(ValueError):
            bad()


def loop_auc(pairs):
    pairs = sorted(pairs, reverse=True)
    tp = wins = prec = 0
    for i, (_, y) in enumerate(pairs, 1):
        tp += y
        wins += 0 if y else tp
        prec += tp / i if y else 0
    n = len(pairs)
    return wins / (tp * (n - tp)), prec / tp


@pytest.mark.parametrize("distinct", [3, 40, 10_000])
def test_auc_with_ties(spark, distinct):
    rng = random.Random(distinct)
    pairs = [(rng.randrange(distinct) / distinct, int(rng.random() < 0.4)) for _ in range(3_000)]
    df = spark.createDataFrame([("g", s, y) for s, y in pairs], "g string, score double, y int")
    got = metrics.ranking_quality(df, ["g"]).first()
    auc, pr = loop_auc(pairs)
    assert got.auc == pytest.approx(auc, abs=1e-12) and got.pr_auc == pytest.approx(pr, abs=1e-9)


def test_one_class(spark):
    df = spark.createDataFrame([("g", 0.1, 0), ("g", 0.9, 0)], "g string, score double, y int")
    got = metrics.ranking_quality(df, ["g"]).first()
    assert (got.auc, got.pr_auc) == (0.5, 0.0)


def test_fit_platt_matches_a_loop(spark):
    import math

    rng = random.Random(1)
    data = [(round(rng.random(), 2), 0) for _ in range(200)]
    data = [(p, int(rng.random() < p * 0.6 + 0.2)) for p, _ in data]
    n, pos = len(data), sum(y for _, y in data)
    clip = lambda p: min(1 - 1e-7, max(1e-7, p))
    xs = [math.log(clip(p) / (1 - clip(p))) for p, _ in data]
    ts = [(pos + 1) / (pos + 2) if y else 1 / (n - pos + 2) for _, y in data]
    a, b, before = 1.0, 0.0, math.inf
    for _ in range(12):
        ps = [1 / (1 + math.exp(-(a * x + b))) for x in xs]
        loss = -sum(t * math.log(clip(p)) + (1 - t) * math.log(1 - clip(p)) for t, p in zip(ts, ps)) / n
        if abs(before - loss) < 1e-6:
            break
        before = loss
        a, b = a - 0.1 * sum((p - t) * x for p, t, x in zip(ps, ts, xs)) / n, b - 0.1 * sum(p - t for p, t in zip(ps, ts)) / n
    df = spark.createDataFrame([("h", p, y) for p, y in data], "head string, score double, y int")
    got = calibration.fit_platt(df, max_iter=12)["h"]
    assert got == pytest.approx((a, b), abs=1e-9)
    flipped = df.withColumn("y", 1 - F.col("y")).withColumn("score", F.col("y") * -0.98 + 0.99)
    with pytest.raises(ValueError):
        calibration.fit_platt(flipped.withColumn("score", 1 - F.col("y") * 0.98 - 0.01), max_iter=100, lr=2.0)


def test_split_keeps_equal_stamps_together(spark):
    ts = [1] * 7 + [2] * 5 + [3] * 4 + [4] * 4
    df = spark.createDataFrame([(t,) for t in ts], "ts long")
    s = {r.part: (r.n, r.first_ts, r.last_ts) for r in split.split_summary(split.time_split(df)).collect()}
    assert s == {"train": (16, 1, 3), "val": (4, 4, 4)} or s == {"train": (16, 1, 3), "test": (4, 4, 4)}
    with pytest.raises(ValueError):
        split.require_non_empty(split.split_summary(split.time_split(df)))


def test_policy_order(spark):
    cols = "realized_pnl double, unrealized_pnl double, position_qty double, ts long, last_book_ts long, p_toxic double, p_inplay_2m double"
    rows = [
        (-200.0, 0.0, 0.02, 9_000, 0, 0.9, 0.1),
        (0.0, 0.0, 0.01, 9_000, 0, 0.9, 0.1),
        (0.0, 0.0, 0.0, 0, 0, 0.6, 0.1),
        (0.0, 0.0, 0.0, 0, 0, 0.1, 0.9),
    ]
    got = [r.reason_codes for r in policy.evaluate_policy(spark.createDataFrame(rows, cols)).collect()]
    assert got == [
        ["kill_max_loss"],
        ["hard_limit_block", "stale_book_pause", "toxic_disable"],
        ["toxic_widen", "low_inplay_pause"],
        [],
    ]


def test_contracts(spark):
    good = '{"ts":1,"event":"SYMBOL_ENTER","symbol":"A","rank":0,"score":0.5,"payload":{}}'
    bad = '{"ts":-1,"event":"X","symbol":"","score":2,"more":1}'
    df = spark.createDataFrame([(good,), (bad,), ("nope",)], "raw string")
    got = [r.failures for r in normalize.validate_contract(df, "rank_event").collect()]
    assert got[0] == [] and got[2] == ["not a JSON object"]
    assert got[1] == [
        "ts: invalid", "event: invalid", "symbol: invalid", "rank: missing", "score: invalid", "more: unknown",
    ]
    nested = '{"ts":1,"symbol":"A","features":{"mid":0,"odd":1}}'
    f = normalize.validate_contract(spark.createDataFrame([(nested,)], "raw string"), "feature_snapshot").first().failures
    assert "features.mid: invalid" in f and "features.odd: unknown" in f and "features.spread_bps: missing" in f


def test_normalize_kinds(spark):
    raws = [
        '{"e":"aggTrade","E":5,"s":"a","p":"1.5","q":"2","m":true}',
        '{"e":"bookTicker","s":"A","b":"1","B":"2","a":"3","A":"4"}',
        '{"e":"depthUpdate","E":6,"s":"A","b":[["1","9"]],"a":[["2","8"]]}',
        '{"e":"forceOrder","E":7,"o":{"s":"Z"}}',
        '{"e":"other","s":"A"}',
        '{"e":"kline","E":8}',
    ]
    df = spark.createDataFrame([(r, 99, i) for i, r in enumerate(raws)], "raw string, recv_ts long, seq long")
    ev = normalize.normalize_raw(df)
    assert [(r.symbol, r.type, r.ts) for r in ev.orderBy("seq").collect()] == [
        ("A", "trade", 5), ("A", "book", 99), ("A", "book", 6), ("Z", "funding", 7),
    ]
    tape = normalize.to_tape(ev).orderBy("seq").collect()
    assert (tape[0].price, tape[0].is_buyer_maker) == (1.5, True)
    assert [(t.bid, t.ask_qty) for t in tape[1:]] == [(1.0, 4.0), (1.0, 8.0)]
    plain = spark.createDataFrame([('{"bid":"1","ask":"2"}', "book")], "payload string, type string")
    assert normalize.parse_books(plain, "feature").first().bid == 0.0
    assert normalize.parse_books(plain, "label").first().bid == 1.0


def test_router_and_universe(spark):
    ev = spark.createDataFrame(
        [("A", 100, 110, 1), ("A", 90, 120, 2), ("B", 50, 130, 3)], "symbol string, ts long, recv_ts long, seq long"
    )
    m = router.router_metrics(ev, spark.createDataFrame([("A",)], "symbol string"), 25).first()
    assert (m.events_received, m.events_routed, m.unknown_symbols, m.late_events, m.stale_events) == (3, 2, 1, 1, 1)
    assert (m.avg_latency_ms, m.max_latency_ms) == (20.0, 30)
    inst = spark.createDataFrame([("A", "TRADING"), ("B", "BREAK"), ("C", "TRADING")], "symbol string, status string")
    inst = inst.withColumns({"quote_asset": F.lit("USDT"), "contract_type": F.lit("PERPETUAL"), "base_asset": F.lit("x")})
    tick = spark.createDataFrame([("C", 5.0)], "symbol string, quote_volume double")
    top = universe.top_symbols_by_volume(universe.tradeable_instruments(inst), tick, 5).collect()
    assert [(r.symbol, r.quote_volume) for r in top] == [("C", 5.0), ("A", 0.0)]


def test_counter_resets_add_nothing(spark):
    vals = [(0, 1.0), (10, 5.0), (20, 2.0), (30, 4.0), (75, 10.0)]
    m = spark.createDataFrame([("i", "m", t, v) for t, v in vals], "instance string, metric string, ts long, value double")
    got = {r.ts: r.increase for r in monitor.counter_increase(m, 60).collect()}
    assert got == {0: 0.0, 10: 4.0, 20: 4.0, 30: 6.0, 75: 8.0}


def test_throttle(spark):
    rows = [(0, "a", 0.5), (400, "a", 0.52), (800, "a", 0.7), (1_000, "a", 0.75), (3_000, "a", 0.1), (4_200, "a", 0.2)]
    df = spark.createDataFrame(rows, "ts long, symbol string, score double")
    got = {r.ts: r.accepted for r in ranking.throttle(df).collect()}
    assert got == {0: True, 400: False, 800: True, 1_000: False, 3_000: True, 4_200: True}


def test_feature_vector_order(spark):
    row = spark.createDataFrame(
        [(1.0, 2.0, 3.0, 4.0, 5.0, 6.0, "high", "chop")],
        "spread_bps double, mid double, book_imbalance double, flow_imbalance double, natr_14_5m double, "
        "impact_bps_q double, regime_vol string, regime_trend string",
    )
    assert row.select(predict.feature_vector().alias("v")).first().v == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 1.0, 0.0]
