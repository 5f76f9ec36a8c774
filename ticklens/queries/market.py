"""Registered queries: messages, routing, features, predictions, ranking, alerts."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ticklens.config import AlertConfig, DeliveryConfig
from ticklens.functions.market import book_imbalance, spread_bps
from ticklens.functions.numeric import clamp, rnd
from ticklens.functions.text import parse_model_version
from ticklens.operators import alerts as al
from ticklens.operators import asof, delivery, monitor, normalize, predict, ranking, router, thin, universe
from ticklens.operators.rolling import feature_columns, limit_symbols, rolling_columns
from ticklens.operators.runs import status_runs
from ticklens.plans.marketview import market_messages
from ticklens.plans.replay import ChainConfig, attach_rank, chain_events, compare_events
from ticklens.queries.common import (
    FC, MC, PRED_SQL, RC, F, S, flag, joined, load, preds_of, query, snaps_of, tape_of,
)
from ticklens.session import cut_lineage
from ticklens.sources.readers import ticker_volumes
from ticklens.sources.writers import row_digest

TAPE = "WITH " + S.TAPE
FEAT = "WITH " + S.features(FC)
PRED = "WITH " + PRED_SQL


# --- messages ---------------------------------------------------------------------------


@query(
    "market_trades",
    TAPE + " SELECT seq, symbol, ts, recv_ts, price, qty, maker::INT AS is_buyer_maker FROM tape WHERE is_trade",
)
def market_trades(spark: SparkSession, sf: str) -> DataFrame:
    ev = normalize.normalize_raw(market_messages(spark, sf))
    return normalize.parse_trades(ev).withColumn("is_buyer_maker", flag(F.col("is_buyer_maker")))


@query(
    "market_books",
    TAPE + " SELECT seq, symbol, ts, recv_ts, bid, bid_qty, ask, ask_qty FROM tape WHERE NOT is_trade",
)
def market_books(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.parse_books(normalize.normalize_raw(market_messages(spark, sf)))


@query(
    "event_types",
    TAPE + """ SELECT symbol, CASE WHEN is_trade THEN 'trade' ELSE 'book' END AS type, count(*) AS n
    FROM tape GROUP BY 1, 2""",
)
def event_types(spark: SparkSession, sf: str) -> DataFrame:
    ev = normalize.normalize_raw(market_messages(spark, sf))
    return ev.groupBy("symbol", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quarantine",
    """
    WITH e AS (SELECT event_id AS seq, event_type AS type,
        CASE WHEN user_id % 7 = 0 THEN '' ELSE 'U' || user_id END AS symbol,
        CASE WHEN event_id % 11 = 0 THEN -1 ELSE event_id END AS ts,
        CASE WHEN event_id % 13 <> 0 THEN event_id END AS recv_ts, event_id % 17 = 0 AS extra FROM events)
    SELECT seq, concat_ws('; ', CASE WHEN ts < 0 THEN 'ts: invalid' END, CASE WHEN symbol = '' THEN 'symbol: invalid' END,
        CASE WHEN type NOT IN ('click', 'view') THEN 'type: invalid' END,
        CASE WHEN recv_ts IS NULL THEN 'recv_ts: missing' END, CASE WHEN extra THEN 'note: unknown' END) AS failures
    FROM e WHERE ts < 0 OR symbol = '' OR type NOT IN ('click', 'view') OR recv_ts IS NULL OR extra""",
)
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    e, known = load(spark, sf, "events"), F.col("event_type")
    row = F.struct(
        F.when(F.col("event_id") % 11 == 0, F.lit(-1)).otherwise(F.col("event_id")).alias("ts"),
        F.lit("feed").alias("source"),
        F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("U"), F.col("user_id"))).alias("symbol"),
        F.when(known == "click", "trade").when(known == "view", "book").otherwise(known).alias("type"),
        F.when(F.col("event_id") % 13 != 0, F.col("event_id")).alias("recv_ts"),
        F.when(F.col("event_id") % 17 == 0, F.lit("x")).alias("note"),
    )
    rows = e.select(F.col("event_id").alias("seq"), F.to_json(row).alias("raw"))
    _, bad = normalize.split_valid(rows, "market_event")
    return bad.select("seq", joined("failures", "; ").alias("failures"))


# --- routing ----------------------------------------------------------------------------

_KNOWN_SQL = "known AS (SELECT DISTINCT 'U' || user_id AS symbol FROM events WHERE event_type = 'purchase' AND value > 100)"


def _known(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").filter("event_type = 'purchase' AND value > 100")
    return e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol")).distinct()


@query(
    "symbol_filter",
    TAPE + f", {_KNOWN_SQL} SELECT symbol, (symbol IN (SELECT symbol FROM known))::INT AS kept, count(*) AS n FROM tape GROUP BY 1, 2",
)
def symbol_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept, dropped = router.filter_symbols(tape_of(spark, sf), _known(spark, sf))
    rows = kept.select("symbol", F.lit(1).alias("kept")).unionByName(dropped.select("symbol", F.lit(0).alias("kept")))
    return rows.groupBy("symbol", "kept").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stale_and_latency",
    TAPE + """ SELECT symbol, seq, (recv_ts - ts > 25)::INT AS stale, greatest(0, recv_ts - ts) AS latency_ms FROM tape""",
)
def stale_and_latency(spark: SparkSession, sf: str) -> DataFrame:
    rows = router.flag_stale(tape_of(spark, sf), 25)
    return rows.select("symbol", "seq", flag(F.col("stale")).alias("stale"), router.event_latency().alias("latency_ms"))


_LATE = """late AS (SELECT *, ts < max(ts) OVER (PARTITION BY symbol ORDER BY arrived, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late
    FROM (SELECT *, recv_ts + 900 * (seq % 20) AS arrived FROM tape))"""


def _shaken(spark: SparkSession, sf: str) -> DataFrame:
    """The tape with arrival times that overtake each other."""
    return tape_of(spark, sf).withColumn("recv_ts", F.col("recv_ts") + 900 * (F.col("seq") % 20))


@query("late_events", TAPE + f", {_LATE} SELECT symbol, ts, arrived AS recv_ts, seq FROM late WHERE late")
def late_events(spark: SparkSession, sf: str) -> DataFrame:
    return router.late_events(_shaken(spark, sf)).select("symbol", "ts", "recv_ts", "seq")


@query(
    "router_metrics",
    TAPE + f""", {_KNOWN_SQL}, kept AS (SELECT * FROM tape WHERE symbol IN (SELECT symbol FROM known)),
    shaken AS (SELECT *, recv_ts + 900 * (seq % 20) AS arrived FROM tape),
    r AS (SELECT *, arrived - ts > 10000 AS stale FROM shaken),
    k AS (SELECT *, symbol NOT IN (SELECT symbol FROM known) AS unknown FROM r),
    l AS (SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY symbol ORDER BY arrived, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM k WHERE NOT unknown AND NOT stale)
    SELECT count(*) AS events_received, count(*) FILTER (NOT unknown AND NOT stale) AS events_routed,
      count(*) FILTER (unknown OR stale) AS events_dropped,
      (max(arrived - ts) FILTER (NOT unknown))::BIGINT AS max_latency_ms,
      count(*) FILTER (NOT unknown AND stale) AS stale_events, (SELECT count(*) FROM l WHERE late) AS late_events,
      count(*) FILTER (unknown) AS unknown_symbols, count(DISTINCT symbol) FILTER (NOT unknown) AS symbol_count,
      {S.rnd("(sum(arrived - ts) FILTER (NOT unknown AND arrived > ts))::DOUBLE / (count(*) FILTER (NOT unknown AND arrived > ts))", 2)} AS avg_latency_ms,
      {S.rnd("(count(*) FILTER (unknown OR stale))::DOUBLE / count(*)", 4)} AS drop_rate,
      {S.rnd("(count(*) FILTER (NOT unknown AND stale))::DOUBLE / count(*)", 4)} AS stale_rate
    FROM k""",
)
def router_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = router.router_metrics(_shaken(spark, sf), _known(spark, sf), 10_000, drop_stale=True)
    return m.withColumns(
        {
            "avg_latency_ms": rnd(F.col("avg_latency_ms"), 2),
            "drop_rate": rnd(F.col("drop_rate"), 4),
            "stale_rate": rnd(F.col("stale_rate"), 4),
        }
    )


@query("events_per_symbol", TAPE + " SELECT symbol, count(*) AS event_count, max(ts) AS last_ts FROM tape GROUP BY 1")
def events_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return router.events_per_symbol(tape_of(spark, sf))


@query(
    "merged_metrics",
    TAPE + """ SELECT symbol, count(*) AS received, sum(recv_ts - ts)::BIGINT AS latency_sum,
    max(recv_ts - ts) AS latency_max FROM tape GROUP BY 1""",
)
def merged_metrics(spark: SparkSession, sf: str) -> DataFrame:
    no = F.lit(False)
    t = tape_of(spark, sf).withColumns({c: no for c in ("stale", "late", "dropped", "unknown")})
    a = router.partial_metrics(t.filter("is_trade"))
    b = router.partial_metrics(t.filter("NOT is_trade"))
    return router.merge_metrics(a, b).select("symbol", "received", "latency_sum", "latency_max")


@query(
    "universe_topn",
    f"""
    WITH inst AS (SELECT 'P' || p_partkey AS symbol, CASE WHEN p_size % 10 = 0 THEN 'BREAK' ELSE 'TRADING' END AS status,
        CASE WHEN p_size % 4 = 0 THEN 'BUSD' ELSE 'USDT' END AS quote_asset, CASE WHEN p_size % 9 <> 0 THEN p_brand END AS base_asset
        FROM part),
    tick AS (SELECT 'P' || l_partkey AS symbol, sum(floor(l_extendedprice))::DOUBLE AS v FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1)
    SELECT symbol, coalesce(v, 0) AS quote_volume FROM inst LEFT JOIN tick USING (symbol)
    WHERE status = 'TRADING' AND quote_asset = 'USDT' AND base_asset IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 100""",
)
def universe_topn(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("P"), F.col(c).cast("string")).alias("symbol")
    size = F.col("p_size")
    inst = load(spark, sf, "part").select(
        name("p_partkey"),
        F.when(size % 10 == 0, "BREAK").otherwise("TRADING").alias("status"),
        F.when(size % 4 == 0, "BUSD").otherwise("USDT").alias("quote_asset"),
        F.lit("PERPETUAL").alias("contract_type"),
        F.when(size % 9 != 0, F.col("p_brand")).alias("base_asset"),
        F.lit(2).alias("price_precision"),
        F.lit(3).alias("quantity_precision"),
    )
    vol = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.floor("l_extendedprice")).alias("v"))
    text = F.when(F.col("l_partkey") % 5 == 0, "n/a").otherwise(F.col("v").cast("string"))
    tickers = ticker_volumes(vol.select(name("l_partkey"), text.alias("quoteVolume")))
    top = universe.top_symbols_by_volume(universe.tradeable_instruments(inst), tickers, 100)
    return top.select("symbol", "quote_volume")


# --- features ---------------------------------------------------------------------------


@query(
    "quote_measures",
    TAPE + f""" SELECT seq, {S.rnd("(ask - bid) / ((bid + ask) / 2) * 10000", 6)} AS spread_bps, (bid + ask) / 2 AS mid,
    {S.rnd("(bid_qty - ask_qty) / (bid_qty + ask_qty)", 6)} AS book_imbalance FROM tape WHERE NOT is_trade""",
)
def quote_measures(spark: SparkSession, sf: str) -> DataFrame:
    return tape_of(spark, sf).filter("NOT is_trade").select(
        "seq",
        rnd(spread_bps(F.col("bid"), F.col("ask")), 6).alias("spread_bps"),
        ((F.col("bid") + F.col("ask")) / 2).alias("mid"),
        rnd(book_imbalance(F.col("bid_qty"), F.col("ask_qty")), 6).alias("book_imbalance"),
    )


_AGG_SQL = ", ".join(
    f"n_{w} AS trade_count_{w}, vol_{w} AS volume_{w}, buy_{w} AS buy_volume_{w}, sell_{w} AS sell_volume_{w}, "
    + S.rnd(f"CASE WHEN vol_{w} > 0 THEN pv_{w} / vol_{w} ELSE 0 END", 6)
    + f" AS vwap_{w}"
    for w in ("w1s", "w10s", "w60s")
)


@query("rolling_trade_aggs", FEAT + f" SELECT symbol, ts, {_AGG_SQL} FROM feat")
def rolling_trade_aggs(spark: SparkSession, sf: str) -> DataFrame:
    flat = feature_columns(rolling_columns(tape_of(spark, sf), FC), FC)
    cols = []
    for w in ("w1s", "w10s", "w60s"):
        for c in ("trade_count", "volume", "buy_volume", "sell_volume"):
            cols.append(F.col(f"{w}.{c}").alias(f"{c}_{w}"))
        cols.append(rnd(F.col(f"{w}.vwap"), 6).alias(f"vwap_{w}"))
    return flat.select("symbol", "ts", *cols)


@query(
    "natr_regime",
    FEAT + f" SELECT symbol, ts, {S.rnd('natr_14_5m', 8)} AS natr_14_5m, regime_vol, regime_trend FROM feat",
)
def natr_regime(spark: SparkSession, sf: str) -> DataFrame:
    f = snaps_of(spark, sf).select("symbol", "ts", "features.*")
    return f.select("symbol", "ts", rnd(F.col("natr_14_5m"), 8).alias("natr_14_5m"), "regime_vol", "regime_trend")


@query(
    "flow_and_impact",
    FEAT + f" SELECT symbol, ts, {S.rnd('flow_imbalance', 6)} AS flow_imbalance, {S.rnd('impact_bps_q', 6)} AS impact_bps_q FROM feat",
)
def flow_and_impact(spark: SparkSession, sf: str) -> DataFrame:
    f = snaps_of(spark, sf).select("symbol", "ts", "features.*")
    return f.select(
        "symbol", "ts", rnd(F.col("flow_imbalance"), 6).alias("flow_imbalance"), rnd(F.col("impact_bps_q"), 6).alias("impact_bps_q")
    )


@query("data_health", FEAT + " SELECT symbol, ts, stale_book_ms, stale_trades_ms, missing_streams FROM feat")
def data_health(spark: SparkSession, sf: str) -> DataFrame:
    h = snaps_of(spark, sf).select("symbol", "ts", "data_health.*")
    return h.withColumn("missing_streams", joined("missing_streams"))


@query(
    "feature_snapshots",
    FEAT + """ SELECT symbol, ts, spread_bps, mid, book_imbalance, flow_imbalance, natr_14_5m, impact_bps_q, regime_vol,
    regime_trend FROM feat""",
)
def feature_snapshots_q(spark: SparkSession, sf: str) -> DataFrame:
    return snaps_of(spark, sf).select("symbol", "ts", "features.*")


_DATA_TICKS = """
    stamps AS (SELECT DISTINCT ts FROM tape),
    tk AS (SELECT min(ts) AS ts FROM stamps
      UNION ALL SELECT (SELECT min(s.ts) FROM stamps s WHERE s.ts >= tk.ts + 1000) FROM tk WHERE tk.ts IS NOT NULL),
    fired AS (SELECT ts, min((ts, recv_ts, seq)) AS place FROM tape WHERE ts IN (SELECT ts FROM tk) GROUP BY ts),
    firsts AS (SELECT symbol, min((ts, recv_ts, seq)) AS first FROM tape GROUP BY symbol)"""


@query(
    "snapshot_ticks",
    "WITH RECURSIVE " + S.TAPE + "," + _DATA_TICKS + """ SELECT f.ts, count(*) AS symbols
    FROM fired f JOIN firsts s ON s.first <= f.place GROUP BY 1""",
)
def snapshot_ticks(spark: SparkSession, sf: str) -> DataFrame:
    pairs, _ = thin.snapshot_ticks(tape_of(spark, sf))
    return pairs.groupBy("ts").agg(F.count(F.lit(1)).alias("symbols"))


@query(
    "limited_symbols",
    TAPE + """, f AS (SELECT symbol, min((ts, recv_ts, seq)) AS first FROM tape GROUP BY 1 ORDER BY 2, 1 LIMIT 500)
    SELECT symbol, count(*) AS n FROM tape WHERE symbol IN (SELECT symbol FROM f) GROUP BY 1""",
)
def limited_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return limit_symbols(tape_of(spark, sf), 500).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "asof_book",
    TAPE + """ SELECT t.symbol, t.seq, t.ts, arg_max(b.bid, (b.ts, b.seq)) AS bid, arg_max(b.ask, (b.ts, b.seq)) AS ask,
    coalesce(max(b.ts), -1) AS book_ts FROM tape t LEFT JOIN tape b ON b.symbol = t.symbol AND NOT b.is_trade AND b.ts <= t.ts
    WHERE t.is_trade GROUP BY 1, 2, 3""",
)
def asof_book(spark: SparkSession, sf: str) -> DataFrame:
    t = tape_of(spark, sf)
    books = t.filter("NOT is_trade").select("symbol", "ts", "bid", "ask", F.col("seq").alias("book_seq"))
    trades = t.filter("is_trade").select("symbol", "seq", "ts")
    rows = asof.asof_join(trades, books, ["symbol"], "book", tie="book_seq")
    return rows.select("symbol", "seq", "ts", "book.bid", "book.ask", F.coalesce("book.ts", F.lit(-1)).alias("book_ts"))


@query(
    "thin_by_gap",
    "WITH RECURSIVE " + S.TAPE + """, st AS (SELECT DISTINCT symbol, ts FROM tape WHERE is_trade),
    kept AS (SELECT symbol, min(ts) AS ts FROM st GROUP BY symbol
      UNION ALL SELECT s.symbol, min(s.ts) FROM kept k JOIN st s ON s.symbol = k.symbol AND s.ts >= k.ts + 15000 GROUP BY s.symbol, k.ts)
    SELECT t.symbol, t.ts, min(t.seq) AS seq FROM tape t JOIN kept USING (symbol, ts) WHERE t.is_trade GROUP BY 1, 2""",
)
def thin_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    t = tape_of(spark, sf).filter("is_trade").select("symbol", "ts", "seq")
    return thin.thin_by_gap(t, ["symbol"], "ts", 15_000, ["seq"])


# --- predictions ------------------------------------------------------------------------

_PRED_COLS = "symbol, ts, p_inplay_30s, p_inplay_2m, p_inplay_5m, expected_utility_bps_2m, p_toxic, status"


@query("baseline_predictions", PRED + f" SELECT {_PRED_COLS} FROM pred")
def baseline_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predict.predict_baseline(snaps_of(spark, sf), MC).select(*_PRED_COLS.split(", "))


def _reason_sql() -> str:
    d = "::DOUBLE"
    # The evidence of each code.
    evidence = {
        "'RC_GATE_SPREAD_FAIL'": "'Spread exceeds maximum threshold'",
        "'RC_GATE_IMPACT_FAIL'": "'Impact exceeds maximum threshold'",
        "'RC_FLOW_SURGE'": "'Strong ' || CASE WHEN flow_imbalance > 0 THEN 'buy' ELSE 'sell' END || ' flow imbalance'",
        "'RC_SPREAD_TIGHT'": "'Tight spread indicates good liquidity'",
        "'RC_SPREAD_WIDE'": "'Wide spread indicates poor liquidity'",
        "'RC_TOXIC_RISK_UP'": "'Elevated toxic flow risk'",
        "'RC_REGIME_HIGH_VOL'": "'High volatility regime'",
        "'RC_DATA_STALE'": "'Book data stale beyond threshold'",
    }
    lean = "'Book imbalance favors ' || CASE WHEN book_imbalance > 0 THEN 'long' ELSE 'short' END || ' side'"
    parts = [
        ("NOT bad AND spread_bps > 10", "'RC_GATE_SPREAD_FAIL'", S.rnd("spread_bps", 2), "bps"),
        ("NOT bad AND impact_bps_q > 20", "'RC_GATE_IMPACT_FAIL'", S.rnd("impact_bps_q", 2), "bps"),
        (f"NOT bad AND abs(flow_imbalance) > 0.3{d}", "'RC_FLOW_SURGE'", S.rnd("flow_imbalance", 3), "ratio"),
        (
            f"NOT bad AND abs(book_imbalance) > 0.3{d}",
            "'RC_FLOW_IMBALANCE_' || CASE WHEN book_imbalance > 0 THEN 'LONG' ELSE 'SHORT' END",
            S.rnd("book_imbalance", 3),
            "ratio",
        ),
        ("NOT bad AND spread_bps < 2", "'RC_SPREAD_TIGHT'", S.rnd("spread_bps", 2), "bps"),
        ("NOT bad AND spread_bps > 10", "'RC_SPREAD_WIDE'", S.rnd("spread_bps", 2), "bps"),
        (f"NOT bad AND tox > 0.5{d}", "'RC_TOXIC_RISK_UP'", S.rnd("tox", 3), "prob"),
        ("NOT bad AND regime_vol = 'high'", "'RC_REGIME_HIGH_VOL'", S.rnd("natr_14_5m", 4), "natr"),
        ("bad", "'RC_DATA_STALE'", "stale_book_ms::DOUBLE", "ms"),
    ]
    sel = " UNION ALL ".join(
        f"SELECT symbol, ts, {code} AS code, {value} AS value, '{unit}' AS unit, {evidence.get(code, lean)} AS evidence FROM pred WHERE {cond}"
        for cond, code, value, unit in parts
    )
    return f"{PRED}, r AS ({sel}) SELECT * FROM r"


@query("prediction_reasons", _reason_sql())
def prediction_reasons(spark: SparkSession, sf: str) -> DataFrame:
    p = predict.predict_baseline(snaps_of(spark, sf), MC)
    return p.select("symbol", "ts", F.inline("reasons"))


_RANK_CTE = f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS position
    FROM pred WHERE score >= {RC.score_threshold}::DOUBLE)"""


@query(
    "scores_topk",
    PRED + _RANK_CTE + f" SELECT ts, symbol, position, {S.rnd('score', 8)} AS score, status FROM ranked WHERE position <= {RC.top_k}",
)
def scores_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = ranking.top_k(preds_of(spark, sf), RC)
    return top.select("ts", "symbol", F.col("position").cast("long").alias("position"), rnd(F.col("score"), 8).alias("score"), "status")


@query(
    "status_counts",
    PRED + " SELECT symbol, status, count(*) AS n FROM pred GROUP BY ROLLUP (symbol, status)",
)
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return predict.status_counts(preds_of(spark, sf))


@query(
    "stable_keys",
    PRED + _RANK_CTE + """ SELECT symbol || ':ALERT:' || status || ':' || CASE WHEN position - 1 < 5 THEN 'top5'
    WHEN position - 1 < 10 THEN 'top10' ELSE 'other' END AS key, count(*) AS n FROM ranked GROUP BY 1""",
)
def stable_keys(spark: SparkSession, sf: str) -> DataFrame:
    r = ranking.rank_scores(preds_of(spark, sf), RC)
    key = delivery.stable_key(F.col("symbol"), F.lit("ALERT"), F.col("status"), F.col("position") - 1)
    return r.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def _toy_model(df: DataFrame) -> DataFrame:
    """A user model: clamped linear scores of the feature vector."""
    v = F.col("vector")
    return df.withColumns(
        {
            "p_inplay_30s": clamp(0.25 + 0.25 * v[2], 0.0, 1.0),
            "p_inplay_2m": clamp(0.5 + 0.25 * v[3] + 0.125 * v[6], 0.0, 1.0),
            "p_inplay_5m": clamp(0.5 + 0.25 * v[7], 0.0, 1.0),
            "p_toxic": clamp(v[5] / 32, 0.0, 1.0),
        }
    )


_MODEL_SQL = f"""
    m0 AS (SELECT symbol, ts, stale_book_ms > {MC.stale_book_max_ms} OR stale_trades_ms > {MC.stale_trades_max_ms} OR missing_streams <> '' AS bad,
      least(1, greatest(0, 0.5::DOUBLE + 0.25::DOUBLE * flow_imbalance + 0.125::DOUBLE * (regime_vol = 'high')::INT)) AS p2,
      least(1, greatest(0, impact_bps_q / 32)) AS tox, spread_bps > 10 OR impact_bps_q > 20 AS gated FROM feat),
    model AS (SELECT symbol, ts, CASE WHEN bad THEN 0 ELSE {S.rnd("p2", 4)} END AS p_inplay_2m, CASE WHEN bad THEN 0 ELSE {S.rnd("tox", 4)} END AS p_toxic,
      CASE WHEN bad THEN 'DATA_ISSUE' WHEN tox >= 0.7::DOUBLE THEN 'TRAP' WHEN p2 >= 0.6::DOUBLE AND gated THEN 'WATCH' WHEN p2 >= 0.6::DOUBLE THEN 'TRADEABLE'
      WHEN p2 >= 0.3::DOUBLE THEN 'WATCH' ELSE 'DEAD' END AS status FROM m0)"""


@query("model_predictions", FEAT + "," + _MODEL_SQL + " SELECT * FROM model")
def model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = predict.predict_model(snaps_of(spark, sf), _toy_model, cfg=MC)
    return p.select("symbol", "ts", "p_inplay_2m", "p_toxic", "status")


@query(
    "unscored_symbols",
    FEAT + "," + _MODEL_SQL + """ SELECT symbol, ts, CASE WHEN substr(symbol, 2)::BIGINT % 10 = 3 THEN 'DATA_ISSUE' ELSE status END AS status,
    CASE WHEN substr(symbol, 2)::BIGINT % 10 = 3 THEN 'RC_CALIBRATION_MISSING' ELSE '' END AS code FROM model""",
)
def unscored_symbols(spark: SparkSession, sf: str) -> DataFrame:
    users = load(spark, sf, "events").select("user_id").distinct()
    status = users.filter("user_id % 10 = 3").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.lit("RC_CALIBRATION_MISSING").alias("error_code"),
        F.lit("no file").alias("error_msg"),
    )
    score = lambda s: predict.predict_model(s, _toy_model, cfg=MC)
    p = predict.mark_unscored(snaps_of(spark, sf), status, score, cfg=MC)
    code = F.when(F.get("reasons", F.lit(0))["code"] == "RC_CALIBRATION_MISSING", F.lit("RC_CALIBRATION_MISSING"))
    return p.select("symbol", "ts", "status", F.coalesce(code, F.lit("")).alias("code"))


# --- ranking with hysteresis ------------------------------------------------------------

_FSM = f""", mem AS (SELECT symbol, ts, score, CASE WHEN score >= {RC.score_threshold}::DOUBLE THEN
      row_number() OVER (PARTITION BY ts ORDER BY score >= {RC.score_threshold}::DOUBLE DESC, score DESC, symbol) END AS position FROM pred),
    m AS MATERIALIZED (SELECT *, coalesce(position <= {RC.top_k}, false) AS member FROM mem),
    fsm AS (
      SELECT symbol, ts, CASE WHEN member THEN 'PE' ELSE 'N' END AS s, ts AS since, '' AS ev
      FROM (SELECT *, min(ts) OVER (PARTITION BY symbol) AS t0 FROM m) WHERE ts = t0
      UNION ALL
      SELECT symbol, ts, n AS s, CASE WHEN n <> p THEN ts ELSE since END,
        CASE WHEN p = 'PE' AND n = 'I' THEN 'SYMBOL_ENTER' WHEN p = 'PX' AND n = 'N' THEN 'SYMBOL_EXIT' ELSE '' END
      FROM (SELECT m.symbol, m.ts, f.s AS p, f.since, CASE
          WHEN f.s = 'N' THEN CASE WHEN m.member THEN 'PE' ELSE 'N' END
          WHEN f.s = 'PE' THEN CASE WHEN NOT m.member THEN 'N' WHEN m.ts - f.since >= {RC.enter_ms} THEN 'I' ELSE 'PE' END
          WHEN f.s = 'I' THEN CASE WHEN NOT m.member AND m.ts - f.since >= {RC.min_dwell_ms} THEN 'PX' ELSE 'I' END
          ELSE CASE WHEN m.member THEN 'I' WHEN m.ts - f.since >= {RC.exit_ms} THEN 'N' ELSE 'PX' END END AS n
        FROM fsm f JOIN m ON m.symbol = f.symbol AND m.ts = f.ts + 1000)),
    listed AS (SELECT f.*, m.score, CASE WHEN m.position IS NOT NULL AND f.s <> 'N' THEN row_number() OVER (PARTITION BY f.ts
      ORDER BY m.position IS NOT NULL AND f.s <> 'N' DESC, m.score DESC, f.symbol) - 1 END AS place FROM fsm f JOIN m USING (symbol, ts)),
    states AS (SELECT *, CASE WHEN place < {RC.top_k} THEN place END AS rank FROM listed),
    ranks AS (SELECT *, lag(rank) OVER w AS prev_rank,
      last_value(rank IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held_rank,
      last_value(rank IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_rank
      FROM states WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
_RANKED = "WITH RECURSIVE " + PRED_SQL + _FSM


@query(
    "hysteresis_events",
    _RANKED + f""" SELECT ts, ev AS event, symbol, coalesce(CASE WHEN ev = 'SYMBOL_ENTER' THEN prev_rank ELSE held_rank END, 0)::INT AS rank,
    {S.rnd("score", 8)} AS score FROM ranks WHERE ev <> ''""",
)
def hysteresis_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = ranking.rank_events(ranking.ranked_states(preds_of(spark, sf), RC))
    return ev.withColumn("score", rnd(F.col("score"), 8))


@query(
    "confirmed_topk",
    _RANKED + """ SELECT ts, symbol, rank::INT AS rank, CASE s WHEN 'PE' THEN 'PENDING_ENTER' WHEN 'I' THEN 'IN_TOP_K' ELSE 'PENDING_EXIT' END AS state
    FROM ranks WHERE rank IS NOT NULL""",
)
def confirmed_topk(spark: SparkSession, sf: str) -> DataFrame:
    st = ranking.confirmed_top_k(ranking.hysteresis(ranking.membership(preds_of(spark, sf), RC), RC), RC)
    return st.filter("rank IS NOT NULL").select("ts", "symbol", F.col("rank").cast("int").alias("rank"), "state")


# Updates every two seconds on a clock of one, so every other tick is skipped.
_SLOW = replace(RC, update_interval_ms=2_000, burst_delta=2.0)
_SLOW_RANKED = (
    "WITH RECURSIVE "
    + PRED_SQL
    + ", acc AS (SELECT * FROM pred WHERE (ts - (SELECT min(ts) FROM pred)) % 2000 = 0)"
    + _FSM.replace("FROM pred)", "FROM acc)").replace("f.ts + 1000", "f.ts + 2000")
)


@query(
    "ranker_metrics",
    _SLOW_RANKED + """, lists AS (SELECT ts, coalesce(string_agg(symbol, ',' ORDER BY rank) FILTER (rank IS NOT NULL), '') AS names FROM ranks GROUP BY ts),
    moved AS (SELECT names <> coalesce(lag(names) OVER (ORDER BY ts), '') AS changed FROM lists)
    SELECT (SELECT count(DISTINCT ts) FROM pred) AS updates_processed, (SELECT count(*) FROM ranks WHERE ev = 'SYMBOL_ENTER') AS enter_events,
      (SELECT count(*) FROM ranks WHERE ev = 'SYMBOL_EXIT') AS exit_events, (SELECT count(*) FROM moved WHERE changed) AS rank_changes,
      (SELECT count(DISTINCT ts) FROM pred) - (SELECT count(*) FROM lists) AS updates_throttled""",
)
def ranker_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = cut_lineage(preds_of(spark, sf))
    ticks = ranking.throttle(scored, _SLOW)
    return ranking.ranker_metrics(ranking.ranked_states(ranking.accepted(scored, ticks), _SLOW), ticks, _SLOW)


@query(
    "prediction_ranks",
    _RANKED + f""" SELECT symbol, ts, coalesce(last_rank, 0)::INT AS rank, {S.rnd("score", 8)} AS score FROM ranks""",
)
def prediction_ranks(spark: SparkSession, sf: str) -> DataFrame:
    p = preds_of(spark, sf)
    rows = attach_rank(p, ranking.ranked_states(p, RC))
    return rows.select("symbol", "ts", "rank", rnd(F.col("score"), 8).alias("score"))


@query(
    "score_steps",
    PRED + f""", a AS (SELECT symbol, ts, score, lag(score) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM pred)
    SELECT ts, {S.rnd("max(abs(score - coalesce(was, 0)))", 8)} AS max_delta FROM a WHERE score >= {RC.score_threshold}::DOUBLE GROUP BY ts""",
)
def score_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = ranking.score_deltas(preds_of(spark, sf), RC)
    return steps.select("ts", rnd(F.col("max_delta"), 8).alias("max_delta"))


# --- alerts and delivery ----------------------------------------------------------------

AC = AlertConfig(slice_ms=60_000)  # eleven slices of the market view

_RUNS = """, chg AS (SELECT symbol, ts, status, CASE WHEN status IS DISTINCT FROM lag(status) OVER (PARTITION BY symbol ORDER BY ts) THEN ts END AS c FROM pred),
    runs AS (SELECT symbol, ts, status, max(c) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS since FROM chg)"""


@query("status_runs", PRED + _RUNS + " SELECT symbol, ts, status, since AS status_since, ts - since AS status_ms FROM runs")
def status_runs_q(spark: SparkSession, sf: str) -> DataFrame:
    return status_runs(preds_of(spark, sf).select("symbol", "ts", "status"), ["symbol"], materialize=True)


# The sequential rule as recursion over ticks; the state is the list of alerts of the last 120 s.
_ALERTS = (
    "WITH RECURSIVE "
    + PRED_SQL
    + _RUNS
    + f""", cand AS MATERIALIZED (SELECT symbol, ts, status, since,
      CASE status WHEN 'TRADEABLE' THEN 'ALERT_TRADABLE' WHEN 'TRAP' THEN 'ALERT_TRAP' ELSE 'DATA_ISSUE' END AS event,
      CASE WHEN status = 'DATA_ISSUE' THEN ts - since >= {AC.data_issue_ms} ELSE ts - since >= {AC.stable_ms} END AS stable
      FROM runs WHERE status IN ('TRADEABLE', 'TRAP', 'DATA_ISSUE')),
    per_tick AS MATERIALIZED (SELECT ts, list((symbol || '|' || event) ORDER BY symbol) AS names FROM cand WHERE stable GROUP BY ts),
    t_all AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY ts) AS i, names FROM per_tick),
    sim AS (
      SELECT 0::BIGINT AS i, 0::BIGINT AS ts, []::STRUCT(t BIGINT, k VARCHAR)[] AS live, []::VARCHAR[] AS fresh
      UNION ALL
      SELECT i, ts, list_concat(old, list_transform(fresh, lambda x: {{'t': ts, 'k': x}})), fresh FROM (
        SELECT i, ts, old, list_filter(names, lambda n: NOT list_contains(list_transform(old, lambda o: o.k), n))
          [1:greatest(0, {AC.max_per_min} - len(list_filter(old, lambda o: o.t >= ts - 60000)))] AS fresh FROM (
          SELECT t.i, t.ts, t.names, list_filter(s.live, lambda o: o.t > t.ts - {AC.cooldown_ms}) AS old
          FROM sim s JOIN t_all t ON t.i = s.i + 1))),
    accepted AS (SELECT ts, unnest(fresh) AS k FROM sim)"""
)


@query(
    "alerts",
    _ALERTS + " SELECT ts, split_part(k, '|', 1) AS symbol, split_part(k, '|', 2) AS event FROM accepted",
)
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    p = preds_of(spark, sf).select("ts", "symbol", "status")
    return al.accept(al.candidates(p, AC).filter("stable"), AC)


@query(
    "alert_metrics",
    _ALERTS + f""", acc AS (SELECT ts, split_part(k, '|', 1) AS symbol, split_part(k, '|', 2) AS event FROM accepted),
    d AS (SELECT c.*, a.ts IS NOT NULL AS taken, (SELECT count(*) FROM acc b WHERE b.ts >= c.ts - 60000 AND (b.ts < c.ts OR b.ts = c.ts AND b.symbol < c.symbol)) AS seen
      FROM cand c LEFT JOIN acc a USING (ts, symbol, event))
    SELECT CASE WHEN taken THEN 'generated' WHEN NOT stable THEN 'stability' WHEN seen >= {AC.max_per_min} THEN 'rate_limit' ELSE 'cooldown' END AS decision,
      count(*) AS n FROM d WHERE stable OR status <> 'DATA_ISSUE' GROUP BY 1""",
)
def alert_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = preds_of(spark, sf).select("ts", "symbol", "status")
    return al.alert_metrics(al.alert_decisions(p, AC))


_MOVES = """, moves AS (SELECT symbol, ts, status, 'STATUS' AS event FROM runs WHERE since = ts)"""


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    """One event per change of a symbol's status."""
    runs = status_runs(preds_of(spark, sf).select("symbol", "ts", "status"), ["symbol"], materialize=True)
    return runs.filter("status_ms = 0").select("symbol", "ts", "status", F.lit("STATUS").alias("event"))


@query(
    "cached_text",
    "WITH RECURSIVE " + PRED_SQL + _RUNS + _MOVES + """, mv AS MATERIALIZED (SELECT * FROM moves),
    made AS (SELECT symbol, min(ts) AS ts FROM mv GROUP BY 1
      UNION ALL SELECT s.symbol, min(s.ts) FROM made k JOIN mv s ON s.symbol = k.symbol AND s.ts >= k.ts + 60000 GROUP BY s.symbol, k.ts)
    SELECT v.symbol, v.ts, arg_max(lower(o.status) || '@' || o.ts, o.ts) AS text, (max(o.ts) = v.ts)::INT AS fresh
    FROM mv v JOIN mv o ON o.symbol = v.symbol AND o.ts <= v.ts JOIN made m ON m.symbol = o.symbol AND m.ts = o.ts GROUP BY 1, 2""",
)
def cached_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lower("status"), F.lit("@"), F.col("ts").cast("string"))
    rows = al.cached_text(_moves(spark, sf).withColumn("text", text), "text", AC)
    return rows.select("symbol", "ts", "text", flag(F.col("fresh")).alias("fresh"))


DC = DeliveryConfig(slice_ms=60_000)

_DELIVERIES = (
    "WITH RECURSIVE "
    + PRED_SQL
    + _RUNS
    + _MOVES
    + f""", n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, symbol) AS i, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS j FROM moves),
    sim AS (
      SELECT 0::BIGINT AS i, ''::VARCHAR AS symbol, 0::BIGINT AS ts, ''::VARCHAR AS decision, []::STRUCT(t BIGINT, k VARCHAR)[] AS live,
        MAP([]::VARCHAR[], []::VARCHAR[]) AS st
      UNION ALL
      SELECT i, symbol, ts, decision, CASE WHEN decision = 'passed' THEN list_append(old, {{'t': ts, 'k': symbol}}) ELSE old END,
        CASE WHEN decision = 'passed' THEN map_concat(st, MAP([symbol], [status])) ELSE st END FROM (
        SELECT *, CASE WHEN len(list_filter(old, lambda o: o.t >= ts - 60000)) >= {DC.max_per_min} THEN 'rate_limit'
          WHEN list_contains(list_transform(old, lambda o: o.k), symbol) THEN 'cooldown'
          WHEN st[symbol] = status THEN 'duplicate' ELSE 'passed' END AS decision FROM (
          SELECT n.i, n.symbol, n.ts, n.status, s.st, list_filter(s.live, lambda o: o.t > n.ts - {DC.cooldown_ms}) AS old
          FROM sim s JOIN n ON n.i = s.i + 1)))"""
)


@query("deliveries", _DELIVERIES + " SELECT ts, symbol, decision FROM sim WHERE i > 0")
def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.dedupe_deliveries(_moves(spark, sf), DC).select("ts", "symbol", "decision")


# Icons, labels and templates of the messages.
_ICON = "CASE status WHEN 'TRADEABLE' THEN '✅' WHEN 'TRAP' THEN '⚠️' WHEN 'DATA_ISSUE' THEN '❌' ELSE 'ℹ️' END"
_LABEL = "CASE status WHEN 'TRADEABLE' THEN 'Tradeable' WHEN 'TRAP' THEN 'Trap - Avoid' WHEN 'DATA_ISSUE' THEN 'Data Issue' ELSE 'OTHER' END"
_CLOCK = "strftime(epoch_ms(ts), '%Y-%m-%d %H:%M:%S') || ' UTC'"
_NUM = "printf('%.4f', score)", "printf('%.2f', p_inplay_2m * 100) || '%'", "printf('%.2f', p_toxic * 100) || '%'"


def _message_sql(kind: str) -> str:
    b0, b1 = {"text": ("", ""), "html": ("<b>", "</b>"), "markdown": ("*", "*")}[kind]
    i0, i1 = {"text": ("", ""), "html": ("<i>", "</i>"), "markdown": ("_", "_")}[kind]
    esc = "replace(status, '_', '\\_')" if kind == "markdown" else "status"
    tag = lambda n: f"'{i0}{n}:{i1} '"
    return f"""concat_ws(chr(10), {_ICON} || ' {b0}' || symbol || '{b1} - ' || {_LABEL}, {tag("Time")} || {_CLOCK},
      {tag("Rank")} || '#1 | ' || {tag("Score")} || {_NUM[0]}, {tag("Status")} || {esc}, {tag("p_inplay")} || {_NUM[1]}, {tag("p_toxic")} || {_NUM[2]})"""


# What several formats read is computed once.
_ONCE = PRED + _RUNS + ", said AS (SELECT p.* FROM pred p JOIN runs r USING (symbol, ts) WHERE r.since = r.ts)"
_SAID = re.sub(r"\b(roll|feat|pred|said) AS \(", r"\1 AS MATERIALIZED (", _ONCE)


def _said(spark: SparkSession, sf: str) -> DataFrame:
    runs = status_runs(preds_of(spark, sf), ["symbol"], materialize=True).filter("status_ms = 0")
    kind = (
        F.when(F.col("status") == "TRADEABLE", "ALERT_TRADABLE")
        .when(F.col("status") == "TRAP", "ALERT_TRAP")
        .when(F.col("status") == "DATA_ISSUE", "DATA_ISSUE")
        .otherwise("OTHER")
    )
    return runs.select(
        "ts", kind.alias("event"), "symbol", F.lit(0).alias("rank"), "score", "status", "p_inplay_2m", "p_toxic",
        F.lit("").alias("llm_text"),
    )


@query(
    "messages",
    _SAID + f" SELECT symbol, ts, {_message_sql('text')} AS text, {_message_sql('html')} AS html, {_message_sql('markdown')} AS markdown FROM said",
)
def messages(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.messages(_said(spark, sf)).select("symbol", "ts", "text", "html", "markdown")


@query(
    "digests",
    _SAID + f""", m AS (SELECT symbol, ts, {_message_sql('text')} AS text FROM said)
    SELECT ts AS batch, count(*)::INT AS n, CASE WHEN count(*) = 1 THEN min(text) ELSE '=== ' || count(*) || ' Alerts (' || {_CLOCK} || ') ===' || chr(10) || chr(10)
      || string_agg(text, chr(10) || chr(10) ORDER BY symbol) END AS text FROM m GROUP BY ts""",
)
def digests(spark: SparkSession, sf: str) -> DataFrame:
    rows = _said(spark, sf).withColumn("batch", F.col("ts"))
    return delivery.format_digest(rows, "batch").select("batch", "n", "text")


@query(
    "row_digests",
    PRED + _RUNS + """ SELECT symbol, ts, sha256('{"status":"' || status || '","symbol":"' || symbol || '","ts":' || ts || '}') AS digest
    FROM runs WHERE since = ts""",
)
def row_digests(spark: SparkSession, sf: str) -> DataFrame:
    return _moves(spark, sf).select("symbol", "ts", row_digest("ts", "symbol", "status").alias("digest"))


@query(
    "replay_diff",
    TAPE + """ SELECT 'missing' AS side, symbol, ts, seq FROM tape WHERE seq % 97 = 0
    UNION ALL SELECT 'unexpected', symbol, ts + 1, seq FROM tape WHERE seq % 97 = 0""",
)
def replay_diff(spark: SparkSession, sf: str) -> DataFrame:
    t = tape_of(spark, sf).select("symbol", "ts", "seq")
    moved = t.withColumn("ts", F.when(F.col("seq") % 97 == 0, F.col("ts") + 1).otherwise(F.col("ts")))
    return compare_events(moved, t)


@query("replay")
def replay_q(spark: SparkSession, sf: str) -> DataFrame:
    cfg = ChainConfig(features=FC, model=MC, rank=RC, max_symbols=None, with_text=True)
    return chain_events(preds_of(spark, sf), cfg).drop("prediction")


_REPLAYED = (
    _RANKED
    + _ALERTS.removeprefix("WITH RECURSIVE " + PRED_SQL)
    + f""" SELECT ts, ev AS event, symbol, coalesce(CASE WHEN ev = 'SYMBOL_ENTER' THEN prev_rank ELSE held_rank END, 0)::INT AS rank,
      {S.rnd("score", 8)} AS score, NULL::VARCHAR AS status, NULL::DOUBLE AS p_inplay_2m, NULL::DOUBLE AS p_toxic FROM ranks WHERE ev <> ''
    UNION ALL
    SELECT a.ts, a.event, a.symbol, coalesce(r.last_rank, 0)::INT, {S.rnd("r.score", 8)}, p.status, p.p_inplay_2m, p.p_toxic
    FROM (SELECT ts, split_part(k, '|', 1) AS symbol, split_part(k, '|', 2) AS event FROM accepted) a
    JOIN ranks r USING (symbol, ts) JOIN pred p USING (symbol, ts)"""
)


@query("replay_events", _REPLAYED)
def replay_events(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: rank events and alerts, throttled and with absent symbols, without texts."""
    ev = chain_events(preds_of(spark, sf), ChainConfig(features=FC, model=MC, rank=RC, alert=AC))
    return ev.select("ts", "event", "symbol", "rank", rnd(F.col("score"), 8).alias("score"), "status", "p_inplay_2m", "p_toxic")


@query(
    "model_versions",
    """
    WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'baseline-v1.' || user_id % 10 || '.0+abcdef0'
        WHEN event_id % 3 = 1 THEN '2.' || user_id % 10 || '.3+0123abc+20240101+deadbeef' ELSE 'v' || user_id END AS version FROM events)
    SELECT version, count(*) AS n, max(regexp_extract(version, '([0-9]+)\\.([0-9]+)\\.([0-9]+)', 2)::INT) AS minor,
      max(CASE WHEN version LIKE 'baseline%' THEN 'abcdef0' ELSE '0123abc' END) AS git_sha,
      max(CASE WHEN version LIKE 'baseline%' THEN '00000000' ELSE '20240101' END) AS data_cutoff
    FROM v WHERE version NOT LIKE 'v%' GROUP BY version""",
)
def model_versions(spark: SparkSession, sf: str) -> DataFrame:
    u = (F.col("user_id") % 10).cast("string")
    v = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("baseline-v1."), u, F.lit(".0+abcdef0")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("2."), u, F.lit(".3+0123abc+20240101+deadbeef")))
        .otherwise(F.concat(F.lit("v"), F.col("user_id").cast("string")))
    )
    rows = load(spark, sf, "events").select(v.alias("version")).withColumn("m", parse_model_version(F.col("version")))
    return rows.filter("m IS NOT NULL").groupBy("version").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("m.minor").alias("minor"),
        F.max("m.git_sha").alias("git_sha"),
        F.max("m.data_cutoff").alias("data_cutoff"),
    )


@query(
    "run_summary",
    PRED + _RUNS + f""", e AS (SELECT count(*) AS n, avg(recv_ts - ts) AS lat, max(recv_ts - ts) AS mx, min(ts) AS t0 FROM tape),
    p AS (SELECT count(*) AS n, max(ts) AS t1 FROM pred), a AS (SELECT count(*) AS n FROM runs WHERE since = ts)
    SELECT 'r1' AS run_id, e.n AS market_events, {S.rnd("e.n / ((p.t1 - e.t0) / 1000.0::DOUBLE)", 4)} AS events_per_second, p.n AS snapshots, p.n AS predictions,
      a.n AS alerts, {S.rnd("e.lat", 6)} AS avg_latency_ms, e.mx AS max_latency_ms FROM e, p, a""",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    run = lambda df: df.withColumn("run_id", F.lit("r1"))
    p = preds_of(spark, sf)
    s = monitor.run_summary(run(tape_of(spark, sf)), run(snaps_of(spark, sf)), run(p), run(_moves(spark, sf)))
    return s.withColumns(
        {
            "events_per_second": rnd(F.col("events_per_second"), 4),
            "avg_latency_ms": rnd(F.col("avg_latency_ms"), 6),
        }
    )


@query(
    "readiness",
    TAPE + """, k AS (SELECT max(ts) AS last_ts FROM tape)
    SELECT last_ts, 648000 - last_ts AS age_ms, (648000 - last_ts <= 30000)::INT AS ready FROM k""",
)
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    r = monitor.readiness(tape_of(spark, sf), 648_000)
    return r.withColumn("ready", flag(F.col("ready")))


