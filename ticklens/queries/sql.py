"""Building blocks of the check SQL (DuckDB dialect)."""

from __future__ import annotations

from ticklens.config import FeatureConfig, ModelConfig, ScoreConfig


def rnd(x: str, digits: int) -> str:
    scale = 10**digits
    return f"(floor(({x}) * {scale}.0::DOUBLE + 0.5::DOUBLE) / {scale}.0::DOUBLE)"


BASE = """
base AS (
  SELECT 'U' || user_id AS symbol,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 4000000 AS ts,
         event_id AS seq, event_type NOT IN ('view', 'signup') AS is_trade,
         (1000000 + floor(value * 100 + 0.5::DOUBLE))::DOUBLE AS px,
         regexp_extract(props, '[0-9]+')::BIGINT AS k
  FROM events
)"""

TAPE = (
    BASE
    + """,
tape AS (
  SELECT symbol, ts, ts + seq % 50 AS recv_ts, seq, is_trade,
    CASE WHEN is_trade THEN px END AS price,
    CASE WHEN is_trade THEN (1 + seq % 10)::DOUBLE END AS qty,
    CASE WHEN is_trade THEN seq % 3 = 1 END AS maker,
    CASE WHEN NOT is_trade THEN px - k * 7 END AS bid,
    CASE WHEN NOT is_trade THEN px + k * 7 END AS ask,
    CASE WHEN NOT is_trade THEN (1 + k)::DOUBLE END AS bid_qty,
    CASE WHEN NOT is_trade THEN (100 - k)::DOUBLE END AS ask_qty
  FROM base
)"""
)


def ticks(cadence: int = 1000) -> str:
    return f"""
tick AS (
  SELECT symbol, unnest(generate_series(lo, (SELECT (max(ts) + {cadence - 1}) // {cadence} * {cadence} FROM tape), {cadence})) AS t
  FROM (SELECT symbol, (min(ts) + {cadence - 1}) // {cadence} * {cadence} AS lo FROM tape GROUP BY symbol)
)"""


def features(cfg: FeatureConfig = FeatureConfig()) -> str:
    """CTEs up to ``feat``: flat features per (symbol, tick) by a plain range join."""
    sums = ",\n".join(
        f"""    count(price) FILTER (ts > t - {w}) AS n_{k},
    coalesce(sum(qty) FILTER (ts > t - {w}), 0)::DOUBLE AS vol_{k},
    coalesce(sum(qty) FILTER (ts > t - {w} AND NOT maker), 0)::DOUBLE AS buy_{k},
    coalesce(sum(qty) FILTER (ts > t - {w} AND maker), 0)::DOUBLE AS sell_{k},
    coalesce(sum(price * qty) FILTER (ts > t - {w}), 0)::DOUBLE AS pv_{k}"""
        for k, w in (("w1s", 1000), ("w10s", 10000), ("w60s", 60000))
    )
    return (
        TAPE
        + ","
        + ticks(cfg.cadence_ms)
        + f""",
framed AS (
  SELECT k.symbol, k.t, p.ts, p.price, p.qty, p.maker,
    lag(p.price, 1) OVER w AS p1, lag(p.price, 2) OVER w AS p2
  FROM tick k LEFT JOIN (SELECT * FROM tape WHERE is_trade) p
    ON p.symbol = k.symbol AND p.ts > k.t - 300000 AND p.ts <= k.t
  WINDOW w AS (PARTITION BY k.symbol, k.t ORDER BY p.ts, p.seq)
),
roll AS (
  SELECT symbol, t AS ts, count(price) AS n_range, sum(price) AS psum, min(price) AS pmin, max(price) AS pmax,
    count(*) FILTER ((price - p1) * (p1 - p2) < 0) AS turns,
{sums}
  FROM framed GROUP BY symbol, t
),
quoted AS (
  SELECT k.symbol, k.t AS ts, arg_max(bid, (b.ts, seq)) AS bid, arg_max(ask, (b.ts, seq)) AS ask,
    arg_max(bid_qty, (b.ts, seq)) AS bid_qty, arg_max(ask_qty, (b.ts, seq)) AS ask_qty,
    max(b.ts) AS book_ts
  FROM tick k LEFT JOIN (SELECT * FROM tape WHERE NOT is_trade) b ON b.symbol = k.symbol AND b.ts <= k.t
  GROUP BY k.symbol, k.t
),
traded AS (
  SELECT k.symbol, k.t AS ts, max(p.ts) AS trade_ts
  FROM tick k LEFT JOIN (SELECT * FROM tape WHERE is_trade) p ON p.symbol = k.symbol AND p.ts <= k.t
  GROUP BY k.symbol, k.t
),
f0 AS (
  SELECT r.*, q.bid, q.ask, q.bid_qty, q.ask_qty,
    CASE WHEN (bid + ask) / 2 > 0 THEN (ask - bid) / ((bid + ask) / 2) * 10000 ELSE 0 END::DOUBLE AS spread_bps,
    CASE WHEN (bid + ask) / 2 > 0 THEN (bid + ask) / 2 ELSE 1 END::DOUBLE AS mid,
    CASE WHEN bid_qty + ask_qty > 0 THEN (bid_qty - ask_qty) / (bid_qty + ask_qty) ELSE 0 END::DOUBLE AS book_imbalance,
    CASE WHEN buy_w10s + sell_w10s > 0 THEN (buy_w10s - sell_w10s) / (buy_w10s + sell_w10s) ELSE 0 END::DOUBLE AS flow_imbalance,
    CASE WHEN n_range >= 2 THEN (pmax - pmin) / (psum / n_range) ELSE 0 END::DOUBLE AS natr_14_5m,
    CASE WHEN n_range >= {cfg.trend_min_prices} AND turns / (n_range - 1) < {cfg.trend_max_reversals}::DOUBLE
      THEN 'trend' ELSE 'chop' END AS regime_trend,
    coalesce(r.ts - book_ts, 0) AS stale_book_ms, coalesce(r.ts - trade_ts, 0) AS stale_trades_ms
  FROM roll r JOIN quoted q USING (symbol, ts) JOIN traded d USING (symbol, ts)
),
feat AS (
  SELECT *,
    CASE WHEN n_w10s > 0 THEN spread_bps * (1 + {cfg.impact_ref_qty}::DOUBLE / (vol_w10s / n_w10s) * 0.1::DOUBLE)
      ELSE spread_bps END AS impact_bps_q,
    CASE WHEN natr_14_5m > {cfg.high_vol_natr}::DOUBLE THEN 'high' ELSE 'low' END AS regime_vol,
    concat_ws(',', CASE WHEN stale_book_ms > {cfg.missing_book_ms} THEN 'book' END,
      CASE WHEN stale_trades_ms > {cfg.missing_trades_ms} THEN 'trades' END) AS missing_streams
  FROM f0
)"""
    )


def predictions(fc: FeatureConfig, mc: ModelConfig, sc: ScoreConfig = ScoreConfig()) -> str:
    """CTEs up to ``pred``: heuristic predictions with their score."""
    d = "::DOUBLE"
    return (
        features(fc)
        + f""",
h0 AS (
  SELECT *,
    least(1{d}, greatest(0{d}, (0.3{d} * greatest(0.1{d}, least(1{d}, 1{d} / greatest(spread_bps, 0.1{d})))
      + 0.35{d} * abs(book_imbalance) + 0.35{d} * abs(flow_imbalance))
      * CASE WHEN book_imbalance * flow_imbalance > 0 THEN 1.2{d} ELSE 0.8{d} END)) AS base,
    CASE WHEN regime_vol = 'high' AND regime_trend = 'trend' THEN 1.3{d} WHEN regime_vol = 'high' THEN 0.7{d}
      WHEN regime_trend = 'trend' THEN 1{d} ELSE 0.5{d} END AS mult,
    least(1{d}, greatest(0{d}, 0.4{d} * least(1{d}, impact_bps_q / 50{d}) + 0.6{d} * (flow_imbalance * flow_imbalance))) AS tox,
    stale_book_ms > {mc.stale_book_max_ms} OR stale_trades_ms > {mc.stale_trades_max_ms} OR missing_streams <> '' AS bad
  FROM feat
),
h1 AS (
  SELECT *, least(1{d}, base * 0.8{d} * mult) AS p30, least(1{d}, base * mult) AS p2, least(1{d}, base * 1.1{d} * mult) AS p5,
    spread_bps > {mc.spread_max_bps}{d} OR impact_bps_q > {mc.impact_max_bps}{d} AS gated
  FROM h0
),
h2 AS (
  SELECT symbol, ts, spread_bps, impact_bps_q, flow_imbalance, book_imbalance, natr_14_5m, regime_vol, stale_book_ms, bad, tox,
    CASE WHEN bad THEN 0 ELSE {rnd("p30", 4)} END AS p_inplay_30s,
    CASE WHEN bad THEN 0 ELSE {rnd("p2", 4)} END AS p_inplay_2m,
    CASE WHEN bad THEN 0 ELSE {rnd("p5", 4)} END AS p_inplay_5m,
    CASE WHEN bad THEN 0 ELSE {rnd(f"p2 * (natr_14_5m * 100) * (1 - tox) - tox * (spread_bps + impact_bps_q)", 2)} END AS expected_utility_bps_2m,
    CASE WHEN bad THEN 0 ELSE {rnd("tox", 4)} END AS p_toxic,
    CASE WHEN bad THEN 'DATA_ISSUE' WHEN tox >= {mc.toxic_threshold}{d} THEN 'TRAP'
      WHEN p2 >= {mc.tradeable_threshold}{d} AND gated THEN 'WATCH' WHEN p2 >= {mc.tradeable_threshold}{d} THEN 'TRADEABLE'
      WHEN p2 >= {mc.watch_threshold}{d} THEN 'WATCH' ELSE 'DEAD' END AS status
  FROM h1
),
pred AS (
  SELECT *, least(1{d}, greatest(0{d},
    ({sc.w_30s}{d} * p_inplay_30s + {sc.w_2m}{d} * p_inplay_2m + {sc.w_5m}{d} * p_inplay_5m)
    * (greatest(0{d}, least(expected_utility_bps_2m, {sc.utility_max_bps}{d})) / {sc.utility_max_bps}{d})
    * (1{d} - {sc.toxic_alpha}{d} * p_toxic))) AS score
  FROM h2
)"""
    )
