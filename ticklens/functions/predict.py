"""Heuristic prediction as column expressions over flat feature columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticklens.config import ModelConfig, ScoreConfig
from ticklens.functions.numeric import clamp, rnd

REASON = "struct<code:string,value:double,unit:string,evidence:string>"


def p_inplay_base(spread: Column, book: Column, flow: Column) -> Column:
    """Tight spread and strong imbalances raise it, agreeing directions more so."""
    tight = clamp(F.lit(1.0) / F.greatest(spread, F.lit(0.1)), 0.1, 1.0)
    agree = F.when(book * flow > 0, 1.2).otherwise(0.8)
    return clamp((0.3 * tight + 0.35 * F.abs(book) + 0.35 * F.abs(flow)) * agree, 0.0, 1.0)


def regime_multiplier(vol: Column, trend: Column) -> Column:
    high, trending = vol == "high", trend == "trend"
    return (
        F.when(high & trending, 1.3).when(high, 0.7).when(trending, 1.0).otherwise(0.5)
    )


# Factor on the base probability per horizon.
HORIZON_FACTORS = {"30s": 0.8, "2m": 1.0, "5m": 1.1}


def p_inplay(base: Column, multiplier: Column, horizon: str) -> Column:
    factor = HORIZON_FACTORS[horizon]
    scaled = base if factor == 1.0 else base * factor
    return F.least(F.lit(1.0), scaled * multiplier)


def p_toxic(impact: Column, flow: Column) -> Column:
    return clamp(0.4 * F.least(F.lit(1.0), impact / 50.0) + 0.6 * (flow * flow), 0.0, 1.0)


def expected_utility(p: Column, toxic: Column, natr: Column, spread: Column, impact: Column) -> Column:
    return p * (natr * 100) * (1 - toxic) - toxic * (spread + impact)


def gate_failures(spread: Column, impact: Column, cfg: ModelConfig) -> Column:
    return F.array_compact(
        F.array(
            F.when(spread > cfg.spread_max_bps, F.lit("GATE_SPREAD")),
            F.when(impact > cfg.impact_max_bps, F.lit("GATE_IMPACT")),
        )
    )


def status(p2m: Column, toxic: Column, gates_failed: Column, cfg: ModelConfig) -> Column:
    return (
        F.when(toxic >= cfg.toxic_threshold, "TRAP")
        .when((p2m >= cfg.tradeable_threshold) & gates_failed, "WATCH")
        .when(p2m >= cfg.tradeable_threshold, "TRADEABLE")
        .when(p2m >= cfg.watch_threshold, "WATCH")
        .otherwise("DEAD")
    )


def reason(code: Column | str, value: Column, unit: str, evidence: Column | str) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        as_col(code).alias("code"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        as_col(evidence).alias("evidence"),
    )


# The codes, units and evidence texts of the reasons below.


def _gate_and_flow_reasons(cfg: ModelConfig) -> list[Column]:
    spread, impact = F.col("spread_bps"), F.col("impact_bps_q")
    flow, book = F.col("flow_imbalance"), F.col("book_imbalance")
    side = F.when(flow > 0, F.lit("buy")).otherwise(F.lit("sell"))
    lean = F.when(book > 0, F.lit("LONG")).otherwise(F.lit("SHORT"))
    return [
        F.when(
            spread > cfg.spread_max_bps,
            reason("RC_GATE_SPREAD_FAIL", rnd(spread, 2), "bps", "Spread exceeds maximum threshold"),
        ),
        F.when(
            impact > cfg.impact_max_bps,
            reason("RC_GATE_IMPACT_FAIL", rnd(impact, 2), "bps", "Impact exceeds maximum threshold"),
        ),
        F.when(
            F.abs(flow) > 0.3,
            reason(
                "RC_FLOW_SURGE",
                rnd(flow, 3),
                "ratio",
                F.concat(F.lit("Strong "), side, F.lit(" flow imbalance")),
            ),
        ),
        F.when(
            F.abs(book) > 0.3,
            reason(
                F.concat(F.lit("RC_FLOW_IMBALANCE_"), lean),
                rnd(book, 3),
                "ratio",
                F.concat(F.lit("Book imbalance favors "), F.lower(lean), F.lit(" side")),
            ),
        ),
    ]


def _toxic_reason(toxic: Column) -> Column:
    return F.when(
        toxic > 0.5, reason("RC_TOXIC_RISK_UP", rnd(toxic, 3), "prob", "Elevated toxic flow risk")
    )


def baseline_reasons(toxic: Column, cfg: ModelConfig) -> Column:
    """Ordered reason codes of the heuristic model."""
    spread, natr = F.col("spread_bps"), F.col("natr_14_5m")
    tail = [
        F.when(
            spread < 2,
            reason("RC_SPREAD_TIGHT", rnd(spread, 2), "bps", "Tight spread indicates good liquidity"),
        ).when(
            spread > 10,
            reason("RC_SPREAD_WIDE", rnd(spread, 2), "bps", "Wide spread indicates poor liquidity"),
        ),
        _toxic_reason(toxic),
        F.when(
            F.col("regime_vol") == "high",
            reason("RC_REGIME_HIGH_VOL", rnd(natr, 4), "natr", "High volatility regime"),
        ),
    ]
    return F.array_compact(F.array(*_gate_and_flow_reasons(cfg), *tail))


def model_reasons(p2m: Column, raw2m: Column, toxic: Column, calibrated: bool, cfg: ModelConfig) -> Column:
    """Ordered reason codes of a scored model: calibration shift instead of spread and regime."""
    tail = [_toxic_reason(toxic)]
    if calibrated:
        shift = F.when(
            F.abs(raw2m - p2m) > 0.01,
            reason("RC_CALIBRATION_ADJ", rnd(p2m - raw2m, 3), "delta", "Calibration adjustment applied"),
        )
        tail.insert(0, shift)
    return F.array_compact(F.array(*_gate_and_flow_reasons(cfg), *tail))


def stale_reasons(stale_book_ms: Column) -> Column:
    return F.array(
        reason("RC_DATA_STALE", stale_book_ms, "ms", "Book data stale beyond threshold")
    )


def score(cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Ranking score in [0, 1] from the prediction columns."""
    p = (
        cfg.w_30s * F.col("p_inplay_30s")
        + cfg.w_2m * F.col("p_inplay_2m")
        + cfg.w_5m * F.col("p_inplay_5m")
    )
    utility = clamp(F.col("expected_utility_bps_2m"), 0.0, cfg.utility_max_bps) / cfg.utility_max_bps
    penalty = F.lit(1.0) - cfg.toxic_alpha * F.col("p_toxic")
    return clamp(p * utility * penalty, 0.0, 1.0)
