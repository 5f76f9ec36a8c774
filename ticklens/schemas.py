"""Row types, and the rules a row of each contract must meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ticklens.config import STATUSES

# Event types and the fields of an event.
EVENT_TYPES = ("trade", "book", "kline", "mark", "oi", "funding")

MARKET_EVENT = T.StructType(
    [
        T.StructField("ts", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("recv_ts", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Rule:
    """One field of a contract: JSON path, SQL type, and what its value must meet."""

    path: str
    type: str = "string"
    required: bool = True
    ge: float | None = None
    le: float | None = None
    gt: float | None = None
    one_of: tuple[str, ...] = ()
    non_empty: bool = False


def _num(path: str, ge: float | None = None, le: float | None = None, gt: float | None = None) -> Rule:
    return Rule(path, "double", True, ge, le, gt)


def _ms(path: str) -> Rule:
    return Rule(path, "bigint", True, ge=0)


def _text(path: str, required: bool = True) -> Rule:
    return Rule(path, "string", required, non_empty=True)


def _dec(*paths: str, required: bool = True) -> list[Rule]:
    return [Rule(p, "decimal(38,18)", required) for p in paths]


# Fields and limits of the contracts.
SIDES = ("BUY", "SELL")
ORDER_TYPES = ("LIMIT", "MARKET", "STOP_MARKET")
TIME_IN_FORCE = ("GTC", "IOC", "FOK", "GTX")
ORDER_STATUSES = ("NEW", "PARTIALLY_FILLED", "FILLED", "CANCELED", "REJECTED", "EXPIRED")
SESSION_STATES = ("INITIALIZING", "READY", "ACTIVE", "PAUSED", "STOPPING", "STOPPED", "KILLED")
BREACH_TYPES = (
    "DAILY_LOSS_LIMIT",
    "POSITION_SIZE_LIMIT",
    "EXPOSURE_LIMIT",
    "ORDER_RATE_LIMIT",
    "CONSECUTIVE_LOSS",
    "DRAWDOWN_LIMIT",
)
RANK_EVENT_TYPES = ("SYMBOL_ENTER", "SYMBOL_EXIT", "ALERT_TRADABLE", "ALERT_TRAP", "DATA_ISSUE")

_HEALTH = [
    Rule("data_health.stale_book_ms", "bigint", False, ge=0),
    Rule("data_health.stale_trades_ms", "bigint", False, ge=0),
    Rule("data_health.missing_streams", "string", False),
]
_SESSION = [_text("session_id"), Rule("schema_version", "string", False), _ms("ts")]

CONTRACTS: dict[str, list[Rule]] = {
    "market_event": [
        _ms("ts"),
        _text("source"),
        _text("symbol"),
        Rule("type", one_of=EVENT_TYPES),
        Rule("payload", "string", False),
        _ms("recv_ts"),
    ],
    "feature_snapshot": [
        _ms("ts"),
        _text("symbol"),
        _num("features.spread_bps"),
        _num("features.mid", gt=0),
        _num("features.book_imbalance", -1, 1),
        _num("features.flow_imbalance", -1, 1),
        _num("features.natr_14_5m", ge=0),
        _num("features.impact_bps_q", ge=0),
        Rule("features.regime_vol", one_of=("low", "high")),
        Rule("features.regime_trend", one_of=("trend", "chop")),
        Rule("windows", "string", False),
        *_HEALTH,
    ],
    "prediction": [
        _ms("ts"),
        _text("symbol"),
        Rule("profile", one_of=("A", "B", "COMBINED")),
        _num("p_inplay_30s", 0, 1),
        _num("p_inplay_2m", 0, 1),
        _num("p_inplay_5m", 0, 1),
        _num("expected_utility_bps_2m"),
        _num("p_toxic", 0, 1),
        Rule("status", one_of=STATUSES),
        Rule("reasons", "string", False),
        _text("model_version"),
        _text("calibration_version"),
        *_HEALTH,
    ],
    "rank_event": [
        _ms("ts"),
        Rule("event", one_of=RANK_EVENT_TYPES),
        _text("symbol"),
        Rule("rank", "int", ge=0),
        _num("score", 0, 1),
        Rule("payload", "string", False),
    ],
    "fill": [
        *_SESSION,
        _text("symbol"),
        Rule("order_id", "bigint"),
        Rule("trade_id", "bigint"),
        Rule("client_order_id"),
        Rule("side", one_of=SIDES),
        *_dec("fill_qty", "fill_price", "commission", "realized_pnl"),
        Rule("commission_asset"),
        Rule("is_maker", "boolean"),
        Rule("position_side", one_of=("LONG", "SHORT", "FLAT", "BOTH")),
    ],
    "position": [
        *_SESSION,
        _text("symbol"),
        Rule("side", one_of=("LONG", "SHORT", "FLAT", "BOTH")),
        *_dec(
            "quantity", "entry_price", "mark_price", "unrealized_pnl", "realized_pnl_session",
            "liquidation_price",
        ),
        Rule("leverage", "int"),
        Rule("margin_type", one_of=("ISOLATED", "CROSS")),
    ],
    "intent": [
        *_SESSION,
        _text("client_order_id"),
        _text("symbol"),
        Rule("side", one_of=SIDES),
        Rule("order_type", one_of=ORDER_TYPES),
        *_dec("quantity"),
        *_dec("price", required=False),
        Rule("time_in_force", "string", False, one_of=TIME_IN_FORCE),
        Rule("reduce_only", "boolean", False),
        Rule("priority", "string", False, one_of=("NORMAL", "KILL", "EMERGENCY")),
        Rule("reason", "string", False),
    ],
    "ack": [
        *_SESSION,
        Rule("order_id", "bigint"),
        Rule("client_order_id"),
        _text("symbol"),
        Rule("side", one_of=SIDES),
        Rule("order_type", one_of=ORDER_TYPES),
        Rule("status", one_of=ORDER_STATUSES),
        *_dec("quantity", "executed_qty", "avg_price"),
        *_dec("price", required=False),
        Rule("time_in_force", "string", False, one_of=TIME_IN_FORCE),
        Rule("reduce_only", "boolean", False),
        Rule("error_code", "string", False),
        Rule("error_msg", "string", False),
    ],
    "state": [
        *_SESSION,
        Rule("state", one_of=SESSION_STATES),
        Rule("prev_state", "string", False, one_of=SESSION_STATES),
        Rule("reason", "string", False),
        Rule("symbols_active", "string", False),
        Rule("open_orders_count", "int", False),
        Rule("positions_count", "int", False),
        *_dec("daily_pnl", "risk_utilization", required=False),
        Rule("daily_trades", "int", False),
    ],
    "breach": [
        *_SESSION,
        _text("breach_id"),
        Rule("breach_type", one_of=BREACH_TYPES),
        Rule("severity", one_of=("WARNING", "CRITICAL", "FATAL")),
        Rule("symbol", "string", False),
        *_dec("threshold", "actual"),
        Rule(
            "action_taken",
            one_of=("NONE", "PAUSE_SYMBOL", "PAUSE_SESSION", "KILL_SESSION", "FLATTEN_ALL"),
        ),
        Rule("details", "string", False),
    ],
    "decision": [
        *_SESSION,
        Rule("tick_seq", "bigint"),
        _text("symbol"),
        *_dec("bid", "ask", "mid", "last_trade_price", "position_qty", "unrealized_pnl", "realized_pnl"),
        Rule("position_side", one_of=("LONG", "SHORT", "FLAT", "BOTH")),
        Rule("pending_order_count", "int"),
        Rule("orders", "string", False),
    ],
}

# Columns of a labelled data set.
BASE_COLUMNS = ("ts", "symbol", "mid_price", "spread_bps")
LABEL_TEMPLATES = (
    "i_tradeable_{h}_{p}",
    "net_edge_bps_{h}_{p}",
    "mfe_bps_{h}_{p}",
    "mae_bps_{h}_{p}",
    "cost_bps_{h}_{p}",
)
TOXICITY_COLUMNS = ("y_toxic", "severity_toxic_bps")
