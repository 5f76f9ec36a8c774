"""Parameters of the operators. The defaults are fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass

# Horizons in ms, execution profiles, rolling windows in ms.
HORIZONS_MS = {"30s": 30_000, "2m": 120_000, "5m": 300_000}
PROFILES = ("a", "b")
WINDOWS_MS = {"w1s": 1_000, "w10s": 10_000, "w60s": 60_000}
RANGE_WINDOW_MS = 300_000

# Prediction statuses, rank events and the alert each status raises.
STATUSES = ("TRADEABLE", "WATCH", "TRAP", "DEAD", "DATA_ISSUE")
STATUS_ALERTS = {
    "TRADEABLE": "ALERT_TRADABLE",
    "TRAP": "ALERT_TRAP",
    "DATA_ISSUE": "DATA_ISSUE",
}
HEADS = ("p_inplay_30s", "p_inplay_2m", "p_inplay_5m", "p_toxic")


@dataclass(frozen=True)
class FeatureConfig:
    cadence_ms: int = 1_000
    high_vol_natr: float = 0.005
    trend_min_prices: int = 10
    trend_max_reversals: float = 0.3
    impact_ref_qty: float = 1.0
    missing_book_ms: int = 5_000
    missing_trades_ms: int = 10_000


@dataclass(frozen=True)
class ModelConfig:
    model_version: str = "baseline-v1.0.0+0000000"
    calibration_version: str = "cal-v1.0.0"
    profile: str = "A"
    toxic_threshold: float = 0.7
    tradeable_threshold: float = 0.6
    watch_threshold: float = 0.3
    spread_max_bps: float = 10.0
    impact_max_bps: float = 20.0
    stale_book_max_ms: int = 1_000
    stale_trades_max_ms: int = 2_000


@dataclass(frozen=True)
class ScoreConfig:
    w_30s: float = 0.2
    w_2m: float = 0.5
    w_5m: float = 0.3
    utility_max_bps: float = 50.0
    toxic_alpha: float = 0.5

    def __post_init__(self) -> None:
        if abs(self.w_30s + self.w_2m + self.w_5m - 1.0) > 1e-6:
            raise ValueError("horizon weights must sum to 1")
        if self.utility_max_bps <= 0:
            raise ValueError("utility_max_bps must be positive")
        if not 0 <= self.toxic_alpha <= 1:
            raise ValueError("toxic_alpha must be in [0, 1]")


@dataclass(frozen=True)
class RankConfig:
    top_k: int = 20
    enter_ms: int = 1_500
    exit_ms: int = 3_000
    min_dwell_ms: int = 2_000
    update_interval_ms: int = 1_000
    burst_delta: float = 0.1
    score_threshold: float = 0.1
    slice_ms: int = 3_600_000


@dataclass(frozen=True)
class AlertConfig:
    cooldown_ms: int = 120_000
    stable_ms: int = 2_000
    max_per_min: int = 30
    data_issue_ms: int = 10_000
    text_cooldown_ms: int = 60_000
    slice_ms: int = 3_600_000
    slice_rows: int = 200_000


@dataclass(frozen=True)
class DeliveryConfig:
    cooldown_ms: int = 120_000
    max_per_min: int = 30
    transition_only: bool = True
    slice_ms: int = 3_600_000
    slice_rows: int = 200_000

    def __post_init__(self) -> None:
        if self.cooldown_ms < 0 or self.max_per_min < 1:
            raise ValueError("cooldown_ms >= 0 and max_per_min >= 1 are required")


@dataclass(frozen=True)
class LabelConfig:
    spread_max_bps: float = 10.0
    impact_max_bps: float = 20.0
    toxic_tau_ms: int = 30_000
    toxic_bps: float = 10.0
    sample_interval_ms: int = 1_000
    lookahead_ms: int = 360_000
    fees_bps_a: float = 2.0
    fees_bps_b: float = 4.0
    slice_ms: int = 600_000
    # Least net edge in bps per horizon and profile.
    min_edge_bps: tuple[tuple[str, str, float], ...] = (
        ("30s", "a", 5.0),
        ("30s", "b", 8.0),
        ("2m", "a", 10.0),
        ("2m", "b", 15.0),
        ("5m", "a", 15.0),
        ("5m", "b", 20.0),
    )


@dataclass(frozen=True)
class SplitConfig:
    train_ratio: float = 0.7
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    purge_gap_ms: int = 0
    timestamp_col: str = "ts"

    def __post_init__(self) -> None:
        if abs(self.train_ratio + self.val_ratio + self.test_ratio - 1.0) > 1e-6:
            raise ValueError("ratios must sum to 1")
        if min(self.train_ratio, self.val_ratio, self.test_ratio) <= 0:
            raise ValueError("ratios must be positive")
        if self.purge_gap_ms < 0:
            raise ValueError("purge_gap_ms must be >= 0")


@dataclass(frozen=True)
class BacktestConfig:
    horizons: tuple[str, ...] = ("30s", "2m", "5m")
    profiles: tuple[str, ...] = ("a", "b")
    top_k: int = 20
    bins: int = 10
    max_ece: float = 0.05


@dataclass(frozen=True)
class PolicyConfig:
    inplay_enter_prob: float = 0.6
    inplay_exit_prob: float = 0.4
    toxicity_widen: float = 0.5
    toxicity_disable: float = 0.8
    toxic_spread_mult: float = 2.0
    inventory_hard_limit: float = 0.01
    max_session_loss: float = 100.0
    stale_quote_ms: int = 5_000

    def __post_init__(self) -> None:
        if self.inplay_exit_prob >= self.inplay_enter_prob:
            raise ValueError("inplay_exit_prob must be below inplay_enter_prob")


@dataclass(frozen=True)
class QuoteConfig:
    spread_bps: float = 10.0
    order_qty: float = 0.001
    max_position: float = 0.01
