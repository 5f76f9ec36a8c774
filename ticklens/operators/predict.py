"""Predictions from feature snapshots: heuristic rows, model rows, unscored rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.config import HEADS, ModelConfig
from ticklens.functions import predict as fn
from ticklens.functions.calibrate import platt
from ticklens.functions.market import data_issue
from ticklens.functions.numeric import rnd

PREDICTION = [
    "ts", "symbol", "profile", "p_inplay_30s", "p_inplay_2m", "p_inplay_5m",
    "expected_utility_bps_2m", "p_toxic", "status", "reasons", "model_version",
    "calibration_version", "data_health",
]


def _prediction_rows(df: DataFrame, heads: dict[str, Column], reasons: Column, cfg: ModelConfig) -> DataFrame:
    """Rows in prediction shape; data problems win over everything else."""
    bad = F.col("_bad")
    df = df.withColumn(
        "_bad", data_issue(F.col("data_health"), cfg.stale_book_max_ms, cfg.stale_trades_max_ms)
    ).withColumns({f"_{h}": c for h, c in heads.items()})
    spread, impact = F.col("spread_bps"), F.col("impact_bps_q")
    p2m, toxic = F.col("_p_inplay_2m"), F.col("_p_toxic")
    utility = fn.expected_utility(p2m, toxic, F.col("natr_14_5m"), spread, impact)
    failed = F.size(fn.gate_failures(spread, impact, cfg)) > 0
    zero = lambda c: F.when(bad, F.lit(0.0)).otherwise(c)
    out = {f"p_inplay_{h}": zero(rnd(F.col(f"_p_inplay_{h}"), 4)) for h in ("30s", "2m", "5m")}
    return df.select(
        "ts",
        "symbol",
        F.lit(cfg.profile).alias("profile"),
        *[c.alias(k) for k, c in out.items()],
        zero(rnd(utility, 2)).alias("expected_utility_bps_2m"),
        zero(rnd(toxic, 4)).alias("p_toxic"),
        F.when(bad, "DATA_ISSUE").otherwise(fn.status(p2m, toxic, failed, cfg)).alias("status"),
        F.when(bad, fn.stale_reasons(F.col("data_health.stale_book_ms")))
        .otherwise(reasons)
        .alias("reasons"),
        F.lit(cfg.model_version).alias("model_version"),
        F.lit(cfg.calibration_version).alias("calibration_version"),
        "data_health",
    )


def predict_baseline(snap: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """Heuristic predictions, column expressions only."""
    flat = snap.select("ts", "symbol", "features.*", "data_health").withColumn(
        "_base",
        fn.p_inplay_base(F.col("spread_bps"), F.col("book_imbalance"), F.col("flow_imbalance")),
    )
    multiplier = fn.regime_multiplier(F.col("regime_vol"), F.col("regime_trend"))
    heads = {
        f"p_inplay_{h}": fn.p_inplay(F.col("_base"), multiplier, h) for h in ("30s", "2m", "5m")
    }
    heads["p_toxic"] = fn.p_toxic(F.col("impact_bps_q"), F.col("flow_imbalance"))
    return _prediction_rows(flat, heads, fn.baseline_reasons(F.col("_p_toxic"), cfg), cfg)


def feature_vector() -> Column:
    """The eight model inputs in their fixed order."""
    numbers = [
        F.col(c)
        for c in (
            "spread_bps", "mid", "book_imbalance", "flow_imbalance", "natr_14_5m", "impact_bps_q",
        )
    ]
    flags = [
        F.when(F.col("regime_vol") == "high", 1.0).otherwise(0.0),
        F.when(F.col("regime_trend") == "trend", 1.0).otherwise(0.0),
    ]
    return F.array(*numbers, *flags)


def predict_model(
    snap: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    calibrators: dict[str, tuple[float, float]] | None = None,
    cfg: ModelConfig = ModelConfig(),
) -> DataFrame:
    """Predictions of a user model.

    ``model`` takes a DataFrame with a ``vector`` column and adds the raw head
    columns (any of spark.ml, a pandas UDF, or expressions will do); a head it
    does not add is ``p_inplay_2m`` for the in-play heads and 0 for ``p_toxic``.
    ``calibrators`` maps heads to (a, b); heads without one stay raw.
    """
    flat = snap.select("ts", "symbol", "features.*", "data_health")
    scored = model(flat.withColumn("vector", feature_vector()))
    raw = {
        h: F.col(h)
        if h in scored.columns
        else (F.lit(0.0) if h == "p_toxic" else F.col("p_inplay_2m"))
        for h in HEADS
    }
    cal = calibrators or {}
    heads = {h: platt(c, *cal[h]) if h in cal else c for h, c in raw.items()}
    reasons = fn.model_reasons(
        F.col("_p_inplay_2m"), raw["p_inplay_2m"], F.col("_p_toxic"), bool(cal), cfg
    )
    return _prediction_rows(scored, heads, reasons, cfg)


# Reason codes of a model that cannot be used.
ARTIFACT_REASONS = ("RC_MODEL_UNAVAILABLE", "RC_CALIBRATION_MISSING", "RC_ARTIFACT_INTEGRITY_FAIL")


def mark_unscored(
    snap: DataFrame,
    model_status: DataFrame,
    scored: Callable[[DataFrame], DataFrame],
    strict: bool = True,
    cfg: ModelConfig = ModelConfig(),
) -> DataFrame:
    """Score what can be scored.

    ``model_status`` has symbol, error_code, error_msg for the symbols whose model
    or calibration is unusable. Those snapshots become DATA_ISSUE rows (strict) or
    heuristic rows (lenient); the others go through ``scored``.
    """
    bad_keys = model_status.filter(F.col("error_code").isNotNull())
    good = scored(snap.join(bad_keys, "symbol", "left_anti"))
    bad = snap.join(bad_keys, "symbol")
    if not strict:
        return good.unionByName(predict_baseline(bad.select(*snap.columns), cfg))
    evidence = F.substring(F.coalesce("error_msg", F.lit("Unknown artifact error")), 1, 50)
    zero = F.lit(0.0)
    issue = bad.select(
        "ts",
        "symbol",
        F.lit(cfg.profile).alias("profile"),
        *[zero.alias(c) for c in PREDICTION[3:8]],
        F.lit("DATA_ISSUE").alias("status"),
        F.array(fn.reason(F.col("error_code"), zero, "flag", evidence)).alias("reasons"),
        F.lit(cfg.model_version).alias("model_version"),
        F.lit(cfg.calibration_version).alias("calibration_version"),
        "data_health",
    )
    return good.unionByName(issue)


def status_counts(pred: DataFrame) -> DataFrame:
    """Predictions per (symbol, status), per symbol, and in all (null = all)."""
    return pred.rollup("symbol", "status").agg(F.count(F.lit(1)).alias("n"))
