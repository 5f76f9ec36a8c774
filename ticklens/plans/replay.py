"""The whole chain on recorded data: events to ranked and alerted rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.config import AlertConfig, FeatureConfig, ModelConfig, RankConfig, ScoreConfig
from ticklens.functions.text import rule_headline
from ticklens.operators.alerts import alert_decisions, cached_text
from ticklens.operators.predict import predict_baseline
from ticklens.operators.ranking import accepted, rank_events, ranked_states, throttle, with_score
from ticklens.operators.rolling import feature_snapshots, limit_symbols
from ticklens.operators.thin import snapshot_ticks
from ticklens.session import cut_lineage

REPLAY_ORDER = ("ts", "recv_ts", "seq")


@dataclass(frozen=True)
class ChainConfig:
    features: FeatureConfig = field(default_factory=FeatureConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    rank: RankConfig = field(default_factory=RankConfig)
    alert: AlertConfig = field(default_factory=AlertConfig)
    max_symbols: int | None = None
    data_ticks: bool = False  # ticks set by the events instead of the epoch grid
    with_text: bool = False


def predictions(tape: DataFrame, cfg: ChainConfig = ChainConfig()) -> DataFrame:
    """Scored predictions per (symbol, tick)."""
    if cfg.max_symbols is not None:
        tape = limit_symbols(tape, cfg.max_symbols)
    if cfg.data_ticks:
        ticks, cut = snapshot_ticks(tape, cfg.features.cadence_ms, REPLAY_ORDER)
        snap = feature_snapshots(tape, cfg.features, ticks, cut, REPLAY_ORDER)
    else:
        snap = feature_snapshots(tape, cfg.features)
    return with_score(predict_baseline(snap, cfg.model), cfg.score)


def attach_rank(pred: DataFrame, states: DataFrame) -> DataFrame:
    """Predictions with their current rank and score (0 where there is none)."""
    now = states.select("symbol", "ts", F.col("last_rank").alias("rank"), F.col("score").alias("_score"))
    rows = pred.drop("score").join(now, ["symbol", "ts"], "left")
    return rows.withColumns(
        {
            "rank": F.coalesce("rank", F.lit(0)).cast("int"),
            "score": F.coalesce("_score", F.lit(0.0)),
        }
    ).drop("_score")


def chain_events(scored: DataFrame, cfg: ChainConfig = ChainConfig()) -> DataFrame:
    """Rank events and alerts of scored predictions, with payload columns."""
    scored = cut_lineage(scored)  # read by ranking, alerts and the payload
    states = ranked_states(accepted(scored, throttle(scored, cfg.rank)), cfg.rank, absent=True)
    moves = rank_events(states)
    rows = attach_rank(scored, states)
    log = alert_decisions(scored.select("ts", "symbol", "status"), cfg.alert)
    fired = log.filter(F.col("decision") == "generated").select("ts", "symbol", "event")
    code = F.get("reasons", F.lit(0))["code"]
    text = rule_headline(F.col("symbol"), F.col("status"), code, F.lit(180))
    alerts = fired.join(rows, ["symbol", "ts"]).select(
        "ts",
        "event",
        "symbol",
        "rank",
        "score",
        "status",
        "p_inplay_2m",
        "p_toxic",
        F.to_json(F.struct(*[c for c in scored.columns if c != "score"])).alias("prediction"),
        (text if cfg.with_text else F.lit("")).alias("llm_text"),
    )
    if cfg.with_text:
        alerts = cached_text(alerts, "llm_text", cfg.alert).drop("fresh")
    moves = moves.withColumns({"prediction": F.lit("{}"), "llm_text": F.lit("")})
    return moves.unionByName(alerts, allowMissingColumns=True)


def replay(tape: DataFrame, cfg: ChainConfig = ChainConfig()) -> DataFrame:
    """Rank events of recorded data, in the order (ts, symbol, event)."""
    return chain_events(predictions(tape, cfg), cfg).orderBy("ts", "symbol", "event")


def compare_events(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that are on one side only, with the side."""
    cols = expected.columns
    a, b = actual.select(*cols), expected.select(*cols)
    return (
        a.exceptAll(b)
        .withColumn("side", F.lit("unexpected"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))
    )
