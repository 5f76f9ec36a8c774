"""What the registered queries share: the market view, its settings, helpers."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.config import FeatureConfig, LabelConfig, ModelConfig, RankConfig
from ticklens.operators.predict import predict_baseline
from ticklens.operators.ranking import with_score
from ticklens.operators.rolling import feature_snapshots
from ticklens.plans.marketview import market_tape, table
from ticklens.queries import sql as S

Query = Callable[[SparkSession, str], DataFrame]

# The market view is sparse (one event in ten seconds per symbol): staleness limits and
# score threshold fit that.
FC = FeatureConfig(missing_book_ms=60_000, missing_trades_ms=60_000)
MC = ModelConfig(stale_book_max_ms=30_000, stale_trades_max_ms=30_000)
RC = RankConfig(top_k=10, score_threshold=0.002)
LC = LabelConfig(sample_interval_ms=15_000)

PRED_SQL = S.predictions(FC, MC)

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def tape_of(spark: SparkSession, sf: str) -> DataFrame:
    return market_tape(spark, sf)


def snaps_of(spark: SparkSession, sf: str) -> DataFrame:
    return feature_snapshots(market_tape(spark, sf), FC)


def preds_of(spark: SparkSession, sf: str) -> DataFrame:
    return with_score(predict_baseline(snaps_of(spark, sf), MC))


def flag(c: Column) -> Column:
    return c.cast("int")


def joined(c: Column | str, sep: str = ",") -> Column:
    return F.array_join(c, sep)


load = partial(table)

__all__ = [
    "FC", "LC", "MC", "ORACLE", "PRED_SQL", "QUERIES", "RC", "F", "S", "flag", "joined", "load",
    "preds_of", "query", "snaps_of", "tape_of",
]
