"""Tradeable universe from instrument and ticker tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("symbol", "base_asset", "quote_asset", "price_precision", "quantity_precision", "status")


def tradeable_instruments(inst: DataFrame, quote: str = "USDT", contract: str = "PERPETUAL") -> DataFrame:
    """status TRADING with the given quote and contract type; incomplete rows are skipped."""
    return inst.filter(
        (F.col("status") == "TRADING")
        & (F.col("quote_asset") == quote)
        & (F.col("contract_type") == contract)
    ).na.drop(subset=[c for c in REQUIRED if c in inst.columns])


def with_volume(inst: DataFrame, tickers: DataFrame) -> DataFrame:
    """Add the 24 h quote volume, 0 where it is missing."""
    vol = tickers.groupBy("symbol").agg(F.max("quote_volume").alias("quote_volume"))
    return inst.join(vol, "symbol", "left").withColumn(
        "quote_volume", F.coalesce("quote_volume", F.lit(0.0))
    )


def top_symbols_by_volume(inst: DataFrame, tickers: DataFrame, n: int) -> DataFrame:
    return with_volume(inst, tickers).orderBy(F.col("quote_volume").desc(), "symbol").limit(n)
