"""A market tape derived from the supplied ``events`` table.

Each user is a symbol; thirty days are squeezed to 648 s; views and sign-ups are
book updates, the rest are trades. Prices are whole ticks and quantities whole
lots, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros_since_2024(col: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', {col})")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.floor(micros_since_2024("ts") / F.lit(4_000_000)).cast("long")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        ts.alias("ts"),
        (ts + F.col("event_id") % 50).alias("recv_ts"),
        F.col("event_id").alias("seq"),
        (~F.col("event_type").isin("view", "signup")).alias("is_trade"),
        (F.lit(1_000_000) + F.floor(F.col("value") * 100 + 0.5)).cast("double").alias("px"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def market_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows: trades fill price/qty/maker, books fill the four quote columns."""
    trade = F.col("is_trade")
    half = F.col("k") * 7
    return _base(spark, sf_dir).select(
        "symbol",
        "ts",
        "recv_ts",
        "seq",
        "is_trade",
        F.when(trade, F.col("px")).alias("price"),
        F.when(trade, (1 + F.col("seq") % 10).cast("double")).alias("qty"),
        F.when(trade, F.col("seq") % 3 == 1).alias("is_buyer_maker"),
        F.when(~trade, F.col("px") - half).alias("bid"),
        F.when(~trade, F.col("px") + half).alias("ask"),
        F.when(~trade, (1 + F.col("k")).cast("double")).alias("bid_qty"),
        F.when(~trade, (100 - F.col("k")).cast("double")).alias("ask_qty"),
    )


def market_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as raw exchange messages: ``raw`` JSON text and ``recv_ts``."""
    b = _base(spark, sf_dir)
    kind = (
        F.when(F.col("is_trade"), F.lit("aggTrade"))
        .when(F.col("seq") % 2 == 0, F.lit("bookTicker"))
        .otherwise(F.lit("depthUpdate"))
    )
    px, half = F.col("px").cast("long"), F.col("k") * 7
    text = lambda c: c.cast("string")
    # Trades: p, q, m. Quotes: scalars for bookTicker, level arrays for depthUpdate.
    trade = F.to_json(
        F.struct(
            F.lit("aggTrade").alias("e"),
            F.col("ts").alias("E"),
            F.col("symbol").alias("s"),
            text(px).alias("p"),
            text(1 + F.col("seq") % 10).alias("q"),
            (F.col("seq") % 3 == 1).alias("m"),
        )
    )
    book = F.to_json(
        F.struct(
            F.lit("bookTicker").alias("e"),
            F.col("ts").alias("E"),
            F.col("symbol").alias("s"),
            text(px - half).alias("b"),
            text(1 + F.col("k")).alias("B"),
            text(px + half).alias("a"),
            text(100 - F.col("k")).alias("A"),
        )
    )
    depth = F.to_json(
        F.struct(
            F.lit("depthUpdate").alias("e"),
            F.col("ts").alias("E"),
            F.col("symbol").alias("s"),
            F.array(F.array(text(px - half), text(1 + F.col("k")))).alias("b"),
            F.array(F.array(text(px + half), text(100 - F.col("k")))).alias("a"),
        )
    )
    raw = F.when(kind == "aggTrade", trade).when(kind == "bookTicker", book).otherwise(depth)
    return b.select("seq", "recv_ts", raw.alias("raw"))
