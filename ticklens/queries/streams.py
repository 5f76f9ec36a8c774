"""Registered queries that run as streams over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ticklens.functions.numeric import rnd
from ticklens.queries.common import F, S, query
from ticklens.session import checkpoint_folder
from ticklens.streaming.feeds import window_sums, with_event_time
from ticklens.streaming.state import thin_stream


def _trade_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The trades of the market view, read as a stream of files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return rows.filter(~F.col("event_type").isin("view", "signup")).select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.floor(us / F.lit(4_000_000)).cast("long").alias("ts"),
        (F.lit(1_000_000) + F.floor(F.col("value") * 100 + 0.5)).cast("double").alias("price"),
        (1 + F.col("event_id") % 10).cast("double").alias("qty"),
        (F.col("event_id") % 3 == 1).alias("is_buyer_maker"),
    )


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read back what it wrote to the shared folder."""
    spark = stream.sparkSession
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


_TAPE = "WITH " + S.TAPE


@query(
    "stream_window_sums",
    _TAPE + f""", w AS (SELECT symbol, price, qty, maker, unnest([(ts // 20000) * 20000 + 20000, (ts // 20000) * 20000 + 40000, (ts // 20000) * 20000 + 60000]) AS w_end FROM tape WHERE is_trade)
    SELECT symbol, w_end AS ts, count(*) AS trade_count, sum(qty) AS volume, coalesce(sum(qty) FILTER (NOT maker), 0) AS buy_volume,
      coalesce(sum(qty) FILTER (maker), 0) AS sell_volume, {S.rnd("sum(price * qty) / sum(qty)", 6)} AS vwap
    FROM w WHERE w_end <= (SELECT max(ts) - 10000 FROM tape WHERE is_trade) GROUP BY 1, 2""",
)
def stream_window_sums(spark: SparkSession, sf: str) -> DataFrame:
    out = _run(window_sums(_trade_stream(spark, sf), "60 seconds", "20 seconds"))
    return out.withColumn("vwap", rnd(F.col("vwap"), 6))


@query(
    "stream_thinned",
    "WITH RECURSIVE " + S.TAPE + """, st AS (SELECT DISTINCT symbol, ts FROM tape WHERE is_trade),
    kept AS (SELECT symbol, min(ts) AS ts FROM st GROUP BY symbol
      UNION ALL SELECT s.symbol, min(s.ts) FROM kept k JOIN st s ON s.symbol = k.symbol AND s.ts >= k.ts + 15000 GROUP BY s.symbol, k.ts)
    SELECT symbol, ts FROM kept""",
)
def stream_thinned(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_event_time(_trade_stream(spark, sf).select("symbol", "ts"), "10 seconds")
    return _run(thin_stream(rows, "symbol", 15_000))
