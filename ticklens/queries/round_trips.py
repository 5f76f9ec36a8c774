"""Registered queries: what is written to the shared folder and read back, and small parts without a query of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ticklens.config import SplitConfig
from ticklens.functions.cost import CLIP_SHARE, clip_size_usd
from ticklens.functions.numeric import rnd
from ticklens.operators import calibration
from ticklens.queries.common import F, S, load, query, tape_of
from ticklens.queries.offline import _PARAMS, _split_sql
from ticklens.session import checkpoint_folder
from ticklens.sources import readers, writers

TAPE = "WITH " + S.TAPE


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query(
    "events_round_trip",
    TAPE + " SELECT ts, recv_ts, symbol, CASE WHEN is_trade THEN 'trade' ELSE 'book' END AS type, seq::VARCHAR AS payload FROM tape",
)
def events_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON lines, with a broken line and one without a symbol, which the reader leaves out."""
    kind = F.when(F.col("is_trade"), "trade").otherwise("book")
    t = tape_of(spark, sf).select(
        "ts", F.lit("tape").alias("source"), F.lower("symbol").alias("symbol"), kind.alias("type"),
        F.col("seq").cast("string").alias("payload"), "recv_ts",
    )
    folder = _folder(spark, "events")
    writers.write_dataset(t, f"{folder}/whole.jsonl")
    bad = t.filter(F.col("payload").cast("long") % 10 == 0)
    bad.select(F.concat(F.lit('{"ts": '), "payload").alias("value")).write.text(f"{folder}/broken.jsonl")
    writers.write_dataset(bad.withColumn("symbol", F.lit(None).cast("string")), f"{folder}/lost.jsonl")
    return readers.read_market_events(spark, f"{folder}/*.jsonl").select("ts", "recv_ts", "symbol", "type", "payload")


@query("labeled_round_trip", "SELECT doc_id, quality, toxic, format FROM labels, (VALUES ('json'), ('parquet')) f(format)")
def labeled_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows in both formats."""
    folder, rows = _folder(spark, "labeled"), load(spark, sf, "labels")
    both = []
    for name, suffix in (("parquet", "parquet"), ("json", "jsonl")):
        writers.write_dataset(rows, f"{folder}/rows.{suffix}")
        got = readers.read_labeled(spark, f"{folder}/rows.{suffix}")
        both.append(got.select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"), F.lit(name).alias("format")))
    return both[0].unionByName(both[1])


@query(
    "split_round_trip",
    _split_sql(0) + """, s AS (SELECT part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM parts WHERE part IS NOT NULL GROUP BY 1)
    SELECT part, n, n AS n_read, first_ts, last_ts FROM s""",
)
def split_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The parts as written and read, beside the numbers of the metadata row."""
    folder, cfg = _folder(spark, "split"), SplitConfig()
    writers.save_split(tape_of(spark, sf), folder, cfg)
    meta = spark.read.json(f"{folder}/metadata.json")
    names = ("train", "val", "test")
    of = lambda p: F.struct(F.lit(p).alias("part"), *(F.col(f"{p}_{c}").alias(c) for c in ("rows", "first_ts", "last_ts")))
    said = meta.select(F.inline(F.array(*(of(p) for p in names)))).withColumnRenamed("rows", "n")
    parts = [spark.read.parquet(f"{folder}/{p}.parquet").agg(F.count(F.lit(1)).alias("n_read")).withColumn("part", F.lit(p)) for p in names]
    return said.join(parts[0].unionByName(parts[1]).unionByName(parts[2]), "part").select("part", "n", "n_read", "first_ts", "last_ts")


@query(
    "backtest_round_trip",
    """WITH r AS (SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1) SELECT *, (SELECT count(*) FROM r) AS n_rows FROM r""",
)
def backtest_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    path = f"{_folder(spark, 'backtest')}/result.json"
    writers.save_backtest(rows, path, SplitConfig(), F.lit(rows.count()))
    got = spark.read.json(path).filter("config_hash IS NOT NULL AND run_ts IS NOT NULL")
    return got.select("lang", "n_docs", "n_chars", "n_rows")


@query(
    "calibration_round_trip",
    TAPE + f""", c(head, a, b) AS (VALUES {", ".join(f"('{h}', {a}::DOUBLE, {b}::DOUBLE)" for h, (a, b) in _PARAMS.items())}),
    x AS (SELECT seq, head, a, b, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, (seq % 101) / 101::DOUBLE)) AS q FROM tape, c)
    SELECT seq, head, {S.rnd("1 / (1 + exp(-(a * ln(q / (1 - q)) + b)))", 7)} AS calibrated FROM x""",
)
def calibration_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrators saved, loaded and applied."""
    t = tape_of(spark, sf)
    path = f"{_folder(spark, 'calibration')}/fit.json"
    writers.save_calibration(calibration.calibrators_table(t, _PARAMS), path)
    loaded = writers.load_calibration(spark, path)
    heads = F.explode(F.array(*map(F.lit, _PARAMS))).alias("head")
    long = t.select("seq", heads, ((F.col("seq") % 101) / 101.0).alias("score"))
    out = calibration.apply_calibrators(long, calibration.calibrators_table(long, loaded))
    return out.select("seq", "head", rnd(F.col("calibrated"), 7).alias("calibrated"))


@query(
    "instruments_round_trip",
    """SELECT 'P' || p_partkey AS symbol, 'USDT' AS quote_asset, (p_partkey % 9)::INT AS price_precision, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_retailprice END AS quote_volume
    FROM part""",
)
def instruments_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments and tickers in exchange spelling; every seventh volume is no number."""
    folder, key = _folder(spark, "instruments"), F.col("p_partkey")
    parts = load(spark, sf, "part").select("p_partkey", F.concat(F.lit("P"), key.cast("string")).alias("symbol"), "p_retailprice")
    meta = parts.select("symbol", F.lit("USDT").alias("quoteAsset"), (key % 9).alias("pricePrecision"), F.lit("TRADING").alias("status"))
    volume = F.when(key % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string"))
    writers.write_dataset(meta, f"{folder}/instruments.jsonl")
    writers.write_dataset(parts.select("symbol", volume.alias("quoteVolume")), f"{folder}/tickers.jsonl")
    rows = readers.read_instruments(spark, f"{folder}/instruments.jsonl").join(readers.read_tickers(spark, f"{folder}/tickers.jsonl"), "symbol")
    return rows.select("symbol", "quote_asset", "price_precision", "quote_volume")


_SHARES = ", ".join(f"('{style}', {share}::DOUBLE)" for style, share in sorted(CLIP_SHARE.items()))


@query("clip_sizes", f"SELECT o_orderkey AS id, style, {S.rnd('share * o_totalprice', 6)} AS usd FROM orders, (VALUES {_SHARES}) s(style, share)")
def clip_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """What each style would trade at once of an order's volume."""
    sizes = F.array(
        *(F.struct(F.lit(s).alias("style"), clip_size_usd(F.col("o_totalprice"), s).alias("usd")) for s in sorted(CLIP_SHARE))
    )
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.inline(sizes))
    return rows.withColumn("usd", rnd(F.col("usd"), 6))
