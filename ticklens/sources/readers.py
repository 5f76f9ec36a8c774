"""Tables from files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ticklens.schemas import MARKET_EVENT


def read_market_events(spark: SparkSession, path: str, on_error: str = "skip") -> DataFrame:
    """JSON-lines events with ``seq``, their place in the files.

    ``skip`` leaves unparseable lines out, ``fail`` stops at the first one.
    """
    if on_error not in ("skip", "fail"):
        raise ValueError("on_error is skip or fail")
    schema = StructType([*MARKET_EVENT.fields, StructField("_bad", StringType())])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad")
    if on_error == "fail":
        rows = spark.read.schema(MARKET_EVENT).option("mode", "FAILFAST").json(path)
    else:
        rows = reader.option("mode", "PERMISSIVE").json(path)
        rows = rows.filter(F.col("_bad").isNull()).drop("_bad")
    needed = ("ts", "source", "symbol", "type", "recv_ts")
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    if on_error == "fail":
        for c in needed:
            rows = rows.withColumn(
                c, F.coalesce(F.col(c), F.raise_error(F.lit(f"event without {c}")).cast(rows.schema[c].dataType))
            )
    else:
        rows = rows.na.drop(subset=list(needed))
    return rows.withColumn("symbol", F.upper("symbol"))


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows from .parquet, .jsonl or .json; any other suffix is an error."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in (".jsonl", ".json"):
        return spark.read.json(path)
    raise ValueError(f"unsupported format {suffix!r}")


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Instrument metadata, one JSON object per line in exchange spelling."""
    schema = (
        "symbol string, baseAsset string, quoteAsset string, pricePrecision int,"
        " quantityPrecision int, contractType string, status string"
    )
    return spark.read.schema(schema).json(path).selectExpr(
        "symbol",
        "baseAsset AS base_asset",
        "quoteAsset AS quote_asset",
        "pricePrecision AS price_precision",
        "quantityPrecision AS quantity_precision",
        "contractType AS contract_type",
        "status",
    )


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """24 h tickers; a volume that is no number counts as 0."""
    rows = spark.read.schema("symbol string, quoteVolume string").json(path)
    return ticker_volumes(rows)


def ticker_volumes(rows: DataFrame) -> DataFrame:
    vol = F.coalesce(F.expr("try_cast(quoteVolume AS double)"), F.lit(0.0))
    return rows.select("symbol", vol.alias("quote_volume"))
