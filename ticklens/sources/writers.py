"""Tables to files, with their metadata rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.config import SplitConfig
from ticklens.operators.split import require_non_empty, split_summary, time_split
from ticklens.plans.slices import Run, running

SCHEMA_VERSION = "1.0.0"


def write_dataset(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite"
) -> None:
    """Parquet (snappy) or JSON lines by the extension of ``path``."""
    out = df.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if path.endswith(".parquet"):
        out.option("compression", "snappy").parquet(path)
    elif path.endswith((".jsonl", ".json")):
        out.json(path)
    else:
        raise ValueError(f"unsupported format: {path}")


def config_hash(config: object) -> str:
    """First 16 hex digits of SHA-256 over the key-sorted JSON of a config."""
    plain = asdict(config) if is_dataclass(config) else config
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:16]


def row_digest(*cols: str) -> Column:
    """SHA-256 of a row as JSON with its keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def data_hash(df: DataFrame) -> Column:
    """Order-free hash of a table, as an aggregate: sums of the pieces of the row digests."""
    h = row_digest(*df.columns)
    words = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    return F.substring(F.sha2(F.concat_ws(":", *[F.sum(w).cast("string") for w in words]), 256), 1, 16)


def dataset_metadata(df: DataFrame, config: object, symbol: str = "symbol") -> DataFrame:
    """One row: counts, hashes and the schema version of a data set."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(symbol).alias("symbol_count"),
        data_hash(df).alias("data_hash"),
    ).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(config_hash(config)).alias("config_hash"),
        "*",
    )


def stream_digest(events: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """Order-sensitive digest of a whole event stream, one row.

    Row digests are sorted by a range partitioning, each partition is hashed over its
    digests in order in pieces of 1,000 rows, and the pieces' hashes, in order, are
    hashed once more.
    """
    rows = events.select(*order, row_digest(*cols).alias("digest"))
    rows = rows.withColumn("one", F.lit(1))
    key = F.floor(F.col(order[0]) / 60_000).cast("long")
    rows = running(rows, [], key, [*order, "digest"], [Run("n", "sum", F.col("one"))])
    piece = F.floor((F.col("n") - 1) / 1000).cast("long")
    joined = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(c), lambda x: x["d"]), ""), 256)
    for _ in range(3):  # 1,000 ** 3 rows before the last level holds more than 1,000 pieces
        rows = rows.groupBy(piece.alias("p")).agg(
            joined(F.collect_list(F.struct("n", F.col("digest").alias("d")))).alias("digest")
        )
        rows = rows.select((F.col("p") + 1).alias("n"), "digest")
    return rows.agg(joined(F.collect_list(F.struct("n", F.col("digest").alias("d")))).alias("digest"))


def save_split(df: DataFrame, folder: str, cfg: SplitConfig = SplitConfig(), fmt: str = "parquet") -> DataFrame:
    """train/val/test folders plus a metadata row; an empty part is an error."""
    parts = time_split(df, cfg)
    summary = split_summary(parts, cfg.timestamp_col)
    require_non_empty(summary)
    for p in ("train", "val", "test"):
        rows = parts.filter(F.col("part") == p).drop("part")
        write_dataset(rows, f"{folder}/{p}.{'parquet' if fmt == 'parquet' else 'jsonl'}")
    meta = summary.groupBy().pivot("part", ["train", "val", "test"]).agg(
        F.first("n").alias("rows"), F.first("first_ts").alias("first_ts"), F.first("last_ts").alias("last_ts")
    )
    meta = meta.withColumns(
        {
            "schema_version": F.lit(SCHEMA_VERSION),
            "config_hash": F.lit(config_hash(cfg)),
            "config": F.lit(json.dumps(asdict(cfg), sort_keys=True)),
        }
    )
    one = F.lit(1).alias("_one")  # a row on either side
    hashed = parts.drop("part").agg(data_hash(parts.drop("part")).alias("data_hash")).select("*", one)
    meta = meta.select("*", one).join(hashed, "_one").drop("_one")
    meta.write.mode("overwrite").json(f"{folder}/metadata.json")
    return meta


def load_split_metadata(spark: SparkSession, folder: str) -> dict:
    return spark.read.json(f"{folder}/metadata.json").first().asDict()


def save_backtest(result: DataFrame, path: str, config: object, n_rows: Column | None = None) -> None:
    """Flat result rows with the run's metadata on each; ``n_rows`` is what the run was over, where it is told."""
    meta = {"config_hash": F.lit(config_hash(config)), "run_ts": F.current_timestamp()}
    if n_rows is not None:
        meta["n_rows"] = n_rows
    result.withColumns(meta).write.mode("overwrite").json(path)


def save_calibration(calibrators: DataFrame, path: str) -> None:
    """head, a, b and the metrics before and after."""
    calibrators.write.mode("overwrite").json(path)


def load_calibration(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    """(a, b) per head: one row per head."""
    rows = spark.read.json(path).select("head", "a", "b").collect()
    return {r["head"]: (r["a"], r["b"]) for r in rows}


Sink = Callable[[DataFrame, int], None]


def deliver_batch(
    sinks: dict[str, Sink], dry_run: bool = False, enabled: bool = True
) -> Callable[[DataFrame, int], DataFrame | None]:
    """A ``foreachBatch`` function: hand the messages of a batch to every sink.

    Returns (when called) one row per sink with its success; a sink that raises is
    counted as failed and does not stop the others.
    """

    def run(batch: DataFrame, epoch_id: int) -> DataFrame | None:
        if not enabled or batch.isEmpty():
            return None
        results = []
        for name, sink in sinks.items():
            error = None
            if not dry_run:
                try:
                    sink(batch, epoch_id)
                except Exception as e:  # noqa: BLE001
                    error = str(e)
            results.append((epoch_id, "dry_run" if dry_run else name, error is None, error))
        return batch.sparkSession.createDataFrame(
            results, "epoch_id long, sink string, success boolean, error string"
        )

    return run


def table_sink(path: str) -> Sink:
    """Append the messages to a table, one folder per epoch: a retry overwrites its own."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
