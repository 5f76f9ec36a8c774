"""Live features: each micro-batch is stored, and the ticks that became final are computed.

Only ticks that no earlier batch had are computed and written. What comes into their slices (first event, last
book, last trade of each symbol) is summed up from all stored epochs each time, so reads grow with the history:
move old epochs away, or start a new table, from time to time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.config import RANGE_WINDOW_MS, FeatureConfig
from ticklens.operators.rolling import feature_snapshots
from ticklens.operators.router import flag_late
from ticklens.plans.slices import slice_of


def live_features(
    tape_path: str,
    out_path: str,
    cfg: FeatureConfig = FeatureConfig(),
    lateness_ms: int = 10_000,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over typed tape rows.

    Appends the rows to ``tape_path`` (partitioned by slice) and the snapshots of all
    ticks behind the watermark ``max(ts) - lateness`` to ``out_path``. Rows are written
    per epoch, so a retried batch replaces its own output.
    """
    s = RANGE_WINDOW_MS

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        rows = flag_late(batch).withColumn("part", slice_of(F.col("ts"), s))
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{tape_path}/epoch={epoch}")
        tape = spark.read.option("basePath", tape_path).parquet(f"{tape_path}/epoch=*")
        tape = tape.filter(F.col("epoch") <= epoch)
        top = tape.agg(F.max("ts").alias("t"), F.max(F.when(F.col("epoch") < epoch, F.col("ts"))).alias("p")).first()
        step = cfg.cadence_ms
        upto = (top["t"] - lateness_ms) // step * step
        done = -(2**62) if top["p"] is None else (top["p"] - lateness_ms) // step * step
        if upto <= done:
            return
        first = tape.groupBy("symbol").agg(F.min("ts").alias("first_ts"))
        new = F.sequence(
            F.greatest((F.ceil(F.col("first_ts") / step) * step).cast("long"), F.lit(max(done + step, 0))),
            F.lit(upto),
            F.lit(step).cast("long"),
        )
        ready = (F.ceil(F.col("first_ts") / step) * step <= upto) & (F.lit(done + step) <= upto)
        ticks = first.filter(ready).select("symbol", F.explode(new).alias("ts"))
        # Frames reach one range back; the last book may be older, so its slice's summary
        # comes from the whole tape by a partial aggregate with two columns read.
        snaps = feature_snapshots(tape.filter(F.col("ts") <= upto), cfg, ticks)
        snaps.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    return run
