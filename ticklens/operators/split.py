"""Leak-free split by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.config import SplitConfig
from ticklens.plans.slices import Run, running, slice_of


@dataclass(frozen=True)
class Cuts:
    """Last timestamp of train and of val, before the purge gap."""

    train_ts: int
    val_ts: int


def find_cuts(df: DataFrame, cfg: SplitConfig = SplitConfig(), slice_ms: int = 60_000) -> Cuts:
    """Counts per timestamp, prefix sums, two numbers to the driver; rows are never sorted."""
    t = cfg.timestamp_col
    if t not in df.columns:
        raise ValueError(f"no column {t}")
    counts = df.groupBy(F.col(t).cast("long").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    prefix = running(counts, [], slice_of(F.col("ts"), slice_ms), ["ts"], [Run("upto", "sum", F.col("n"))])
    total = counts.agg(F.sum("n")).scalar()
    train, val = cfg.train_ratio, cfg.train_ratio + cfg.val_ratio
    n_train, n_val = F.floor(total * F.lit(train)), F.floor(total * F.lit(val))
    # A boundary never cuts through equal timestamps: it moves to the end of them.
    row = prefix.agg(
        F.min(F.when((F.col("upto") >= n_train) & (n_train > 0), F.col("ts"))).alias("a"),
        F.min(F.when((F.col("upto") >= n_val) & (n_val > 0), F.col("ts"))).alias("b"),
    ).first()
    if row["a"] is None or row["b"] is None:
        raise ValueError("train split is empty" if row["a"] is None else "cannot split")
    return Cuts(row["a"], row["b"])


def part_column(cuts: Cuts, cfg: SplitConfig = SplitConfig()) -> Column:
    """train, val, test, or null inside a purge gap."""
    t, gap = F.col(cfg.timestamp_col), cfg.purge_gap_ms
    a, b = cuts.train_ts, cuts.val_ts
    return (
        F.when((t <= a) & (t <= a - gap), "train")
        .when((t > a) & (t <= b) & (t >= a + gap) & (t <= b - gap), "val")
        .when((t > b) & (t >= b + gap), "test")
    )


def time_split(df: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Rows with their ``part``; rows inside a purge gap are left out, as the rule says."""
    cuts = find_cuts(df, cfg)
    return df.withColumn("part", part_column(cuts, cfg)).filter(F.col("part").isNotNull())


def split_summary(parts: DataFrame, ts: str = "ts") -> DataFrame:
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def require_non_empty(summary: DataFrame) -> None:
    missing = {"train", "val", "test"} - {r["part"] for r in summary.collect()}  # three rows
    if missing:
        raise ValueError(f"empty split: {sorted(missing)}")


def verify_no_leakage(summary: DataFrame) -> DataFrame:
    """One row: max(train) < min(val) and max(val) < min(test)."""
    at = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    ok = (at("train", "last_ts") < at("val", "first_ts")) & (at("val", "last_ts") < at("test", "first_ts"))
    return summary.agg(ok.alias("no_leakage"))
