"""Drift of features between a baseline and the current rows: Kolmogorov–Smirnov distance and stability index.

Both come from one table: rows counted per distinct value, the counts summed up along the values in two levels. The
slices of that sum are cut at approximate quantiles, which decide about the load of tasks and nothing else; every
count is exact. No feature is sorted in one task, and no value is paired with a bin's edges: how many quantiles
lie below a value follows from how many baseline rows do.

Null and NaN values take no part. A feature that has no row on one side has null distances.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.plans.slices import Run, running
from ticklens.session import cut_lineage

CUTS = 64  # slices of values per feature
FEW = 10_000  # groups whose totals may be broadcast
EMPTY = 1e-4  # share that an empty bin counts as


def features_long(df: DataFrame, features: Sequence[str], is_base: Column) -> DataFrame:
    """feature, value, is_base: one row per row and feature."""
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    return df.select(is_base.alias("is_base"), F.inline(each)).select("feature", "value", "is_base")


def value_table(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct value: baseline and current rows, both also up to this value, and the totals of the group."""
    by = list(by)
    value = F.col("value").cast("double")
    sound = F.col("is_base").isNotNull() & value.isNotNull() & ~F.isnan(value)
    counts = long.filter(sound).groupBy(*by, (value + 0.0).alias("value")).agg(  # -0 and 0 are one value
        F.count_if("is_base").alias("base"), F.count_if(~F.col("is_base")).alias("now")
    )
    counts = cut_lineage(counts)
    cuts = F.percentile_approx("value", [i / CUTS for i in range(1, CUTS)], 1000).alias("_cuts")
    totals = counts.groupBy(*by).agg(cuts, F.sum("base").alias("n_base"), F.sum("now").alias("n_now"))
    totals = cut_lineage(totals.withColumn("_of", F.struct(*by)).drop(*by))
    totals = F.broadcast(totals) if totals.count() <= FEW else totals
    rows = counts.withColumn("_of", F.struct(*by)).join(totals, "_of").drop("_of")
    rows = rows.withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).drop("_cuts")
    runs = [Run("base_to", "sum", F.col("base")), Run("now_to", "sum", F.col("now"))]
    return running(rows, by, F.col("_cell").cast("long"), ["value"], runs).drop("_cell")


def ks_drift(long: DataFrame, by: Sequence[str] = ("feature",), coefficient: float = 1.36) -> DataFrame:
    """Largest gap between both distributions, the least value where it is, and whether it passes the limit.

    ``coefficient`` 1.36 is the usual one for a level of 5 %; the limit is it times sqrt((n + m) / (n m)).
    """
    by = list(by)
    n, m = F.col("n_base").cast("double"), F.col("n_now").cast("double")
    gap = F.abs(F.col("base_to") / F.nullif(n, F.lit(0.0)) - F.col("now_to") / F.nullif(m, F.lit(0.0)))
    rows = value_table(long, by).withColumn("_gap", gap)
    best = F.max(F.struct(F.col("_gap").alias("gap"), (-F.col("value")).alias("down"))).alias("_best")
    out = rows.groupBy(*by, "n_base", "n_now").agg(best)
    limit = F.lit(coefficient) * F.sqrt((n + m) / F.nullif(n * m, F.lit(0.0)))
    ks = F.col("_best.gap")
    at = F.when(ks.isNotNull(), -F.col("_best.down") + 0.0)
    return out.select(*by, "n_base", "n_now", ks.alias("ks"), at.alias("at_value"), limit.alias("limit"), (ks > limit).alias("drifted"))


def psi_bins(long: DataFrame, by: Sequence[str] = ("feature",), bins: int = 10) -> DataFrame:
    """Baseline and current rows per bin; bin edges are the baseline's exact quantiles, each the end of its bin.

    The j-th edge is the smallest value with at least j / bins of the baseline at or below it, so a value lies beyond
    the edges that its smaller values have filled.
    """
    by = list(by)
    below, n = F.col("base_to") - F.col("base"), F.col("n_base")
    whole = lambda j: F.call_function("div", n * j + (bins - 1), F.lit(bins).cast("long"))
    past = sum(F.when(below >= whole(j), 1).otherwise(0) for j in range(1, bins))
    rows = value_table(long, by).withColumn("bin", past)
    return rows.groupBy(*by, "bin", "n_base", "n_now").agg(F.sum("base").alias("base"), F.sum("now").alias("now"))


def psi_drift(
    long: DataFrame, by: Sequence[str] = ("feature",), bins: int = 10, warn: float = 0.1, critical: float = 0.25
) -> DataFrame:
    """Population stability index per group, and what it calls for: ok, WARN or CRITICAL."""
    by = list(by)
    share = lambda c, n: F.greatest(F.col(c) / F.nullif(F.col(n), F.lit(0)), F.lit(EMPTY))
    b, c = share("base", "n_base"), share("now", "n_now")
    known = (F.col("n_base") > 0) & (F.col("n_now") > 0)
    term = F.when(known, (c - b) * F.log(c / b))
    out = psi_bins(long, by, bins).groupBy(*by, "n_base", "n_now").agg(F.count(F.lit(1)).alias("n_bins"), F.sum(term).alias("psi"))
    level = F.when(F.col("psi") >= critical, "CRITICAL").when(F.col("psi") >= warn, "WARN").when(F.col("psi").isNotNull(), "OK")
    return out.withColumn("level", level)


def prediction_drift(pred: DataFrame, ts: str, value: str, slice_ms: int) -> DataFrame:
    """Mean and variance of a prediction per time slice and their steps to the slice before; variances do not cancel."""
    cell = F.floor(F.col(ts) / slice_ms).cast("long")
    per = pred.groupBy(cell.alias("cell")).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance")
    )
    was = Run("_was", "last", F.struct("mean", "variance"), inclusive=False)
    rows = running(per, [], F.floor(F.col("cell") / 1024).cast("long"), ["cell"], [was])
    step = lambda c: (F.col(c) - F.col(f"_was.{c}")).alias(f"{c}_step")
    return rows.select("cell", "n", "mean", "variance", step("mean"), step("variance"))
