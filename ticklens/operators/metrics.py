"""Back-test metrics over long score tables.

Every function takes the columns to group by; the score column is ``score`` and the
label column ``y`` (0/1). Nothing sorts raw rows globally: rows are first counted
per distinct score, and prefix sums go through score slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.config import BacktestConfig
from ticklens.functions.numeric import clamp
from ticklens.plans.slices import Run, running, slice_of

SCORE_SLICES = 1024


def score_table(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score: positives, negatives, and both counted from the top down."""
    counts = df.groupBy(*by, "score").agg(
        F.sum(F.col("y").cast("long")).alias("pos"),
        F.sum((1 - F.col("y")).cast("long")).alias("neg"),
    )
    counts = counts.withColumn("down", -F.col("score"))
    cell = F.floor(F.col("down") * SCORE_SLICES).cast("long")
    runs = [Run("pos_to", "sum", F.col("pos")), Run("neg_to", "sum", F.col("neg"))]
    return running(counts, by, cell, ["down"], runs).drop("down")


DIRECT = 64  # tied positives that are summed one by one


def _precision_sum(tp: Column, fp: Column, p: Column) -> Column:
    """Sum of (tp + j) / (tp + fp + j) for j = 1..p: precision at each tied positive.

    The first ``DIRECT`` terms one by one; of the others, those that are left, less ``fp`` times the sum of their reciprocals,
    which the midpoint rule with two corrections gives to the last digits that far from 0.
    """
    n = tp + fp
    head = F.aggregate(
        F.sequence(F.lit(1), F.lit(DIRECT)), F.lit(0.0), lambda acc, j: acc + F.when(j <= p, (tp + j) / (n + j)).otherwise(0.0)
    )
    left = F.greatest(p - DIRECT, F.lit(0)).cast("double")
    a = n + (DIRECT + 0.5)
    b = a + left
    inverse = F.log1p(left / a) + (1 / (b * b) - 1 / (a * a)) / 24 - (1 / (b * b * b * b) - 1 / (a * a * a * a)) * (7 / 960)
    return head + left - fp * inverse


def ranking_quality(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """auc (ties count as wins, 0.5 for one class) and pr_auc (positives first in ties)."""
    t = score_table(df, by)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    sums = t.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(big("neg") * big("pos_to")).cast("double").alias("wins"),
        F.sum(
            _precision_sum(F.col("pos_to") - F.col("pos"), F.col("neg_to") - F.col("neg"), F.col("pos"))
        ).alias("prec"),
    )
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return sums.select(
        *by,
        (F.col("n_pos") + F.col("n_neg")).alias("n_samples"),
        F.col("n_pos").alias("n_positives"),
        F.when((p == 0) | (n == 0), 0.5).otherwise(F.col("wins") / (p * n)).alias("auc"),
        F.when(p == 0, 0.0).otherwise(F.col("prec") / p).alias("pr_auc"),
    )


def brier(df: DataFrame, by: Sequence[str]) -> DataFrame:
    err = F.col("score") - F.col("y")
    return df.groupBy(*by).agg(F.avg(err * err).alias("brier_score"))


def _bins(df: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    err = F.col("score") - F.col("y")
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("score").alias("score_sum"),
        F.sum(F.col("y").cast("long")).alias("y_sum"),
        F.sum(err * err).alias("sq_sum"),
    )


def reliability_bins(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Accuracy, confidence and count per bin; empty bins keep their midpoint."""
    got = _bins(df, by, bins)
    frame = got.select(*by).distinct() if by else got.limit(1).select()
    frame = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = frame.join(got, [*by, "bin"], "left")
    n = F.coalesce("n", F.lit(0))
    return full.select(
        *by,
        "bin",
        n.alias("n"),
        F.when(n > 0, F.col("y_sum") / n).otherwise(0.0).alias("accuracy"),
        F.when(n > 0, F.col("score_sum") / n)
        .otherwise((F.col("bin") + 0.5) / bins)
        .alias("confidence"),
    )


def calibration_error(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """brier_score, ece and mce in one pass over the rows."""
    gap = F.abs(F.col("y_sum") / F.col("n") - F.col("score_sum") / F.col("n"))
    total = F.sum("n")
    return _bins(df, by, bins).groupBy(*by).agg(
        (F.sum("sq_sum") / total).alias("brier_score"),
        (F.sum(F.col("n") * gap) / total).alias("ece"),
        F.max(gap).alias("mce"),
    )


def topk_metrics(df: DataFrame, by: Sequence[str], k: int = 20) -> DataFrame:
    """capture, precision and mean edge of the k best scores (the k rows are cut per task)."""
    pos = df.groupBy(*by).agg(F.sum(F.col("y").cast("long")).alias("n_pos"))
    best = lambda tie: Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(tie).desc())
    top = lambda tie: df.withColumn("rn", F.row_number().over(best(tie))).filter(F.col("rn") <= k)
    hits = top("y").groupBy(*by).agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n_top"))
    edge = top("edge").groupBy(*by).agg(F.avg("edge").alias("topk_mean_edge_bps"))
    out = pos.join(hits, list(by)).join(edge, list(by))
    return out.select(
        *by,
        F.when(F.col("n_pos") == 0, 0.0).otherwise(F.col("hits") / F.col("n_pos")).alias("topk_capture"),
        (F.col("hits") / F.col("n_top")).alias("topk_precision"),
        "topk_mean_edge_bps",
    )


def topk_sets(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """The symbols of the top k per (by, ts): at most k per row."""
    w = Window.partitionBy(*by, "ts").orderBy(F.col("score").desc(), "symbol")
    top = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return top.groupBy(*by, "ts").agg(F.collect_set("symbol").alias("names"))


def set_changes(df: DataFrame, by: Sequence[str], k: int, slice_ms: int = 3_600_000) -> DataFrame:
    """Entered, exited and common symbols between consecutive instants."""
    sets = topk_sets(df, by, k)
    run = Run("was", "last", F.col("names"), inclusive=False)
    steps = running(sets, by, slice_of(F.col("ts"), slice_ms), ["ts"], [run])
    steps = steps.filter(F.col("was").isNotNull())
    now, was = F.col("names"), F.col("was")
    return steps.select(
        *by,
        "ts",
        F.array_except(now, was).alias("entered"),
        F.array_except(was, now).alias("exited"),
        F.array_intersect(now, was).alias("common"),
        F.array_union(now, was).alias("either"),
    )


def churn(df: DataFrame, by: Sequence[str], k: int = 20, slice_ms: int = 3_600_000) -> DataFrame:
    """Changes per step, half of it as rank changes, mean Jaccard; (0, 0, 1) below two steps."""
    steps = set_changes(df, by, k, slice_ms)
    moved = F.size("entered") + F.size("exited")
    jac = F.when(F.size("either") > 0, F.size("common") / F.size("either")).otherwise(1.0)
    got = steps.groupBy(*by).agg(
        F.avg(moved).alias("state_changes_per_step"), F.avg(jac).alias("jaccard_similarity")
    )
    out = df.groupBy(*by).agg(F.min("ts").alias("_t")).join(got, list(by), "left")
    moves = F.coalesce("state_changes_per_step", F.lit(0.0))
    return out.select(
        *by,
        (moves / 2).alias("rank_changes_per_step"),
        moves.alias("state_changes_per_step"),
        F.coalesce("jaccard_similarity", F.lit(1.0)).alias("jaccard_similarity"),
    )


def label_scores(labels_long: DataFrame) -> DataFrame:
    """Labels as their own scores: the net edge clamped to [0, 1]."""
    return labels_long.select(
        "horizon",
        "profile",
        "ts",
        "symbol",
        F.col("i_tradeable").alias("y"),
        F.col("net_edge_bps").alias("edge"),
        clamp((F.col("net_edge_bps") + 50) / 100, 0.0, 1.0).alias("score"),
    )


def toxicity_scores(labels: DataFrame) -> DataFrame:
    return labels.select(
        F.lit("toxic").alias("horizon"),
        F.lit("-").alias("profile"),
        "ts",
        "symbol",
        F.col("y_toxic").alias("y"),
        F.lit(0.0).alias("edge"),
        clamp(F.col("severity_toxic_bps") / 50, 0.0, 1.0).alias("score"),
    )


def backtest(scored: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Every metric per (horizon, profile); the toxicity group has no top-k and churn."""
    by = ["horizon", "profile"]
    out = ranking_quality(scored, by).join(calibration_error(scored, by, cfg.bins), by)
    trad = scored.filter(F.col("horizon") != "toxic")
    out = out.join(topk_metrics(trad, by, cfg.top_k), by, "left")
    return out.join(churn(trad, by, cfg.top_k), by, "left")


def backtest_labels(labels: DataFrame, long: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    keep = F.col("horizon").isin(*cfg.horizons) & F.col("profile").isin(*cfg.profiles)
    return backtest(label_scores(long.filter(keep)).unionByName(toxicity_scores(labels)), cfg)


def backtest_scores(
    labels: DataFrame, long: DataFrame, scores: DataFrame, cfg: BacktestConfig = BacktestConfig()
) -> DataFrame:
    """The same with model probabilities, joined by (symbol, ts)."""
    p = F.create_map(*[x for h in cfg.horizons for x in (F.lit(h), F.col(f"p_inplay_{h}"))])
    keep = F.col("horizon").isin(*cfg.horizons) & F.col("profile").isin(*cfg.profiles)
    trad = long.filter(keep).join(scores, ["symbol", "ts"]).select(
        "horizon", "profile", "ts", "symbol",
        F.col("i_tradeable").alias("y"), F.col("net_edge_bps").alias("edge"),
        p[F.col("horizon")].alias("score"),
    )
    tox = labels.join(scores, ["symbol", "ts"]).select(
        F.lit("toxic").alias("horizon"), F.lit("-").alias("profile"), "ts", "symbol",
        F.col("y_toxic").alias("y"), F.lit(0.0).alias("edge"), F.col("p_toxic").alias("score"),
    )
    return backtest(trad.unionByName(tox), cfg)


def acceptance(result: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    return result.filter(F.col("horizon") != "toxic").select(
        "horizon", "profile", "ece", (F.col("ece") < cfg.max_ece).alias("accepted")
    )
