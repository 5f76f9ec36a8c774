"""Platt calibration of several heads at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.config import HEADS
from ticklens.functions.calibrate import EPS, logit, platt, sigmoid
from ticklens.operators.metrics import calibration_error
from ticklens.session import cut_lineage


def label_column(head: str) -> str:
    """The label a head is calibrated on (profile a for the in-play heads)."""
    if head == "p_toxic":
        return "y_toxic"
    if head.startswith("p_inplay_"):
        return f"i_tradeable_{head.removeprefix('p_inplay_')}_a"
    raise ValueError(f"unknown head {head}")


def heads_long(df: DataFrame, heads: Sequence[str] = HEADS) -> DataFrame:
    """Unpivot the heads whose probability and label columns are there: head, score, y."""
    present = [h for h in heads if h in df.columns and label_column(h) in df.columns]
    if not present:
        raise ValueError("no head with both probability and label")
    rows = F.array(
        *[
            F.struct(
                F.lit(h).alias("head"),
                F.col(h).cast("double").alias("score"),
                F.col(label_column(h)).cast("int").alias("y"),
            )
            for h in present
        ]
    )
    long = df.select(F.inline(rows))
    ok = (F.col("score") >= 0) & (F.col("score") <= 1) & F.col("y").isin(0, 1)
    return long.withColumn(
        "score", F.when(ok, F.col("score")).otherwise(F.raise_error(F.lit("probability or label out of range")))
    )


def fit_platt(
    long: DataFrame,
    max_iter: int = 100,
    lr: float = 0.1,
    tol: float = 1e-6,
    reject_negative_slope: bool = True,
) -> dict[str, tuple[float, float]]:
    """(a, b) per head by gradient descent on the logistic loss with smoothed targets.

    Rows are counted per distinct (head, score, y) once; an iteration is one small
    aggregation of that table for all heads that have not settled yet.
    """
    table = cut_lineage(
        long.groupBy("head", "score", "y").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("x", logit(F.col("score")))
    )
    sizes = table.groupBy("head").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("pos")
    )
    stats = {r["head"]: (r["n"], r["pos"]) for r in sizes.collect()}  # one row per head
    for head, (n, pos) in stats.items():
        if n < 2 or pos in (0, n):
            raise ValueError(f"{head}: need positive and negative samples")
    state = {h: {"a": 1.0, "b": 0.0, "loss": math.inf} for h in stats}
    open_heads = set(stats)
    for _ in range(max_iter):
        if not open_heads:
            break
        rows = sorted(open_heads)
        pick = lambda f: F.create_map(
            *[x for h in rows for x in (F.lit(h), F.lit(float(f(h))))]
        )[F.col("head")]
        target = F.when(
            F.col("y") == 1, pick(lambda h: (stats[h][1] + 1) / (stats[h][1] + 2))
        ).otherwise(pick(lambda h: 1 / (stats[h][0] - stats[h][1] + 2)))
        p = sigmoid(pick(lambda h: state[h]["a"]) * F.col("x") + pick(lambda h: state[h]["b"]))
        q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
        n, err = F.col("n"), p - target
        step = (
            table.filter(F.col("head").isin(rows))
            .groupBy("head")
            .agg(
                F.sum(-n * (target * F.log(q) + (1 - target) * F.log(1 - q))).alias("loss"),
                F.sum(n * err * F.col("x")).alias("ga"),
                F.sum(n * err).alias("gb"),
            )
        )
        for r in step.collect():  # one row per head
            s, total = state[r["head"]], stats[r["head"]][0]
            loss = r["loss"] / total
            if abs(s["loss"] - loss) < tol:
                open_heads.discard(r["head"])
                continue
            s.update(loss=loss, a=s["a"] - lr * r["ga"] / total, b=s["b"] - lr * r["gb"] / total)
    for h, s in state.items():
        if reject_negative_slope and s["a"] <= 0:
            raise ValueError(f"{h}: slope {s['a']:.4f} would invert rankings")
    return {h: (s["a"], s["b"]) for h, s in state.items()}


def calibrators_table(like: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """The parameters as rows (head, a, b): as many as there are heads."""
    rows = [(h, float(a), float(b)) for h, (a, b) in sorted(params.items())]
    return like.sparkSession.createDataFrame(rows, "head string, a double, b double")


def apply_calibrators(long: DataFrame, calibrators: DataFrame) -> DataFrame:
    """Add ``calibrated``; a head without parameters keeps its raw score."""
    rows = long.join(calibrators, "head", "left")
    cal = platt(F.col("score"), F.col("a"), F.col("b"))
    return rows.withColumn(
        "calibrated", F.when(F.col("a").isNotNull(), cal).otherwise(F.col("score"))
    ).drop("a", "b")


def calibrate_all(df: DataFrame, heads: Sequence[str] = HEADS, **fit: object) -> DataFrame:
    """Parameters per head with Brier score and ECE before and after."""
    long = heads_long(df, heads)
    cal = calibrators_table(df, fit_platt(long, **fit))
    scored = apply_calibrators(long, cal)
    before = calibration_error(scored, ["head"]).selectExpr(
        "head", "brier_score AS brier_before", "ece AS ece_before"
    )
    after = calibration_error(
        scored.select("head", "y", F.col("calibrated").alias("score")), ["head"]
    ).selectExpr("head", "brier_score AS brier_after", "ece AS ece_after")
    return cal.join(before, "head").join(after, "head")
