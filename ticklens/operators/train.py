"""Training rows and boosted trees for the prediction heads.

A label sample meets the last snapshot at or before it, never a later one, and parts are cut by time. Trees are grown by
``spark.ml`` from gradient histograms that the tasks add up; the validation part stops the boosting. The trained heads
are a function of a DataFrame, as ``predict_model`` takes it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.config import HEADS, SplitConfig
from ticklens.operators.asof import asof_join
from ticklens.operators.calibration import label_column
from ticklens.operators.predict import feature_vector
from ticklens.operators.split import time_split
from ticklens.session import cut_lineage


@dataclass(frozen=True)
class TrainConfig:
    max_rounds: int = 20
    depth: int = 3
    step: float = 0.2
    bins: int = 32
    min_rows: int = 20  # of a leaf
    seed: int = 7


def training_rows(snap: DataFrame, labels_wide: DataFrame, slice_ms: int = 600_000) -> DataFrame:
    """Labels with ``feature_ts`` and ``features`` of the symbol's last snapshot at or before the sample.

    Samples without one are left out.
    """
    right = snap.select("symbol", "ts", F.struct("ts", "features").alias("of"))
    rows = asof_join(labels_wide, right, ["symbol"], "_m", slice_ms).filter(F.col("_m").isNotNull())
    return rows.select(*labels_wide.columns, F.col("_m.of.ts").alias("feature_ts"), F.col("_m.of.features").alias("features"))


def _with_vector(df: DataFrame) -> DataFrame:
    flat = df.select("*", *(F.col(f"features.{f.name}").alias(f"_f_{f.name}") for f in df.schema["features"].dataType.fields))
    names = {c: c.removeprefix("_f_") for c in flat.columns if c.startswith("_f_")}
    kept = [c for c in df.columns if c not in names.values()]
    inner = flat.select(F.struct(*kept).alias("_row"), *(F.col(c).alias(n) for c, n in names.items()))
    return inner.select("_row.*", feature_vector().alias("vector"))


Head = GBTClassificationModel | float


def train_heads(
    parts: DataFrame, heads: Sequence[str] = HEADS, cfg: TrainConfig = TrainConfig()
) -> dict[str, Head]:
    """A boosted model per head from rows with ``features``, labels and ``part``; test rows are never read.

    A head whose training rows have one class only is that class's share.
    """
    rows = _with_vector(parts.filter(F.col("part").isin("train", "val")))
    labels = [label_column(h) for h in heads]
    rows = cut_lineage(rows.select(array_to_vector("vector").alias("x"), (F.col("part") == "val").alias("held"), *labels))
    sums = rows.filter("NOT held").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in labels)).first()
    out: dict[str, Head] = {}
    for head, label in zip(heads, labels, strict=True):
        if not sums["n"]:
            raise ValueError("train part is empty")
        if sums[label] in (0, sums["n"]):
            out[head] = float(sums[label] / sums["n"])
            continue
        trees = GBTClassifier(
            featuresCol="x", labelCol=label, validationIndicatorCol="held", maxIter=cfg.max_rounds, maxDepth=cfg.depth,
            stepSize=cfg.step, maxBins=cfg.bins, minInstancesPerNode=cfg.min_rows, seed=cfg.seed, checkpointInterval=10,
        )
        out[head] = trees.fit(rows.withColumn(label, F.col(label).cast("double")).select("x", "held", label))
    return out


def as_model(heads: dict[str, Head]) -> Callable[[DataFrame], DataFrame]:
    """The trained heads as a model of ``predict_model``: adds their columns to rows with ``vector``."""

    def model(df: DataFrame) -> DataFrame:
        names = df.columns
        df = df.withColumn("_x", array_to_vector("vector"))
        for head, trees in heads.items():
            if isinstance(trees, float):
                df = df.withColumn(head, F.lit(trees))
                continue
            own = trees.copy().setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c")
            df = own.transform(df).withColumn(head, vector_to_array("_p")[1]).drop("_p", "_r", "_c")
            names = [*names, head]
        return df.drop("_x")

    return model


def evaluate_heads(parts: DataFrame, heads: dict[str, Head], baseline: DataFrame) -> DataFrame:
    """Brier score on the test part of each head: trained, of ``baseline`` (symbol, ts, heads), and of the training share."""
    scored = as_model(heads)(_with_vector(parts)).alias("m")
    base = baseline.select("symbol", F.col("ts").alias("feature_ts"), *(F.col(h).alias(f"_b_{h}") for h in heads))
    rows = scored.join(base, ["symbol", "feature_ts"], "left")
    each = F.array(
        *(
            F.struct(
                F.lit(h).alias("head"), F.col(label_column(h)).cast("double").alias("y"), F.col(h).alias("p"), F.col(f"_b_{h}").alias("b")
            )
            for h in heads
        )
    )
    long = cut_lineage(rows.select("part", F.inline(each)))
    share = long.filter("part = 'train'").groupBy("head").agg(F.avg("y").alias("share"), F.count(F.lit(1)).alias("n_train"))
    err = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    test = long.filter("part = 'test'").join(share, "head")
    return test.groupBy("head", "n_train").agg(
        F.count(F.lit(1)).alias("n_test"), err("p").alias("brier"), err("b").alias("brier_baseline"), err("share").alias("brier_share")
    )


def split_rows(rows: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Training rows with their part in time, written once."""
    return cut_lineage(time_split(rows, cfg))
