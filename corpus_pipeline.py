"""The corpus pipeline: language ID, near-duplicates, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and is written as Parquet
before the next one reads it. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.llm import langid, mixing, pieces, secrets, similar
from ticklens.llm.common import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null, letterless and far-off texts go."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group alike in four fifths of their five-word shingles."""
    return similar.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live-looking secrets are masked, widely copied examples stay."""
    masked = secrets.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, one row per copy that the mix takes."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    return mixing.copies(mixing.sized(rows).drop("text")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each row's ids and decoded text."""
    import public_tokenizers

    return pieces.encode_decode(docs, ["doc_id", "lang", "source"], public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sentencepiece", tokens),
]

#: SQL has no centroids, fingerprints or merges; tests compare each stage with plain loops.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them lies below the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
