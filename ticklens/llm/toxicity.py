"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed words and word beginnings (inflected insults share one). The machine
adds a weight per term and, for every two terms that occur together, the product of their factors:
an insult next to a group mention scores more than both alone.

The machine, its choice of terms included, is fitted on a sample of ``max_fit_rows`` labelled ids in expectation,
chosen by a hash of the id. Rows whose crc32(doc_id) modulo 4 is 2 are held out; labels, language, source and id
are no inputs of a score. Only the sample of ids, whose size is that parameter, is broadcast; texts are not
shuffled, but for those of the sample. Scoring reads every text whole, once.

Null texts count as empty and score by the bias alone. An id whose labels disagree counts as toxic, one with
several texts teaches with the least of them; null labels and ids teach nothing. With nothing to learn from, every
score is 0. Repeated rows are scored alike; other columns are only carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.llm.common import remainder, small_batches, text_of
from ticklens.session import cut_lineage

if TYPE_CHECKING:
    import numpy as np

BUCKETS = 1 << 22
BEGINNINGS = (4, 5, 6)  # bytes
FOLDS, HELD_OUT = 4, 2
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
THRESHOLD = 0.3


def terms(text: str) -> set[int]:
    """Buckets of the words of a text and of their beginnings."""
    words = set(WORD.findall(text.encode("utf-8", "surrogatepass").lower()))
    found = {crc32(w) for w in words}
    for k in BEGINNINGS:
        found.update([crc32(w, k) for w in {w[:k] for w in words if len(w) >= k}])
    return {h & (BUCKETS - 1) for h in found}


@dataclass(frozen=True)
class Machine:
    """Bias, and per chosen term a weight and a row of factors; ``at`` places a term in them."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    at: dict[int, int]

    def score(self, text: str) -> float:
        import numpy as np

        rows = [j for t in terms(text) if (j := self.at.get(t)) is not None]
        z = self.bias
        if rows:
            rows.sort()  # one order of summing, whatever the set's
            v = self.factors[rows]
            z += float(self.weights[rows].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-z))) if z > -500 else 0.0


def labelled(
    docs: DataFrame,
    labels: DataFrame,
    max_fit_rows: int,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
) -> DataFrame:
    """(id, toxic, terms) of the ids that teach, written once."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(terms(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int32()))], ["id", "toxic", "terms"])  # noqa: E501

    learnable = F.col(toxic).isNotNull() & (remainder(F.col(doc_id), FOLDS) != HELD_OUT)
    said = labels.filter(learnable).groupBy(F.col(doc_id).cast("string").alias("id"))
    said = said.agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    share = min(1.0, max_fit_rows / max(1, said.count()))
    some = said.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    mine = docs.select(F.col(doc_id).cast("string").alias("id"), text_of(text).alias("text"))
    known = mine.join(F.broadcast(some), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return cut_lineage(known.mapInArrow(run, "id string, toxic int, terms array<int>"))


def chosen_terms(rows: DataFrame, n_terms: int, min_docs: int) -> tuple[list[int], int, int]:
    """The terms whose shares in toxic and other texts differ most, and the two row counts."""
    n1, n = rows.agg(F.sum("toxic"), F.count("*")).first()
    n1 = int(n1 or 0)
    if not n1 or n1 == n:
        return [], n1, n
    per = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term")
    counted = per.agg(F.sum("toxic").alias("a"), F.count("*").alias("d")).filter(F.col("d") >= min_docs)
    share = F.lit(n1 / n)
    z = F.abs(F.col("a") - F.col("d") * share) / F.sqrt(F.col("d") * share * (1 - share))
    best = counted.select("term", z.alias("z")).orderBy(F.desc("z"), "term").limit(n_terms)
    return sorted(r.term for r in best.collect()), n1, n


def train(x: np.ndarray, y: np.ndarray, factors: int, steps: int, rate: float, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss by Adam over the whole sample; ``x`` has a row per text, ones and zeros."""
    import numpy as np

    rng = np.random.default_rng(7)
    share = float(y.mean(dtype="float64"))
    p = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(x.shape[1]), "v": rng.normal(0, 0.05, (x.shape[1], factors))}
    p = {k: a.astype("float32") for k, a in p.items()}
    m = {k: np.zeros_like(a) for k, a in p.items()}
    s = {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        sums = x @ p["v"]
        z = p["b"] + x @ p["w"] + 0.5 * ((sums**2).sum(axis=1) - (x @ (p["v"] ** 2)).sum(axis=1))
        e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype("float32")
        seen = x.T @ e
        g = {"b": np.array([e.sum()]), "w": seen + decay * p["w"]}
        g["v"] = x.T @ (e[:, None] * sums) - seen[:, None] * p["v"] + decay * p["v"]
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype("float32")
    return float(p["b"][0]), p["w"].astype("float64"), p["v"].astype("float64")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_fit_rows: int = 24_000,
    n_terms: int = 512,
    min_docs: int = 3,
    factors: int = 8,
    steps: int = 300,
    rate: float = 0.03,
    decay: float = 1e-4,
    **names: str,
) -> Machine:
    import numpy as np

    rows = labelled(docs, labels, max_fit_rows, **names)
    best, n1, n = chosen_terms(rows, n_terms, min_docs)
    empty = np.zeros((0, factors))
    if not best:
        return Machine(-np.inf if not n1 else np.inf, np.zeros(0), empty, {})
    at = {t: j for j, t in enumerate(best)}
    kept = F.array_intersect("terms", F.array(*(F.lit(t) for t in best)))
    some = sorted(rows.select("id", "toxic", kept.alias("terms")).collect(), key=lambda r: r.id)
    y = np.array([r.toxic for r in some], "float32")
    x = np.zeros((len(some), len(best)), "float32")
    for i, r in enumerate(some):
        x[i, [at[t] for t in r.terms]] = 1
    bias, weights, v = train(x, y, factors, steps, rate, decay)
    return Machine(bias, weights, v, at)


def score(docs: DataFrame, machine: Machine, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns, ``score`` and ``predicted``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [machine.score(t.as_py()) for t in batch.columns[-1]]
            made = [pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*carry, "score", "predicted"])

    small_batches(docs.sparkSession)
    rows = docs.select(*carry, text_of(text).alias("__text"))
    made = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *made]))
