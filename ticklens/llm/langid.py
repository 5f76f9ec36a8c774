"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams. Each language has several centroids,
found by spherical k-means on its vectors. A text gets the language of the centroid with the highest
cosine and is rejected when that cosine is far below what the centroid's own texts of its size reach; size is the
number of different n-grams, so that a short text and one that repeats itself are held to what short texts reach.

Document frequencies and the limits of rejection come from every learnable row, the latter from exact counts of the cosines
that all of them and their beginnings reach, in steps of 1 / ``STEPS``. Only the clustering works on a sample, of
``max_fit_rows`` rows in all, chosen by a hash of id and text; letterless texts are left out of both. Rows whose crc32(doc_id) modulo 5 is 0 are held
out, rows without an id or a language teach nothing; language, source and id are no inputs of a
prediction. Whole texts are read, one at a time in Arrow batches; nothing is shuffled but counts.

A null text and one without a letter give ``und``, score 0 and are rejected. With nothing to learn
from, every text is ``und``. Repeated rows are predicted alike; other columns are only carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.llm.common import drop_put_by, remainder, set_aside, small_batches

if TYPE_CHECKING:
    import numpy as np

WIDTH = 4096  # hash buckets of n-grams
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
FOLDS = 5
BANDS = 13  # of different n-grams, by powers of two
BEGINNINGS = tuple(4 << i for i in range(11))  # characters
FEW = 30  # cosines that a limit of its own takes
STEPS = 4096  # of a cosine, where limits are counted
SEEDS = 1024


def _alphabet() -> bytes:
    """Lower-case letters stay, other ASCII is a blank, bytes of other letters stay."""
    return bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


ALPHABET = _alphabet()
PIECE = 1 << 20


def counts(text: str) -> np.ndarray:
    """How often each bucket is hit by the text's byte bigrams and trigrams."""
    import numpy as np

    raw = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(ALPHABET).split()) + b" "
    b = np.frombuffer(raw, "uint8")
    out = np.zeros(WIDTH, "float64")
    for at in range(0, len(b), PIECE):
        part = b[at : at + PIECE + 2].astype("uint32")
        two = part[:-1][:PIECE] << 8 | part[1:][:PIECE]
        three = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        for grams, salt in ((two, 0x85EBCA6B), (three, 0x9E3779B1)):
            out += np.bincount((grams * np.uint32(salt)) >> np.uint32(20), minlength=WIDTH)
    return out


@dataclass(frozen=True)
class Model:
    """Languages of the centroids, the centroids, the rejection cosines of each by band, and IDF weights."""

    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def band(tf: np.ndarray) -> int:
    """Text size: the binary digits of the number of different n-grams."""
    return min(BANDS - 1, int((tf > 0).sum()).bit_length())


def normalised(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    import numpy as np

    v = np.log1p(tf) * idf
    n = np.sqrt(v @ v)
    return v / n if n else v


def learnable(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(lang, text, pick) of the rows that may teach; ``pick`` is uniform in 0 … 1."""
    pick = F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = docs.filter((remainder(F.col(doc_id), FOLDS) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), pick.alias("pick"))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Over all rows, in how many texts each bucket occurs. What comes back has ``WIDTH`` rows."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_put_by()
        seen = np.zeros(WIDTH, "int64")
        for batch in batches:
            for t in batch.column("text"):
                seen += counts(t.as_py()) > 0
        hit = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(seen[hit], pa.int64())], ["bucket", "n"])

    out = np.zeros(WIDTH, "int64")
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows.

    Starts from rows that bring all others nearest to a start, so that an outlier takes no centroid and no chance is
    needed; the first ``SEEDS`` rows can be starts.
    """
    import numpy as np

    close = x @ x[:SEEDS].T
    near, picked = np.zeros(len(x)), []
    while len(picked) < min(k, close.shape[1]):
        picked.append(int(np.argmax(np.maximum(close, near[:, None]).sum(axis=0))))
        near = np.maximum(near, close[:, picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) for j in range(len(c))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def quantile(steps: np.ndarray, share: float) -> float:
    """The quantile ``share`` of cosines of which ``steps`` has the counts, between neighbours in proportion."""
    import numpy as np

    up_to = np.cumsum(steps)
    at = share * (up_to[-1] - 1)
    low, high = (int(np.searchsorted(up_to, k, side="right")) for k in (math.floor(at), math.ceil(at)))
    return (low + (high - low) * (at - math.floor(at))) / STEPS


def limits(steps: np.ndarray, share: float, slack: float) -> np.ndarray:
    """Rejection cosine of each of a language's centroids in each band; ``steps`` counts cosines by centroid, band and step.

    ``slack`` times the quantile ``share`` of the centroid's own cosines there, of the language's if it has few. A band
    that is rare in the whole language accepts what the band below accepts.
    """
    import numpy as np

    out = np.zeros(steps.shape[:2])
    first = int(np.flatnonzero(steps.sum(axis=(0, 2)))[0])
    for b in range(first, BANDS):
        here = steps[:, b].sum(axis=0)
        for j in range(len(steps)):
            mine = steps[j, b]
            some = mine if mine.sum() >= FEW else here
            limit = slack * quantile(some, share) if some.any() else np.inf
            out[j, b] = min(limit, out[j, b - 1]) if here.sum() < FEW and b > first else limit
    out[:, :first] = out[:, first : first + 1]
    return out


def fit(
    docs: DataFrame, max_fit_rows: int = 2048, clusters: int = 4, share: float = 0.005, slack: float = 0.5, **columns: str
) -> Model:
    """Centroids per language, and what each rejects (see ``limits``)."""
    import numpy as np
    import pyarrow as pa

    small_batches(docs.sparkSession)
    nothing = Model([], np.zeros((0, WIDTH)), np.zeros((0, BANDS)), np.ones(WIDTH))
    rows = learnable(docs, **columns)
    n_of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not n_of:
        return nothing
    df = document_frequencies(rows)
    idf = np.log((1 + sum(n_of.values())) / (1 + df)) + 1
    each = max(1, max_fit_rows // len(n_of))
    rate = F.create_map(*(F.lit(v) for lang, n in n_of.items() for v in (lang, min(1.0, 1.5 * each / n))))

    def lettered(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([bool(LETTER.search(t.as_py())) for t in batch.column("text")], pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_put_by()
        for batch in batches:
            batch = lettered(batch)
            vs = [normalised(counts(t.as_py()), idf).astype("float32").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("pick"), pa.array(vs, pa.binary())], ["lang", "pick", "v"])  # noqa: E501

    picked = rows.filter(F.col("pick") < rate[F.col("lang")])
    some: dict[str, list[tuple[float, bytes]]] = {lang: [] for lang in n_of}
    for r in picked.mapInArrow(run, "lang string, pick double, v binary").collect():
        some[r.lang].append((r.pick, bytes(r.v)))
    # A language without any is one without letters, or a rare one that the hash passed by; the rate is 1 unless it has many rows.
    found = {
        lang: spherical_kmeans(np.stack([np.frombuffer(v, "float32") for _, v in sorted(vs)[:each]]).astype("float64"), clusters)
        for lang, vs in some.items()
        if vs
    }
    del some
    if not found:
        return nothing
    number = {lang: k for k, lang in enumerate(found)}
    names = ["lang", "own", "band", "step"]

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_put_by()
        for batch in batches:
            batch = lettered(batch)
            out = []
            for lang, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                for part in (*(t[:n] for n in BEGINNINGS if n < len(t)), t) if lang in found else ():
                    if LETTER.search(part):
                        tf = counts(part)
                        cos = found[lang] @ normalised(tf, idf)
                        j = int(np.argmax(cos))
                        out.append((number[lang], j, band(tf), min(STEPS, int(cos[j] * STEPS))))
            each, n = np.unique(np.array(out, "int32").reshape(-1, 4), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, each.T.copy()), pa.array(n)], [*names, "n"])

    steps = [np.zeros((len(c), BANDS, STEPS + 1), "int64") for c in found.values()]
    seen = rows.mapInArrow(reached, "lang int, own int, band int, step int, n long").groupBy(*names).agg(F.sum("n").alias("n"))
    seen = seen.toArrow()
    for lang, own, size, step, n in zip(*(seen.column(c).to_pylist() for c in (*names, "n")), strict=True):
        steps[lang][own, size, step] = n
    least = [limits(x, share, slack) for x in steps]
    langs = [lang for lang, c in found.items() for _ in range(len(c))]
    return Model(langs, np.concatenate(list(found.values())), np.concatenate(least), idf)


def predict(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns, ``lang_pred``, ``score`` (the cosine) and ``rejected``."""
    import numpy as np
    import pyarrow as pa

    small_batches(docs.sparkSession)
    centroids = model.centroids.astype("float64")

    def one(t: str | None) -> tuple[str, float, bool]:
        if t is None or not len(centroids) or not LETTER.search(t):
            return UNKNOWN, 0.0, True
        tf = counts(t)
        cos = centroids @ normalised(tf, model.idf)
        j = int(np.argmax(cos))
        return model.langs[j], min(1.0, max(0.0, float(cos[j]))), bool(cos[j] < model.least[j, band(tf)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_put_by()
        for batch in batches:
            said = [one(t.as_py()) for t in batch.columns[at]]
            made = [pa.array([s[k] for s in said], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], [*carry, "lang_pred", "score", "rejected"])

    at = carry.index(text) if text in carry else len(carry)
    rows = docs.select(*dict.fromkeys([*carry, text]))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]  # noqa: E501
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(carry)], *made]))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    rows, name, back = set_aside(docs)
    return back(predict(rows, model, rows.columns, name[text]).filter(~F.col("rejected")))
