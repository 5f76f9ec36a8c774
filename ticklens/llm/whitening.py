"""Embedding whitening by spectrum slicing.

The covariance is a sum over Spark tasks in whole numbers, exact whatever the order: components are floor(256 x), and
each is taken less the floor of its mean before anything is multiplied. What comes to the driver is one matrix of
dimensions × dimensions. There LDLᵀ factorizations of the covariance less a shift count the eigenvalues beyond the
shift; halving isolates each of the leading ones between two shifts, with no other near, Rayleigh quotient iteration
started inside converges cubically, and counts on both sides of the result certify its number. Rows are then projected in Arrow
batches, and the covariance of what they became is taken over the fit list once more.

The fit list has each distinct vector once. Vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros; components beyond ``vectors.LIMIT`` count as that. Null ids and repeated
rows stay. Equal eigenvalues share a subspace, any orthonormal basis of which may be taken. Directions without
variance are no components, so equal vectors alone give no rows, nor does an empty table. ``deviation`` is null where
it does not fit a long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import new_folder, small_batches
from ticklens.llm.vectors import matrix, sound, summed, whole

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

COMPONENTS = 4
NO_VARIANCE = 1e-12  # of the largest eigenvalue's scale: eigenvalues below are rounding
CERTIFIED = 1e-11  # of the scale: an eigenvalue's number is counted this far to both sides
LONG = (1 << 63) - 1


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix are positive, negative and zero, by an LDLᵀ factorization.

    D has blocks of one and two rows, pivots are taken off the diagonal's largest or the largest entry of all
    (Bunch and Parlett's rule), so no factor grows and the signs of D are those of the matrix.
    """
    import numpy as np

    a, signs = np.array(a, "f8"), []
    alpha = (1 + 17**0.5) / 8
    while len(a):
        size = np.abs(a)
        one = int(size.diagonal().argmax())
        i, j = divmod(int(size.argmax()), len(a))
        if size[i, j] == 0:
            signs += [0] * len(a)
            break
        pivot = [one] if size[one, one] >= alpha * size[i, j] else [i, j]
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        d, side = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        signs += [int(np.sign(d[0, 0]))] if len(pivot) == 1 else [1, -1]  # such a block of two has one sign each
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(d, side.T)
        a = (a + a.T) / 2
    return signs.count(1), signs.count(-1), signs.count(0)


def above(v: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of ``v`` greater than ``shift``."""
    import numpy as np

    return inertia(v - shift * np.eye(len(v)))[0]


def isolated(v: np.ndarray, number: int, scale: float) -> tuple[float, float]:
    """Shifts below and above the eigenvalue of that number, unless it is equal to another within rounding.

    Every other one lies at least the slice's width away from it. So it is the nearest to any shift of the slice, and
    iteration with such a shift goes to its vector and no other.
    """
    low, high, counts = -scale, scale, (len(v), 0)
    while high - low > 1e-14 * scale:
        width = high - low
        if counts == (number, number - 1) and (above(v, low - width), above(v, high + width)) == counts:
            break
        middle = (low + high) / 2
        n = above(v, middle)
        if n >= number:
            low, counts = middle, (n, counts[1])
        else:
            high, counts = middle, (counts[0], n)
    return low, high


def rayleigh(v: np.ndarray, low: float, high: float, known: list[np.ndarray], scale: float) -> tuple[float, np.ndarray]:
    """The eigenvalue between two shifts and its vector, at right angles to the ``known`` ones.

    The first steps keep the middle of the slice as shift; then the Rayleigh quotient is the shift as long as it
    stays in the slice.
    """
    import numpy as np

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for q in known:
                x = x - (q @ x) * q
        return x / np.linalg.norm(x)

    n, slack = len(v), 1e-14 * scale
    x, shift = apart(np.random.default_rng(n + len(known)).standard_normal(n)), (low + high) / 2
    best = (np.inf, 0.0, x)
    for step in range(60):
        try:
            x = apart(np.linalg.solve(v - shift * np.eye(n), x))
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            x = apart(np.linalg.solve(v - (shift + slack) * np.eye(n), x))
        e = float(x @ v @ x)
        left = float(np.linalg.norm(v @ x - e * x))
        inside = low - slack <= e <= high + slack
        if inside and left < best[0]:
            best = (left, e, x)
        elif inside and step > 3 and left <= 1e-13 * scale:
            break
        shift = e if inside and step > 1 else (low + high) / 2
    return best[1], best[2]


def leading(v: np.ndarray, count: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The greatest eigenvalues of a covariance in falling order with their unit vectors, certified by counts."""
    import numpy as np

    scale = float(np.abs(v).sum(1).max(initial=0.0))
    found: list[tuple[float, np.ndarray]] = []
    if not scale > 0:
        return found
    unit = v / scale  # no shift and no product leaves the range of doubles
    for number in range(1, min(count, len(v)) + 1):
        low, high = isolated(unit, number, 1.0)
        e, x = rayleigh(unit, low, high, [q for _, q in found], 1.0)
        if e <= NO_VARIANCE:
            break
        if not above(unit, e - CERTIFIED) >= number > above(unit, e + CERTIFIED):
            raise ArithmeticError(f"eigenvalue {e * scale} is not number {number}")
        found.append((e * scale, x))
    return found


@dataclass(frozen=True)
class Whitening:
    """What the fit list has: its length and sums, and the leading components."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray  # a column per component
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """The whitened rows of ``x``."""
        import numpy as np

        base = np.array([s // self.n for s in self.sums], "i8")
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - base).astype("f8") - rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)² per row, exact; None beyond a long."""
        import numpy as np

        far = int(np.abs(x.astype("i8")).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        kind = "i8" if far**2 * self.dims <= LONG else object
        off = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [v if v <= LONG else None for v in (off * off).sum(1).tolist()]


def _sums_of(fit: DataFrame, dims: int, n: int, one) -> list[int]:
    """Sums over the fit list of what ``one`` gives for a matrix of rows: exact, one row per task."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # products of a few rows stay in a long
                part = one(matrix(batch.column(0).slice(at, 256), dims).astype("i8")).astype(object)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[Decimal(v) for v in total]], pa.list_(pa.decimal128(38, 0)))], ["sums"])

    return summed(fit.select("x").mapInArrow(run, "sums array<decimal(38,0)>"), n)


def rows_of(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, and how many components the longest has."""
    e = F.col(embedding)
    rows = vectors.filter(sound(e)).select(F.col(vec_id).alias("vec_id"), whole(e).alias("x"))
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.when(F.size("x") < dims, F.concat("x", F.array_repeat(F.lit(0), F.lit(dims) - F.size("x")))).otherwise(F.col("x"))
    return rows.withColumn("x", padded), dims


def fit(rows: DataFrame, dims: int, count: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of the distinct vectors ``x`` of ``rows``, and their list."""
    import numpy as np

    spark = rows.sparkSession
    small_batches(spark)
    folder = new_folder(spark, "whitening")
    rows.select("x").distinct().write.parquet(folder)
    distinct = spark.read.schema(rows.select("x").schema).parquet(folder)
    total = _sums_of(distinct, dims, dims + 1, lambda x: np.append(x.sum(0), len(x))) if dims else [0]
    sums, n = total[:dims], total[dims]
    if not n:
        return Whitening(0, tuple(sums), np.zeros(0), np.zeros((dims, 0)), 0.0), distinct
    base = np.array([s // n for s in sums], "i8")
    upper = np.triu_indices(dims)

    def products(x: np.ndarray) -> np.ndarray:
        z = x - base
        close = np.abs(z).max(initial=0) < 1 << 22  # then doubles hold the sums of 256 products exactly
        return ((z.T.astype("f8") @ z.astype("f8")).astype("i8") if close else z.T @ z)[upper]

    rest = [s - n * int(b) for s, b in zip(sums, base, strict=True)]
    v = np.zeros((dims, dims))
    for i, j, g in zip(*(u.tolist() for u in upper), _sums_of(distinct, dims, len(upper[0]), products), strict=True):
        v[i, j] = v[j, i] = (n * g - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    found = leading(v, count)
    basis = np.array([x for _, x in found]).T if found else np.zeros((dims, 0))
    return Whitening(n, tuple(sums), np.array([e for e, _ in found]), basis, float(v.trace())), distinct


def identity_error(distinct: DataFrame, machine: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    import numpy as np
    import pyarrow as pa

    m, dims = len(machine.values), machine.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m + m * m)
        for batch in batches:
            w = machine.projected(matrix(batch.column(0), dims))
            total += np.append(w.sum(0), w.T @ w)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    places = distinct.select("x").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("place", "value"))
    found = {r.place: r.v for r in places.groupBy("place").agg(F.sum("value").alias("v")).collect()}
    values = np.array([found[i] for i in range(m + m * m)]) / machine.n
    mean, second = values[:m], values[m:].reshape(m, m)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max(initial=0.0))


def whiten(rows: DataFrame, machine: Whitening, error: float) -> DataFrame:
    """A row per row of ``rows`` and component."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

    m, dims = len(machine.values), machine.dims
    explained = machine.values / machine.trace if m else machine.values
    made = {"component": IntegerType(), "n": LongType(), "deviation": LongType()}
    made |= dict.fromkeys(("whitened", "explained", "identity_error"), DoubleType())
    schema = StructType([rows.schema["vec_id"], *(StructField(k, t) for k, t in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (m and batch.num_rows):
                continue
            x = matrix(batch.column(1), dims)
            each = pa.array(np.repeat(np.arange(batch.num_rows), m))
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, m + 1, dtype="i4"), len(x))),
                pa.array(np.full(m * len(x), machine.n, "i8")),
                pa.array(machine.deviations(x), pa.int64()).take(each),
                pa.array(machine.projected(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(m * len(x), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.select("vec_id", "x").mapInArrow(run, schema)
