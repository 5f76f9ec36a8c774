"""Clustering by heap-ordered bounds and whitening by spectrum slicing against plain loops and SQL."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm import data
from tests.test_check_sql import canon
from ticklens.llm import clustering, whitening
from ticklens.llm.queries import ORACLE, QUERIES

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
CLASHING = ("id", "v", "x", "cluster", "distance", "key", "n", "component", "sums")


def vectors(n: int = 150, dims: int = 64, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [m + rng.gauss(0, 0.02 + 0.001 * j) for j, m in enumerate(rng.choice(centre))]) for i in range(n)]
    odd = [
        (None, rows[0][1]),
        (n, None),
        (n + 1, []),
        (n + 2, [0.1] * 63 + [None]),
        (n + 3, [0.1] * 63 + [float("nan")]),
        (n + 4, [float("-inf")] + [0.1] * 63),
        (n + 5, [0.25, -0.5]),
        (n + 6, rows[3][1]),
        (n + 6, rows[3][1]),
        (n + 6, rows[4][1]),
        (n + 7, [0.0] * dims),
    ]
    return rows + odd


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("odd"), vectors(), VECTORS, "embeddings")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("empty"), [], VECTORS, "embeddings")


def whole(row):
    return tuple(int(np.floor(256 * float(np.float32(x)))) for x in row)


def sound(row):
    return row is not None and all(x is not None and np.isfinite(x) for x in row)


# ---- clusters


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_clusters_equal_sql(spark, request, table):
    folder = request.getfixturevalue(table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got, want = QUERIES["op11_heap_clusters"](spark, folder).toPandas(), con.execute(ORACLE["op11_heap_clusters"]).df()
    assert canon(got) == canon(want) and len(got) == (155 if table == "odd" else 0)


def plain_rounds(rows, k, rounds, seed=2):
    key = lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [r[1] for r in sorted((r for r in rows if r[0] is not None), key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(rows, at, strict=True) if c == j]
            if own:
                centroids[j] = tuple(sum(p) // len(own) for p in zip(*own, strict=True))
    return sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in rows), centroids


@pytest.mark.parametrize(("k", "rounds", "block"), [(1, 2, 2048), (5, 6, 16), (12, 0, 7), (400, 3, 50)])
def test_clusters_equal_plain_rounds(spark, monkeypatch, k, rounds, block):
    """Any number of clusters, also more than vectors, and blocks of any size; columns with clashing names."""
    monkeypatch.setattr(clustering, "BLOCK", block)
    rows = [(i, e) for i, e in vectors() if sound(e) and len(e) == 64]
    df = spark.createDataFrame(vectors(), VECTORS).repartition(3).select("*", *(F.lit("mine").alias(c) for c in CLASHING))
    got, centroids = clustering.cluster(df, k=k, rounds=rounds)
    want, means = plain_rounds([(i, whole(e)) for i, e in rows], k, rounds)
    assert sorted((-1 if r.id is None else r.id, r.cluster, r.distance) for r in got.collect()) == want
    assert [tuple(c) for c in centroids.tolist()] == [tuple(m) for m in means]


def test_only_expired_gaps_are_compared_again():
    """Apart clusters that hardly move leave most vectors on their heaps; large components are exact as well."""
    rng = np.random.default_rng(1)
    for size in (1, 1 << 20):
        means = rng.integers(-900, 900, (6, 8)) * size
        x = np.repeat(means, 50, 0) + rng.integers(-5, 6, (300, 8)) * size
        block, offsets = clustering.Block.fresh(x.astype("i4"), 6), np.zeros(6)
        change = block.assign(means, offsets)
        assert change[:, -1].tolist() == [50] * 6
        moved = means + size
        drift = np.sqrt(((moved - means) ** 2).sum(1))
        offsets = offsets + 2 * drift
        again = clustering.Block.read({"x": None, **block.written()} | {"x": block.written()["x"]}, 8, 6)
        assert len(again.expired(offsets)) == 0
        assert not block.assign(moved, offsets).any()
        assert block.distances(moved).tolist() == ((x - np.repeat(moved, 50, 0)) ** 2).sum(1).tolist()
        far = offsets + 1e9 * size  # every gap has expired
        block.assign(moved[::-1].copy(), far)
        assert block.cluster.tolist() == (5 - np.repeat(np.arange(6), 50)).tolist()
        assert sorted(i for h in block.heaps for _, i in h) == list(range(300))


# ---- whitening


@pytest.mark.parametrize("seed,n", [(9, 64), (11, 16), (14, 16), (22, 16), (24, 64)])
def test_leading_where_a_neighbour_is_nearer_to_the_middle(seed, n):
    """Spectra of which one eigenvalue lies at an end of its slice and the next one right outside of it."""
    rng = np.random.default_rng(seed)
    if seed % 2:
        v = np.cov(rng.standard_normal((n * 20, n)).T)
    else:
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        v = q @ np.diag(rng.random(n)) @ q.T
        v = (v + v.T) / 2
    got = whitening.leading(v)
    assert np.allclose([e for e, _ in got], np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-12, atol=0)
    assert all(np.abs(v @ x - e * x).max() < 1e-12 for e, x in got)


def test_inertia_counts_signs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 10, 40):
        a = rng.standard_normal((n, n))
        e = np.linalg.eigvalsh(a + a.T) if n else np.zeros(0)
        assert whitening.inertia(a + a.T) == ((e > 0).sum(), (e < 0).sum(), 0)
    assert whitening.inertia(np.array([[0.0, 1], [1, 0]])) == (1, 1, 0)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0, 3)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1], [2, 2 - 1e-13, 1, 1, 1], [1e-200, 1e-201], [7], [4, 1, 0, 0], [0, 0]])
def test_leading_of_known_spectra(values):
    """Close, equal and tiny eigenvalues are found in order, with unit vectors at right angles."""
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values), len(values))))
    v = (q * np.array(values)) @ q.T
    v = (v + v.T) / 2
    found = whitening.leading(v)
    want = [x for x in values if x > 1e-12 * max(values)][:4]
    scale = max(values)
    assert np.allclose([e / scale for e, _ in found], [x / scale for x in want], rtol=0, atol=1e-12) if want else not found
    for i, (e, x) in enumerate(found):
        assert np.linalg.norm(v @ x - e * x) <= 1e-12 * scale
        assert all(abs(x @ y - (i == j)) < 1e-12 for j, (_, y) in enumerate(found))


def plain_whitening(rows, dims):
    x = np.array([r + (0,) * (dims - len(r)) for r in rows], "f8").reshape(len(rows), dims)
    fit = np.array(sorted(set(map(tuple, x.astype(int).tolist()))))
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, dev, ((x - s / n) @ u) / np.sqrt(e), e / v.trace()


def test_whitening_equals_plain_algebra(spark, odd):
    rows = [(i, whole(e)) for i, e in vectors() if sound(e)]
    n, dev, white, explained = plain_whitening([v for _, v in rows], 64)
    got = QUERIES["op12_whitening"](spark, odd).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    want, mine = {}, {}
    for (i, _), d, w in zip(rows, dev, white, strict=True):
        for c in range(4):
            want.setdefault((i, c + 1), []).append((d, w[c]))
    for r in got:
        mine.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert want.keys() == mine.keys()
    for c in range(1, 5):  # either sign, the same for all rows
        pairs = [(a, b) for k in want if k[1] == c for a, b in zip(sorted(want[k]), sorted(mine[k]), strict=True) if len(want[k]) == 1]
        assert all(a[0] == b[0] for a, b in pairs)
        assert min(max(abs(a[1] - sign * b[1]) for a, b in pairs) for sign in (1, -1)) < 1e-8


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 1.0])], [(1, [0.5]), (2, [0.5, 0.0]), (3, [0.5])], [(1, []), (2, [])], [(1, None)]])
def test_no_variance_gives_no_rows(spark, rows):
    got, dims = whitening.rows_of(spark.createDataFrame(rows, VECTORS))
    machine, distinct = whitening.fit(got, dims)
    assert whitening.whiten(got, machine, whitening.identity_error(distinct, machine) if machine.n else 0.0).collect() == []


def test_few_directions_and_large_components(spark):
    """Fewer components than four where the rest has no variance; a deviation beyond a long is null."""
    wide = T.StructType([T.StructField("vec_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    rows = [(str(i), [1e30 * (-1) ** i, 3.0, i / 4]) for i in range(60)]
    df = spark.createDataFrame(rows, wide).select("*", *(F.lit("mine").alias(c) for c in CLASHING))
    got, dims = whitening.rows_of(df)
    machine, distinct = whitening.fit(got, dims)
    out = whitening.whiten(got, machine, whitening.identity_error(distinct, machine)).collect()
    assert {r.component for r in out} == {1, 2} and len(out) == 120 and {r.deviation for r in out} == {None}
    first = {r.vec_id: r.whitened for r in out if r.component == 1}
    assert all(abs(abs(w) - 1) < 1e-6 for w in first.values()) and first["0"] * first["1"] < 0


def test_repeats_leave_the_fit_list_as_it_is(spark):
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).standard_normal(3)]) for i in range(30)]
    once, many = (whitening.fit(*whitening.rows_of(spark.createDataFrame(r, VECTORS)))[0] for r in (rows, rows + rows[:1] * 500))
    assert once.n == many.n == 30 and once.sums == many.sums and np.allclose(once.values, many.values, rtol=1e-14)
