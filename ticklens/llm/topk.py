"""Exact top-k inner products by aggregation of sorted lists without random access.

Candidates and queries are dealt into blocks of bounded size, and every pair of blocks is one row of
work. Within a block each dimension is a list sorted by component. A query reads all lists in step, from the
large end where its own component is positive and from the small end where it is negative. What has been read
bounds the score of every candidate from below and above; a query stops when nobody outside its best ``k`` lower
bounds can reach them, and only then are the scores of those ``k`` resolved. The best of all blocks are merged.
The bounds of all queries of a block that are still reading are taken at once, as matrix products.

The query set is part of the task (ids divisible by ``every``), so the work is queries times candidates; blocks
are the unit of shuffle and memory. Vectors that are null or hold null or non-finite components take no part,
nor do rows without an id; shorter vectors count as padded with zeros. Rows with the query's own id are its own.
Repeated candidates are candidates each, repeated queries are answered each. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 256
DEPTHS = (1 / 32, 1 / 8, 1 / 3, 2 / 3, 1.0)  # shares of the lists read before bounds are compared


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v) with v = floor(256 x), of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.transform(F.col(embedding), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    sound = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(embedding, bad)
    return vectors.filter(sound).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def _blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """``n`` rows, each with a list of about as many vectors; rows are dealt in turn, whatever their ids."""
    dealt = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn(name, F.pmod("rid", F.lit(n)).cast("int"))
    return dealt.groupBy(name).agg(F.collect_list(F.struct("rid", "id", "v")).alias(f"{name}_rows"))


def read_lists(q, q_ids, v, ids, k):
    """For each query its best ``k`` of the block, as a list of (candidate index, score).

    ``q`` and ``v`` hold whole numbers as float64, small enough for exact sums; ``ids`` is sorted.
    """
    import numpy as np

    n = len(v)
    asc = np.argsort(v, axis=0, kind="stable")
    sorted_v = np.take_along_axis(v, asc, axis=0)
    place = np.empty_like(asc)
    np.put_along_axis(place, asc, np.broadcast_to(np.arange(n)[:, None], asc.shape), axis=0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    out: list[list[tuple[int, int]]] = [[] for _ in q]
    reading = np.arange(len(q))

    def best(scores: np.ndarray, some: np.ndarray) -> list[tuple[int, int]]:
        order = some[np.argsort(-scores[some], kind="stable")][:k]
        return [(int(j), int(scores[j])) for j in order]

    for share in DEPTHS:
        depth = max(1, math.ceil(n * share))
        own = q_ids[reading, None] == ids[None, :]
        if depth >= n or n <= k:
            scores = np.where(own, -np.inf, q[reading] @ v.T)
            for row, i in enumerate(reading):
                s = scores[row]
                least = np.partition(s, -k)[-k] if n > k else -np.inf
                out[i] = best(s, np.nonzero((s >= least) & (s > -np.inf))[0])
            break
        high, low = place >= n - depth, place < depth
        lower = up[reading] @ np.where(high, v, sorted_v[0]).T + down[reading] @ np.where(low, v, sorted_v[-1]).T
        upper = up[reading] @ np.where(high, v, sorted_v[n - depth]).T + down[reading] @ np.where(low, v, sorted_v[depth - 1]).T
        lower[own] = upper[own] = -np.inf
        least = np.partition(lower, -k, axis=1)[:, -k]
        able = upper >= least[:, None]
        done = (able.sum(axis=1) <= k) & (least > -np.inf)
        for row in np.nonzero(done)[0]:
            some = np.nonzero(able[row])[0]
            scores = np.full(n, -np.inf)
            scores[some] = v[some] @ q[reading[row]]
            out[reading[row]] = best(scores, some)
        reading = reading[~done]
        if not len(reading):
            break
    return out


def _packed(rows):
    """(row numbers, ids, matrix) of one list of vectors, by id."""
    import numpy as np

    at, ids, lists = rows.field("rid").to_numpy(), rows.field("id").to_numpy(), rows.field("v")
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    values = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    m = np.zeros((len(ids), int(sizes.max(initial=0))), "int64")
    m[np.arange(m.shape[1])[None, :] < sizes[:, None]] = values
    order = np.lexsort((at, ids))
    return at[order], ids[order], m[order]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block_rows: int = 4096,
    query_rows: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of every row that ``is_query`` (of ``id``) marks."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch.column("qb_rows")[i].values, batch.column("cb_rows")[i].values)

    def one(queries: pa.StructArray, candidates: pa.StructArray) -> pa.RecordBatch:
        q_at, q_ids, q = _packed(queries)
        _, ids, v = _packed(candidates)
        wide = max(q.shape[1], v.shape[1])
        q, v = (np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in (q, v))
        if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, wide) >= 2.0**53:
            raise ValueError("components too large for exact scores")
        found = read_lists(q.astype("float64"), q_ids, v.astype("float64"), ids, k)
        rows = [(q_at[i], q_ids[i], ids[j], s) for i, best in enumerate(found) for j, s in best]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["rid", "query_id", "vec_id", "score"])  # noqa: E501

    rows = quantised(vectors, vec_id, embedding)
    queries = rows.filter(is_query)
    n, m = rows.count(), queries.count()
    nc, nq = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / query_rows))
    tasks = min(nc * nq, 20_000)
    mine = _blocks(rows, nc, "cb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    theirs = _blocks(queries, nq, "qb").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    pairs = mine.repartition(tasks, "cb", "qb").join(theirs.repartition(tasks, "cb", "qb"), ["cb", "qb"])
    found = pairs.select("qb_rows", "cb_rows").mapInArrow(run, "rid long, query_id long, vec_id long, score long")
    order = W.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
