"""Centroid clustering in whole numbers with heap-ordered bounds.

Vectors lie in blocks of bounded size. A block keeps one heap per cluster; the key of a vector is the gap between a
lower bound of its distance to every other centroid and an upper bound of that to its own, both taken when the vector
was last compared with all centroids, plus what the cluster's offset was then. When centroids move, the offset of a
cluster grows by its own drift and by the greatest drift of any other, so a gap has expired once the offset reaches the
key. Only expired vectors are popped; they are compared with all centroids exactly, change their cluster if another is
nearer, and are pushed with a new key. A margin far above the rounding of bounds decides for the exact comparison, so
the result is that of plain rounds over all vectors.

A round is one pass over the blocks, written to the shared folder with the change of the sums; sums over the blocks
are taken by Spark, and the driver holds ``k`` centroids and offsets, whatever the number of vectors. The blocks of
the round before are removed after the next have been written.

Vectors that are null, hold null or non-finite components or have another number of components take no part;
components beyond ``vectors.LIMIT`` count as that. A null id is kept, but is no start. Repeated rows are
vectors each. With fewer than ``k`` vectors there are as many clusters; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.llm.common import new_folder, remove_folder, small_batches
from ticklens.llm.vectors import matrix, sound, summed, whole

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

BLOCK = 2048
MARGIN = 1e-3  # in units of a component; bounds are rounded by less than 1e-6
EXACT = 1 << 20  # components up to here multiply exactly as doubles

STATE = "ids array<bigint>, x binary, cluster binary, keys binary, heaps binary, moved array<bigint>"


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector and a column per centroid."""
    import numpy as np

    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, b = x.astype("f8"), centroids.astype("f8")
        return (np.add.outer((a * a).sum(1), (b * b).sum(1)) - 2 * (a @ b.T)).astype("i8")
    wide = x.astype("i8")
    return np.stack([((wide - c) ** 2).sum(1) for c in centroids], axis=1)


class Block:
    """The vectors of one block with their clusters, keys and heaps."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, keys: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.x, self.cluster, self.keys, self.heaps = x, cluster, keys, heaps

    @classmethod
    def fresh(cls, x: np.ndarray, k: int) -> Block:
        """No vector has a cluster, every gap has expired."""
        import numpy as np

        return cls(x, np.full(len(x), -1, "i4"), np.full(len(x), -np.inf), [[] for _ in range(k)])

    @classmethod
    def read(cls, row: dict, dims: int, k: int) -> Block:
        import numpy as np

        x = np.frombuffer(row["x"], "i4").reshape(-1, dims)
        if row["cluster"] is None:
            return cls.fresh(x, k)
        keys, at = np.frombuffer(row["keys"], "f8").copy(), np.frombuffer(row["heaps"], "i4")
        ends, members = at[:k].cumsum(), at[k:]  # sizes, then the members heap by heap in heap order
        heaps = [[(float(keys[i]), int(i)) for i in members[e - n : e]] for n, e in zip(at[:k], ends, strict=True)]
        return cls(x, np.frombuffer(row["cluster"], "i4").copy(), keys, heaps)

    def written(self) -> dict:
        import numpy as np

        sizes, members = [len(h) for h in self.heaps], [i for h in self.heaps for _, i in h]
        return {
            "x": self.x.tobytes(),
            "cluster": self.cluster.tobytes(),
            "keys": self.keys.tobytes(),
            "heaps": np.array(sizes + members, "i4").tobytes(),
        }

    def expired(self, offsets: np.ndarray) -> np.ndarray:
        """Takes the vectors whose gap is used up off their heaps."""
        import numpy as np

        out = np.flatnonzero(self.cluster < 0).tolist()
        for heap, offset in zip(self.heaps, offsets, strict=True):
            while heap and heap[0][0] <= offset + MARGIN:
                out.append(heappop(heap)[1])
        return np.array(out, "i8")

    def assign(self, centroids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Brings all clusters up to date; what that adds to each cluster's sums and count, cluster by cluster."""
        import numpy as np

        change = np.zeros((len(centroids), self.x.shape[1] + 1), "i8")
        again = self.expired(offsets)
        if len(again):
            far = squared(self.x[again], centroids)
            nearest = far.argmin(1)
            own = np.sqrt(far[np.arange(len(again)), nearest].astype("f8"))
            far = far.astype("f8")
            far[np.arange(len(again)), nearest] = np.inf
            self.keys[again] = np.sqrt(far.min(1)) - own + offsets[nearest]
            with_count = np.hstack([self.x[again].astype("i8"), np.ones((len(again), 1), "i8")])
            before = self.cluster[again]
            np.add.at(change, nearest, with_count)
            np.subtract.at(change, before[before >= 0], with_count[before >= 0])
            self.cluster[again] = nearest
            for i, c in zip(again.tolist(), nearest.tolist(), strict=True):
                heappush(self.heaps[c], (float(self.keys[i]), i))
        return change

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to its own centroid."""
        return ((self.x.astype("i8") - centroids[self.cluster]) ** 2).sum(1)


def blocks(kept: DataFrame, dims: int) -> DataFrame:
    """The vectors (id, v) in blocks of up to ``BLOCK`` that no round has seen; rows stay where they are."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(STATE)
    names = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                row = {"ids": part.column(0).to_pylist(), "x": matrix(part.column(1), dims).astype("i4").tobytes()}
                yield pa.RecordBatch.from_pylist([row], names)

    small_batches(kept.sparkSession)
    return kept.select("id", "v").mapInArrow(run, schema)


def _pass(state: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """One round over the blocks: new clusters, keys and heaps; a task's last block has its change of the sums."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    k, dims = centroids.shape
    names = to_arrow_schema(state.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if held is not None:
                    yield pa.RecordBatch.from_pylist([held], names)
                block = Block.read(row, dims, k)
                total = total + block.assign(centroids, offsets)
                held = {"ids": row["ids"]} | block.written()
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"moved": total.ravel().tolist()}], names)

    return state.drop("moved").mapInArrow(run, state.schema)


def _last(state: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector under the final centroids."""
    import pyarrow as pa

    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row, dims, k)
                block.assign(centroids, offsets)
                made = [pa.array(row["ids"], pa.int64()), pa.array(block.cluster), pa.array(block.distances(centroids))]
                yield pa.RecordBatch.from_arrays(made, ["id", "cluster", "distance"])

    return state.drop("moved").mapInArrow(run, "id bigint, cluster int, distance bigint")


def _stored(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def starts(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of seed and id, in that order; equal ids by vector."""
    import numpy as np

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.filter("id IS NOT NULL").withColumn("key", key).orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], "i8")


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    seed: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, squared distance) of every vector that takes part, and the final centroids."""
    import numpy as np

    e = F.col(embedding)
    kept = vectors.filter(sound(e) & (F.size(e) == dims)).select(F.col(vec_id).cast("long").alias("id"), whole(e).alias("v"))
    centroids = starts(kept, k, seed)
    spark: SparkSession = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint"), np.zeros((0, dims), "i8")
    k = len(centroids)
    offsets, sums = np.zeros(k), np.zeros((k, dims + 1), object)
    state, folder = _stored(blocks(kept, dims), "clusters")
    for _ in range(rounds):
        before = folder
        state, folder = _stored(_pass(state, centroids, offsets), "clusters")
        remove_folder(spark, before)
        sums = sums + np.array(summed(state.select(F.col("moved").alias("sums")), sums.size), object).reshape(sums.shape)
        moved = centroids.copy()
        for c in np.flatnonzero(sums[:, dims]):
            moved[c] = [s // sums[c, dims] for s in sums[c, :dims]]
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype("f8"))
        top = np.sort(drift)[::-1]
        others = np.where((drift == top[0]) & (np.arange(k) == drift.argmax()), top[1] if k > 1 else 0.0, top[0])
        centroids, offsets = moved, offsets + drift + others
    rows, _ = _stored(_last(state, centroids, offsets), "clusters")
    remove_folder(spark, folder)
    return rows, centroids


def digest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` of ``cluster`` with the sums of distances and the hash of the own centroid."""
    spark = rows.sparkSession
    hashes = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    per = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per cluster
    sums = spark.createDataFrame([(c, s, sum(per.values())) for c, s in per.items()], "cluster int, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(named.join(sums, "cluster")), "cluster")  # at most k rows
