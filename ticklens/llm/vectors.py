"""What the operators on embeddings share: sound vectors, whole-number components, matrices of Arrow lists."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

SCALE = 256
LIMIT = 1 << 26  # of a component, so that a squared distance of many dimensions is a long


def sound(embedding: Column) -> Column:
    """Whether a vector is there and each of its components is a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.coalesce(F.exists(embedding, bad), F.lit(False))


def whole(embedding: Column) -> Column:
    """floor(256 x) of each component; what lies beyond ``LIMIT`` counts as ``LIMIT``."""
    part = lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))
    held = lambda x: F.greatest(F.least(part(x), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    return F.transform(embedding, held)


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """The rows of an Arrow column of lists that all have ``dims`` entries."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def summed(parts: DataFrame, n: int) -> list[int]:
    """Exact place-by-place sums of the column ``sums`` (``n`` whole numbers a row); the driver gets ``n`` numbers."""
    rows = parts.select(F.posexplode("sums").alias("place", "value"))
    found = rows.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()
    by_place = {r.place: int(r.v) for r in found}
    return [by_place.get(i, 0) for i in range(n)]
