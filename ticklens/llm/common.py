"""What the operators of this subpackage share: word patterns, small expressions, the query registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.session import checkpoint_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SPACES = r"\x20\x09-\x0D"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order."""
    return F.array_remove(F.split(text, rf"[{SPACES}]+", -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns c0, c1, …, which no helper column can clash with; their names; and the way back."""
    names = docs.columns
    short = [f"c{i}" for i in range(len(names))]
    return docs.toDF(*short), dict(zip(names, short, strict=True)), lambda df: df.select(*short).toDF(*names)


ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, however long the texts: what a task holds outside the heap follows their size.

    A smaller setting of the session stays.
    """
    if int(spark.conf.get(ARROW_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(ARROW_BATCH, str(BATCH_BYTES))


#: How to drop what this process has put by for later tasks.
PUT_BY: list[Callable[[], object]] = []


def drop_put_by() -> None:
    """Gives back what tasks of another operator put by in this process: Python workers are used again and never shrink alone."""
    import gc

    if not PUT_BY:
        return
    while PUT_BY:
        PUT_BY.pop()()
    gc.collect()
    give_back()


def give_back() -> None:
    """Returns what this process has freed to the system: an idle Python worker counts beside the tasks that run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that ``new_folder`` named and that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
