"""Python helpers over cells, streamed from sorted partitions.

A cell is one (key, slice): bounded by the slice, and often tiny. Rows are dealt by cell, as
many partitions as the data needs, and sorted; the helper then takes one cell after another off
the batches of a partition. What Python holds is one cell and one batch, whatever the data size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

OUT_ROWS = 10_000


def _schema(schema: str | T.StructType) -> tuple[str | T.StructType, list[str]]:
    if isinstance(schema, str):
        return schema, [part.split()[0] for part in schema.split(",")]
    return schema, schema.fieldNames()


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b, strict=True))


def sorted_cells(batches: Iterator[pd.DataFrame], cells: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(cell key, rows) of every cell of batches that are sorted by ``cells``; null keys are keys."""
    held: list[pd.DataFrame] = []
    held_key: tuple = ()
    for pdf in batches:
        if not len(pdf):
            continue
        starts = np.zeros(len(pdf), bool)
        starts[0] = True
        for c in cells:
            now, before = pdf[c], pdf[c].shift()
            starts |= ((now != before) & ~(now.isna() & before.isna())).to_numpy()
        at = np.flatnonzero(starts)
        for a, b in zip(at, [*at[1:], len(pdf)], strict=True):
            part = pdf.iloc[a:b]
            key = tuple(part[c].iloc[0] for c in cells)
            if held and not _same(key, held_key):
                yield held_key, pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            held_key = key
    if held:
        yield held_key, pd.concat(held, ignore_index=True)


def by_cell(
    df: DataFrame,
    cells: Sequence[str],
    fn: Callable[[tuple, pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
) -> DataFrame:
    """``fn(cell key, rows)`` for every cell."""
    cells = list(cells)
    schema, names = _schema(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, n = [], 0
        for key, rows in sorted_cells(batches, cells):
            got = fn(key, rows)
            if len(got):
                parts.append(got)
                n += len(got)
            if n >= OUT_ROWS:
                yield pd.concat(parts, ignore_index=True)[names]
                parts, n = [], 0
        if parts:
            yield pd.concat(parts, ignore_index=True)[names]

    return df.repartition(*cells).sortWithinPartitions(*cells).mapInPandas(run, schema)


def by_cell_with(
    df: DataFrame,
    other: DataFrame,
    cells: Sequence[str],
    fn: Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
) -> DataFrame:
    """``fn(cell key, rows, rows of other)`` for every cell of ``df``; Spark hands over one cell at a time."""
    cells = list(cells)
    schema, names = _schema(schema)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return fn(key, left, right)[names] if len(left) else pd.DataFrame(columns=names)

    return df.groupBy(*cells).cogroup(other.groupBy(*cells)).applyInPandas(run, schema)


def _starts(table: pa.Table, cells: Sequence[str]) -> np.ndarray:
    """Where a new cell begins; null keys are keys."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cells:
        col = table.column(c).combine_chunks()
        a, b = col.slice(1), col.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= differ | nulls
    return np.flatnonzero(new)


def by_cell_arrays(
    df: DataFrame,
    cells: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pa.Table, np.ndarray], dict[str, object]],
    schema: str | T.StructType,
) -> DataFrame:
    """``fn(rows, starts)`` for the whole cells of each batch at once, as Arrow columns; ``starts`` has their offsets.

    Rows are dealt by cell and sorted by ``order`` within. What is made gives the columns of ``schema``. Python holds one batch and,
    where a cell goes on beyond it, that cell; no frame is made per cell.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    cells = list(cells)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    made = to_arrow_schema(schema)

    def out(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        got = fn(table, starts)
        columns = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in made]
        yield pa.RecordBatch.from_arrays(columns, schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and not len(_starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]), cells)[1:]):
                held.append(batch)  # one cell that goes on
                continue
            table = pa.Table.from_batches([*held, batch])
            starts = _starts(table, cells)
            if len(starts) > 1:
                yield from out(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from out(table, np.zeros(1, int))

    return df.repartition(*cells).sortWithinPartitions(*cells, *order).mapInArrow(run, schema)


def column(table: pa.Table, name: str) -> np.ndarray:
    """A column as a numpy array."""
    return table.column(name).to_numpy()
