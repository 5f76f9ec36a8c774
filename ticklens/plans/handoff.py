"""Sequential rules over time, run in parallel slices and repaired until exact.

Some rules are sequential by nature (a global cap on what was accepted so far).
Each time slice first runs with an entry state guessed from a warm-up over the
rows before it. A slice whose guess differs from what the slice before it really
ends with is run again with that state, until every entry equals the exit before
it; by induction from the first slice the outcome is then the sequential one.
States are small JSON texts (what is still inside a cooldown or a cap window).

What a rule remembers for ever per key (the last status sent) is no part of the state,
which would grow with the keys and which no warm-up could guess. It is a ``Memory``: a table of
one value per key and slice, carried over the slices by a window per key, guessed from
the rows first and then taken from the results. Only slices with a wrong state or a
wrong memory run again; the results of the others stay where they are.

A slice ends at a multiple of the slice length or, before that, where it has its number of rows, but for what one
bucket of a second has. Warm-up rows come from at most ``WARM_SLICES`` slices before; a guess from less is repaired.
Spark sorts the rows of a slice and its warm-up, and they stream through the rule batch by batch, so Python holds
one batch and what the rule keeps, however many rows a slice has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import gcd
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.plans.slices import SLICE, Run, running, slice_of
from ticklens.session import cut_lineage, stored


class Rule(Protocol):
    """A sequential rule on its way through the rows of a slice."""

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The output of the next rows in order."""

    def state(self, end_ms: int) -> str:
        """What matters from ``end_ms`` on, written canonically; '' if nothing does."""


Fold = Callable[[str], Rule]


@dataclass(frozen=True)
class Memory:
    """The last non-null value per ``key``: ``guess`` of a row, ``value`` of an output row, both in ``order``."""

    key: str
    guess: Column
    value: Column
    order: tuple[str, ...]


WAS = "_was"
SLICE_ROWS = 200_000
WARM_SLICES = 4
_KEY = "_key"  # a struct, so that null keys meet each other


def row_slices(rows: DataFrame, slice_ms: int, slice_rows: int, warm_ms: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their slice and the last slice that they warm up; and the slices with ``_start`` and ``_end``.

    Counts per bucket decide; a bucket is a second or less. Slices are numbered from 0 in time.
    """
    grain = gcd(slice_ms, 1_000)
    bucket = slice_of(F.col("ts"), grain)
    per = cut_lineage(rows.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
    long = slice_of(F.col("_b") * grain, slice_ms)
    cell = slice_of(F.col("_b"), 1_024)
    per = running(per.withColumn("_long", long), ["_long"], cell, ["_b"], [Run("_to", "sum", F.col("_n"), inclusive=False)])
    per = per.withColumn("_part", F.struct("_long", F.floor(F.col("_to") / slice_rows).alias("_sub")))
    per = running(per, [], cell, ["_b"], [Run("_was", "last", F.col("_part"), inclusive=False)])
    new = F.when(F.col("_was").eqNullSafe(F.col("_part")), 0).otherwise(1)
    per = running(per.withColumn("_new", new), [], cell, ["_b"], [Run("_k", "sum", F.col("_new"))])
    per = per.select("_b", (F.col("_k") - 1).alias(SLICE))
    asks = per.select("_b", SLICE, (F.col("_b") + -(-warm_ms // grain)).alias("_p"), F.lit(1).alias("_kind"))
    marks = per.select(F.col("_b").alias("_p"), F.col(SLICE).alias("_mark"), F.lit(0).alias("_kind"))
    both = asks.unionByName(marks, allowMissingColumns=True)
    both = running(both, [], slice_of(F.col("_p"), 1_024), ["_p", "_kind"], [Run("_upto", "last", F.col("_mark"))])
    upto = F.least(F.col("_upto"), F.col(SLICE) + WARM_SLICES)
    per = cut_lineage(both.filter("_kind = 1").select("_b", SLICE, upto.alias("_upto")))
    cuts = per.groupBy(SLICE).agg((F.min("_b") * grain).alias("_start"), ((F.max("_b") + 1) * grain).alias("_last"))
    end = F.coalesce(F.lead("_start").over(Window.orderBy(SLICE)), F.col("_last"))  # one row per slice
    cuts = cut_lineage(cuts.select(SLICE, "_start", end.alias("_end")))
    return rows.withColumn("_b", bucket).join(per, "_b").drop("_b"), cuts


def _last_per_slice(rows: DataFrame, m: Memory, value: Column) -> DataFrame:
    place = F.when(value.isNotNull(), F.struct(*m.order))
    return rows.groupBy(SLICE, F.struct(m.key).alias(_KEY)).agg(F.max_by(value, place).alias("value"))


def _carried(values: DataFrame) -> DataFrame:
    """(slice, key, was, value): the value that each key brings into each of its slices, and what it has there."""
    w = Window.partitionBy(_KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return values.select(SLICE, _KEY, F.last("value", ignorenulls=True).over(w).alias(WAS), "value")


class _Pass:
    """One slice on its way: warm-up rows first where its entry is unknown, then its own rows."""

    def __init__(self, fold: Fold, sl: int, start_ms: int, end_ms: int, state: str | None) -> None:
        self.fold, self.sl, self.start_ms, self.end_ms, self.entry = fold, sl, start_ms, end_ms, state
        self.warm: Rule | None = None
        self.rule: Rule | None = None

    def before(self, rows: pd.DataFrame) -> None:
        self.warm = self.warm or self.fold("")
        self.warm.step(rows)

    def own(self, rows: pd.DataFrame) -> pd.DataFrame:
        if self.rule is None:
            if self.entry is None:
                self.entry = self.warm.state(self.start_ms) if self.warm else ""
            self.rule = self.fold(self.entry)
        return self.rule.step(rows)

    def exit(self) -> str:
        return self.rule.state(self.end_ms) if self.rule else self.entry or ""


def _streamed(rows: DataFrame, heads: DataFrame, fold: Fold, out: T.StructType, order: Sequence[str], remembers: bool) -> DataFrame:
    """Every slice of ``rows`` through the rule. Behind its output, each has one row with its states.

    ``heads``: slice, _start, _end and the entry state, null where the warm-up rows (of another ``_home``) give it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    extra = [T.StructField(SLICE, T.LongType()), T.StructField("state_in", T.StringType()), T.StructField("state_out", T.StringType())]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in out.fields), *extra])
    made, names = to_arrow_schema(schema), out.fieldNames()
    columns = rows.columns

    def batch_of(got: pd.DataFrame, sl: int, state_in: str | None = None, state_out: str | None = None) -> pa.RecordBatch:
        n = len(got)
        said = {SLICE: [sl] * n, "state_in": [state_in] * n, "state_out": [state_out] * n}
        arrays = [pa.array(said[f.name] if f.name in said else got[f.name], f.type, from_pandas=True) for f in made]
        return pa.RecordBatch.from_arrays(arrays, schema=made)

    def last_row(held: _Pass) -> pa.RecordBatch:
        state = held.exit()
        return batch_of(pd.DataFrame([{c: None for c in names}]), held.sl, held.entry, state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Pass | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sl, at, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in (SLICE, "_at", "_home"))
            own = home == sl
            new = (np.diff(sl) != 0) | (np.diff(own) != 0) | (at[1:] == 0) | (at[:-1] == 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if at[a] == 0:
                    if held:
                        yield last_row(held)
                    start, end, state = (batch.column(c)[a].as_py() for c in ("_start", "_end", "state"))
                    held = _Pass(fold, int(sl[a]), start, end, state)
                    continue
                part = batch.slice(a, b - a).select(columns).to_pandas()
                if own[a]:
                    got = held.own(part)
                    if len(got):
                        yield batch_of(got, held.sl)
                else:
                    held.before(part.assign(**{WAS: None}) if remembers else part)
        if held:
            yield last_row(held)

    both = rows.withColumn("_at", F.lit(1)).unionByName(heads.withColumns({"_at": F.lit(0), "_home": F.col(SLICE)}), allowMissingColumns=True)
    both = both.repartition(SLICE).sortWithinPartitions(SLICE, "_at", *(F.asc_nulls_last(c) for c in order))
    return both.mapInArrow(run, schema)


def handoff_fold(
    rows: DataFrame,
    slice_ms: int,
    warm_ms: int,
    fold: Fold,
    out: T.StructType,
    memory: Memory | None = None,
    slice_rows: int = SLICE_ROWS,
    order: Sequence[str] = ("ts", "symbol", "event"),
) -> DataFrame:
    """What the rule ``fold(state in)`` puts out for ``rows`` in ``order``, which starts with ``ts``.

    With a ``memory``, rows have one more column ``_was``: what their key brings into the slice.
    """
    names, remembers = out.fieldNames(), memory is not None
    own, cuts = row_slices(rows, slice_ms, slice_rows, warm_ms)
    own = cut_lineage(own)  # read by every pass
    warm = own.withColumn("_home", F.col(SLICE)).withColumn(SLICE, F.explode(F.sequence(SLICE, "_upto"))).drop("_upto")
    own = own.drop("_upto").withColumn("_home", F.col(SLICE))
    keyed = lambda df: df.withColumn(_KEY, F.struct(memory.key))
    with_was = lambda df, was: keyed(df).join(was.select(SLICE, _KEY, WAS), [SLICE, _KEY], "left").drop(_KEY)
    now = None
    if memory:
        seen = cut_lineage(_last_per_slice(own, memory, memory.guess))
        now = _carried(seen)
        warm = with_was(warm, now)
    heads = cuts.withColumn("state", F.lit(None).cast("string"))
    told = F.col("state_out").isNotNull()  # the last row of a slice
    got = stored(_streamed(warm, heads, fold, out, ["ts", *(c for c in order if c != "ts")], remembers))
    rounds, kept, found = [got], None, None  # the states and memories of the slices that stay as they are
    by_slice = Window.orderBy(SLICE)  # one row per slice
    while True:
        states = got.filter(told).select(SLICE, "state_in", "state_out", F.lit(len(rounds) - 1).alias("_round"))
        states = states if kept is None else kept.unionByName(states)
        states = states.withColumn("state", F.coalesce(F.lag("state_out").over(by_slice), F.lit("")))
        differs = F.col("state") != F.col("state_in")
        if memory:
            last = _last_per_slice(got.filter(~told), memory, memory.value)
            found = last if found is None else found.unionByName(last)
            new = stored(_carried(seen.select(SLICE, _KEY).join(found, [SLICE, _KEY], "left")))
            moved = new.join(now.select(SLICE, _KEY, F.col(WAS).alias("_old")), [SLICE, _KEY])
            moved = moved.filter(~F.col(WAS).eqNullSafe(F.col("_old"))).select(SLICE, F.lit(True).alias("moved")).distinct()
            states = states.join(moved, SLICE, "left")
            differs = differs | F.col("moved").isNotNull()
            now = new
        states = stored(states.select(SLICE, "state_in", "state_out", "_round", "state", differs.alias("_wrong")))
        wrong = states.filter("_wrong").select(SLICE, "state")
        if wrong.isEmpty():
            break
        kept = states.filter("NOT _wrong").select(SLICE, "state_in", "state_out", "_round")
        again = own.join(wrong.select(SLICE), SLICE, "left_semi")
        if memory:
            again = with_was(again, now)
            found = now.join(wrong.select(SLICE), SLICE, "left_anti").select(SLICE, _KEY, "value")
        got = stored(_streamed(again, cuts.join(wrong, SLICE), fold, out, ["ts", *(c for c in order if c != "ts")], remembers))
        rounds.append(got)
    done = reduce(DataFrame.unionByName, [r.filter(~told).withColumn("_round", F.lit(i)) for i, r in enumerate(rounds)])
    return done.join(states.select(SLICE, "_round"), [SLICE, "_round"], "left_semi").select(*names)
