"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 … 1. The integral of the schedule is the
source's weight; weights share out all tokens, but no source is asked for more than ``MAX_EPOCHS``
times what it has, and what it cannot give goes to the others by weight. Demand for a source up to
time ``t`` is its target times the integral up to ``t``; a document that starts at token ``a`` of its
source's stream is due when demand reaches ``a``, so inverting the demand gives its training position.
The result is range-sorted by the first position.

A source may hold any share of the rows. Its stream order is the order of a hash, cut into buckets
whose number follows the square root of the row count: sums per (source, bucket) are scanned, and
windows inside a bucket add the rest. No task holds a whole source.

A null text has size 0, takes no words and has no position; a null source is a source of its own,
last in order. Repeated rows are documents of their own. Reruns give the same rows: the stream order
depends on id and text only, and rows that tie in both are equal. Names starting with ``__`` and those of
the result (``size``, ``source_size``, ``target``, ``taken``, ``positions``, ``position``) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklens.llm.common import text_of, words_of
from ticklens.session import cut_lineage

MAX_EPOCHS = 3

Knots = tuple[tuple[float, float], ...]

#: Weight over training time of the first, second and third source, and so on in turn: from 3 to 7 (5 in
#: all), a steady 2, and from 1.5 down to 0.5 (1 in all).
SCHEDULES: tuple[Knots, ...] = (((0.0, 3.0), (1.0, 7.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 0.5)))


def integral(knots: Knots) -> float:
    return math.fsum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def inverted(knots: Knots, share: Column) -> Column:
    """The time at which ``share`` (0 … 1) of the schedule's integral is reached.

    On a piece with weights w0 … w1 the integral is quadratic in time; of its two roots the one in the
    piece is written without a difference of near-equal values.
    """
    goal, done, at = share * integral(knots), 0.0, F.lit(None).cast("double")
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        slope, rest = (w1 - w0) / (t1 - t0), goal - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        below = F.lit(w0) + root
        pieces.append((done, F.lit(t0) + F.when(below > 0, F.lit(2.0) * rest / below).otherwise(F.lit(0.0))))
        done += (t1 - t0) * (w0 + w1) / 2
    for start, time in pieces:
        at = F.when(goal >= start, time).otherwise(at)
    return F.least(at, F.lit(knots[-1][0]))


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size`` in words and the hash that sets the order within a source."""
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), text_of(text)).cast("binary"))
    return docs.withColumns({"size": F.size(words_of(text_of(text))).cast("long"), "__key": key})


def targets(sums: DataFrame, schedules: tuple[Knots, ...]) -> DataFrame:
    """One row per source: its size, weight, schedule number and target.

    Sources in order of the ratio at which they run dry; the dry ones are the first so many, and what
    they leave is shared by the weight of the rest. The windows hold one row per source.
    """
    weights = F.array(*(F.lit(integral(k)) for k in schedules))
    by_name = W.orderBy("__s")
    by_ratio = W.orderBy("__ratio", "__s")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = (F.col("source_size") * MAX_EPOCHS).cast("double")
    ranked = (
        sums.withColumn("__turn", ((F.row_number().over(by_name) - 1) % len(schedules)).cast("int"))
        .withColumn("__w", weights[F.col("__turn")])
        .withColumn("__cap", cap)
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
    )
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum(
        "__w"
    ).over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    found = ranked.withColumn("__level", level)
    shared = F.min(F.when(F.col("__ratio") > F.col("__level"), F.struct("__ratio", "__s", "__level"))).over(everyone)
    return found.withColumn("__shared", shared["__level"]).select(
        "__s",
        "__turn",
        "source_size",
        F.when(F.col("__ratio") > F.col("__level"), F.col("__shared") * F.col("__w"))
        .otherwise(F.col("__cap"))
        .alias("target"),
    )


def placed(docs: DataFrame, source: str = "source", schedules: tuple[Knots, ...] = SCHEDULES) -> DataFrame:
    """The rows of ``sized`` with ``source_size``, ``target``, ``taken`` and ``positions``, in no order.

    ``taken`` counts the words that the mix takes, repeats included; ``positions`` has the training time
    of each copy.
    """
    bits = max(0, math.ceil(math.log2(max(1, docs.count())) / 2))
    whose = F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))
    head = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    rows = docs.withColumns({"__s": whose, "__bucket": F.shiftright(head, 32 - bits)})
    parts = cut_lineage(rows.groupBy("__s", "__bucket").agg(F.sum("size").alias("__sum")))
    goal = targets(parts.groupBy("__s").agg(F.sum("__sum").alias("source_size")), schedules)
    up_to = W.partitionBy("__s").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("__start", F.coalesce(F.sum("__sum").over(up_to), F.lit(0))).drop("__sum")
    plan = starts.join(goal, "__s")

    inside = W.partitionBy("__s", "__bucket").orderBy("__key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.drop("source_size", "target", "taken", "positions", "position").join(plan, ["__s", "__bucket"])
    rows = rows.withColumn("__at", F.col("__start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    want = F.floor(F.col("target") + 0.5)
    taken_in = lambda e: F.greatest(F.least(want - (e * F.col("source_size") + F.col("__at")), F.col("size")), F.lit(0))
    copies = [taken_in(F.lit(e)) for e in range(MAX_EPOCHS)]
    due = F.lit(None).cast("double")
    positions = []
    for e in range(MAX_EPOCHS):
        share = (F.lit(e) * F.col("source_size") + F.col("__at")).cast("double") / F.nullif(want, F.lit(0))
        for turn, knots in enumerate(schedules):
            due = F.when(F.col("__turn") == turn, inverted(knots, share)).otherwise(due)
        positions.append(F.when(copies[e] > 0, due))
    rows = rows.withColumns(
        {
            "taken": sum(copies[1:], copies[0]).cast("long"),
            "positions": F.filter(F.array(*positions), lambda x: x.isNotNull()),
        }
    )
    return rows.drop("__s", "__bucket", "__start", "__turn", "__at")


def mix(docs: DataFrame, source: str = "source", schedules: tuple[Knots, ...] = SCHEDULES) -> DataFrame:
    """One row per row of ``sized``, range-sorted by its first ``position``; rows that are not taken come last."""
    rows = placed(docs, source, schedules).withColumn("position", F.get("positions", F.lit(0)))
    return rows.orderBy(F.col("position").asc_nulls_last(), "__key").drop("__key")


def copies(docs: DataFrame, source: str = "source", schedules: tuple[Knots, ...] = SCHEDULES) -> DataFrame:
    """One row per copy that the mix takes, range-sorted by its ``position``.

    A copy that is taken in part is a row if at least half of it is taken; a row without words gives none.
    """
    size = F.nullif(F.col("size"), F.lit(0))
    n = F.coalesce(F.floor((F.col("taken") + F.floor(F.col("size") / 2)) / size), F.lit(0)).cast("int")
    rows = placed(docs, source, schedules)
    names = [c for c in rows.columns if c not in ("positions", "position")]
    return rows.select(*names, F.explode(F.slice("positions", 1, n)).alias("position")).orderBy("position", "__key").drop("__key")
