"""Sharding by a minimax contiguous partition of whole groups.

Texts that are equal form a group, which no cut divides; groups are ordered by the MD5 of their text. A shard's load is
the sum of its documents' bytes. The smallest feasible capacity is found by halving, each try checked greedily: a shard
takes groups in order until the next does not fit. Under that capacity the order is cut where a shard is nearest
to an even part of what is left, never earlier than the shards after it can bear.

No task sees all groups. The search runs over *elements*, runs of groups with a common beginning of the MD5, of which
only sum and greatest group are known. Taken as wholes they give a capacity that is surely feasible; taken as fluid but
for their greatest group, one that is surely needed. Only elements which a cut can reach under some capacity in between
are split further, by one more digit or into their groups, until both agree. How many elements a round has depends on
the number of shards, not on the number of groups, since the groups of an element are spread by their hash.

A group larger than an even share of all gets a shard of its own (the first ones), and the rest is cut into the shards
that are left; so one text with a third of all rows leaves the others even. With fewer groups than shards the last
shards stay empty. Slots follow a hash of id and text within a shard, counted in buckets, so that no task holds a shard.

A null text has no bytes and goes with the empty ones. Null ids and repeated rows are documents of their own.
Columns named as those of the result (``size``, ``text_crc32``, ``shard``, ``slot``) or starting with ``__`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklens.llm.common import let, text_of
from ticklens.session import cut_lineage

SHARDS = 24
EXTRA_BYTES = 8  # of each document
DIGITS = 3  # of the MD5 that the first elements share
AT_ONCE = 50_000  # groups that are taken out of their elements in one step
SMALL = 100_000  # elements of the search that may be broadcast
NEVER = 1 << 40  # shards of a capacity that is not feasible

LONG = "long"


def _long(x: int) -> Column:
    return F.lit(x).cast(LONG)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def loads(elements: Column, capacity: Column) -> Column:
    """The greedy check with elements as wholes: number of shards."""

    def put(acc: Column, e: Column) -> Column:
        fits = acc["load"] + e["size"] <= capacity
        # What is larger than the capacity as a whole fits no number of shards.
        n = F.when(fits, acc["n"]).when(e["size"] > capacity, _long(NEVER)).otherwise(acc["n"] + 1)
        return F.struct(n.alias("n"), F.when(fits, acc["load"] + e["size"]).otherwise(e["size"]).alias("load"))

    return F.aggregate(elements, F.struct(_long(1).alias("n"), _long(0).alias("load")), put, lambda acc: acc["n"])


def _reach(e: Column, room: Column) -> Column:
    """The farthest that a cut can lie inside an element which does not fit ``room``: its greatest group is whole."""
    return F.when(room >= e["big"], room).otherwise(F.least(room, e["size"] - e["big"]))


def fluid_loads(elements: Column, capacity: Column) -> Column:
    """The greedy check with elements that can be cut anywhere but in their greatest group: number of shards, a lower bound."""

    def put(acc: Column, e: Column) -> Column:
        room = capacity - acc["load"]
        rest = e["size"] - _reach(e, room)
        more = _div(rest + capacity - 1, capacity)
        over = F.struct((acc["n"] + more).alias("n"), (rest - (more - 1) * capacity).alias("load"))
        return F.when(e["size"] <= room, F.struct(acc["n"].alias("n"), (acc["load"] + e["size"]).alias("load"))).otherwise(over)

    return F.aggregate(elements, F.struct(_long(1).alias("n"), _long(0).alias("load")), put, lambda acc: acc["n"])


def smallest(elements: Column, low: int, high: int, shards: int, check: Callable[[Column, Column], Column]) -> Column:
    """The smallest capacity from ``low`` to ``high``, the last being feasible, for which ``check`` needs at most ``shards``."""

    def halve(acc: Column, _: Column) -> Column:
        def narrowed(middle: Column) -> Column:
            return let(
                check(elements, middle) <= shards,
                lambda ok: F.struct(
                    F.when(ok, acc["low"]).otherwise(middle + 1).alias("low"),
                    F.when(ok, middle).otherwise(acc["high"]).alias("high"),
                ),
            )

        return F.when(acc["low"] >= acc["high"], acc).otherwise(let(acc["low"] + _div(acc["high"] - acc["low"], _long(2)), narrowed))

    start = F.struct(_long(low).alias("low"), _long(high).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit((high - low).bit_length() + 1)), start, halve, lambda acc: acc["high"])


def _cuts(elements: Column, capacity: Column, fluid: bool) -> Column:
    """Where the greedy check ends its shards, in bytes from the start: the earliest or (fluid) the latest that can be."""

    def put(acc: Column, e: Column) -> Column:
        room = acc["start"] + capacity - acc["pos"]
        at = acc["pos"] + (_reach(e, room) if fluid else _long(0))
        # A rest larger than the capacity ends further shards inside the element.
        rest = acc["pos"] + e["size"] - at
        more = _div(rest - 1, capacity) if fluid else _long(0)
        ends = F.transform(F.sequence(_long(0), more), lambda i: at + i * capacity)
        over = F.struct(
            (at + more * capacity).alias("start"), (acc["pos"] + e["size"]).alias("pos"), F.concat(acc["cuts"], ends).alias("cuts")
        )
        same = F.struct(acc["start"].alias("start"), (acc["pos"] + e["size"]).alias("pos"), acc["cuts"].alias("cuts"))
        return F.when(e["size"] <= room, same).otherwise(over)

    none = F.array().cast("array<bigint>")
    start = F.struct(_long(0).alias("start"), _long(0).alias("pos"), none.alias("cuts"))
    return F.aggregate(elements, start, put, lambda acc: acc["cuts"])


def _even(elements: Column, capacity: int, shards: int, total: int) -> Column:
    """The first keys of the second and later shards, as even as the capacity lets them be."""
    back = _cuts(F.reverse(elements), _long(capacity), fluid=False)  # from the end: what the last shards can bear at most

    def put(acc: Column, e: Column, ends: Column) -> Column:
        left = F.lit(shards) - acc["k"]  # shards after this one
        bear = F.when(left > F.size(ends), _long(total)).otherwise(F.get(ends, left.cast("int") - 1))
        load = acc["pos"] - acc["start"]
        over = load + e["size"] > capacity
        nearer = (_long(total) - acc["start"]) * 2 <= (load * 2 + e["size"]) * (left + 1)
        close = (left > 0) & (load > 0) & (over | (nearer & (acc["pos"] >= _long(total) - bear)))
        end = acc["pos"] + e["size"]
        shut = F.struct(
            (acc["k"] + 1).alias("k"), acc["pos"].alias("start"), end.alias("pos"), F.concat(acc["keys"], F.array(e["first"])).alias("keys")
        )
        kept = F.struct(acc["k"].alias("k"), acc["start"].alias("start"), end.alias("pos"), acc["keys"].alias("keys"))
        return F.when(close, shut).otherwise(kept)

    none = F.array().cast("array<string>")
    start = F.struct(_long(1).alias("k"), _long(0).alias("start"), _long(0).alias("pos"), none.alias("keys"))
    return let(back, lambda ends: F.aggregate(elements, start, lambda acc, e: put(acc, e, ends), lambda acc: acc["keys"]))


def _elements(groups: DataFrame, digits: int) -> DataFrame:
    """Runs of groups whose keys begin with the same digits."""
    sums = F.min("key").alias("first"), F.sum("size").alias("size"), F.max("size").alias("big"), F.count("*").alias("n")
    return groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(*sums)


def minimax(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity for ``groups`` (key, size), and the first keys of the second and later shards."""
    elements, digits = cut_lineage(_elements(groups, DIGITS)), DIGITS
    total, big, widest = elements.agg(F.sum("size"), F.max("big"), F.max("size")).first()
    if not total:
        return 0, []
    low = max(-(-total // shards), big)
    high = low + widest
    ordered = F.array_sort(F.collect_list(F.struct("first", "size", "big"))).alias("e")
    while True:
        one = elements.agg(ordered)
        checks = (smallest(F.col("e"), low, high, shards, check) for check in (fluid_loads, loads))
        low, high = one.select(*checks).first()
        early, late = one.select(_cuts(F.col("e"), _long(low), False), _cuts(F.col("e"), _long(high), True)).first()
        up_to = F.sum("size").over(W.orderBy("first"))  # of the elements of the search, a bounded number
        before = lambda cuts, at: sum((F.when(at(F.lit(c)), 1).otherwise(0) for c in cuts[: shards - 1]), F.lit(0))
        reached = before(early, lambda c: c < F.col("end")) > before(late, lambda c: c <= F.col("end") - F.col("size"))
        marked = elements.withColumn("end", up_to).withColumn("split", (reached | (F.col("size") > low)) & (F.col("n") > 1))
        marked = cut_lineage(marked.drop("end"))
        inside, n = marked.filter("split").agg(F.sum("n"), F.count("*")).first()
        if not inside:
            break
        prefixes = marked.filter("split").select(F.col("prefix").alias("p"))
        prefixes = F.broadcast(prefixes) if n <= SMALL else prefixes
        finer = groups.join(prefixes, F.substring("key", 1, digits) == F.col("p"), "left_semi")
        digits = 32 if inside <= AT_ONCE else digits + 1
        rest = marked.filter("NOT split").select("prefix", "first", "size", F.col("size").alias("big"), F.lit(1).cast(LONG).alias("n"))
        elements = cut_lineage(rest.unionByName(_elements(finer, digits)))
    return high, elements.agg(ordered).select(_even(F.col("e"), high, shards, total)).first()[0]


def alone(groups: DataFrame, shards: int) -> list[str]:
    """Keys of the groups, greatest first, that are larger than an even share of what the greater ones leave."""
    greatest = groups.orderBy(F.desc("size"), "key").limit(shards).collect()
    left, out = groups.agg(F.sum("size")).first()[0] or 0, []
    for r in greatest:
        if len(out) == shards - 1 or r["size"] * (shards - len(out)) <= left:
            break
        out.append(r["key"])
        left -= r["size"]
    return out


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, the group's key and the hash that orders a shard."""
    t = text_of(text)
    docs = docs.withColumns(
        {"size": (F.octet_length(t) + EXTRA_BYTES).cast(LONG), "text_crc32": F.crc32(t.cast("binary")), "__key": F.md5(t.cast("binary"))}
    )
    own = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), "__key")
    return docs.withColumn("__order", F.md5(own.cast("binary")))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``sized`` with ``shard`` and ``slot``."""
    groups = cut_lineage(docs.groupBy(F.col("__key").alias("key")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    own = alone(groups, shards)
    rest = groups.filter(~F.col("key").isin(own)) if own else groups
    _, cuts = minimax(rest.select("key", "size"), shards - len(own))
    key = F.col("__key")
    shard = F.lit(len(own)) + sum((F.when(key >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i, k in enumerate(own):
        shard = F.when(key == k, i).otherwise(shard)
    n = groups.agg(F.sum("rows")).first()[0] or 1
    bits = max(0, math.ceil(math.log2(n) / 2))
    head = F.conv(F.substring("__order", 1, 8), 16, 10).cast(LONG)
    rows = docs.drop("shard", "slot").withColumns({"shard": shard.cast("int"), "__bucket": F.shiftright(head, 32 - bits)})
    up_to = W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    starts = starts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(up_to), _long(0)).alias("__start"))
    inside = W.partitionBy("shard", "__bucket").orderBy("__order")
    placed = rows.join(starts, ["shard", "__bucket"]).withColumn("slot", F.col("__start") + F.row_number().over(inside) - 1)
    return placed.drop("__bucket", "__start", "__order", "__key")
