"""SimHash near-duplicates by multi-index hashing.

Fingerprints come from whole texts, in Arrow batches. Exact copies collapse to one fingerprint
first. A fingerprint is cut into segments; two that differ in few bits differ in very few of some
segment, so each enumerates a small Hamming ball per segment, fetches the table entries with that
segment value, and the complete distance is verified. Linked fingerprints form components.

A segment value that more than ``max_bucket`` different fingerprints share would make the
fetch quadratic. Such fingerprints, and all that would have fetched them, are linked exactly in
another way: two differ in at most two bits just if their balls of radius one share a member, so
each is sent to the 65 members of its ball, and all that meet in one form a star. No link is lost
either way, and no group of pairs is emitted.

Null and blank texts have fingerprint zero and are linked like any other; fewer words than a
shingle give one shingle. Repeated rows are documents of their own; rows with a null id take part and
never name a component unless nobody else can. Other columns are not read unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.llm.common import set_aside, small_batches, text_of
from ticklens.llm.graph import components
from ticklens.session import cut_lineage

BITS = 64
SHINGLE = 3
SEED = 42


def fingerprint(text: bytes) -> int:
    """64-bit majority vote over the hashes of the text's word shingles, as an unsigned number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and white space only
    n = len(words)
    if n == 0:
        return 0
    flat = b" ".join(words)
    if n <= SHINGLE:
        return xxh64_intdigest(flat, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    hashes = np.fromiter(
        (xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)), ">u8", n - SHINGLE + 1
    )
    ones = np.zeros(BITS, "int64")
    for part in range(0, len(hashes), 65_536):
        some = hashes[part : part + 65_536]
        ones += np.unpackbits(some.view("uint8").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns and ``fp``, the fingerprint as a signed long."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.columns[-1].cast(pa.binary())
            prints = [fingerprint(texts[i].as_py()) for i in range(len(texts))]
            signed = pa.array([p - (1 << BITS) if p >> (BITS - 1) else p for p in prints], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], signed], [*carry, "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(*carry, text_of(text).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def _segments(distance: int, m: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, masks) of each segment.

    ``distance`` bits spread over ``m`` segments leave one of the first ``distance % m + 1`` with at
    most ``distance // m`` of them, or one of the others with fewer still.
    """
    width, out = BITS // m, []
    for k in range(m):
        radius = distance // m - (k > distance % m)
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        out.append((BITS - width * (k + 1), width, masks))
    return out


def _key(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, distance: int = 2, m: int = 2, max_bucket: int = 256) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that differ in at most ``distance`` bits.

    Where a segment value is shared by more than ``max_bucket`` fingerprints, stars stand for the pairs:
    fewer links, with the same components. That way is exact for a distance of two.
    """
    if distance != 2 or BITS % m:
        raise ValueError("the ways for frequent values fit a distance of two and equal segments")
    parts = _segments(distance, m)
    fp = F.col("fp")
    entry = F.explode(F.array(*(F.struct(F.lit(k).alias("seg"), _key(fp, s, w).alias("key")) for k, (s, w, _) in enumerate(parts))))  # noqa: E501
    entries = prints.select(fp, entry.alias("e")).select(F.col("fp").alias("b"), "e.seg", "e.key")
    probes = None
    for k, (s, w, masks) in enumerate(parts):
        own = _key(fp, s, w)
        wide = prints.select(fp.alias("a"), own.alias("own"), F.explode(F.array(*map(F.lit, masks)).cast("array<bigint>")).alias("mask"))
        near = F.col("own").bitwiseXOR(F.col("mask"))
        # Of two different values, only the smaller looks for the larger.
        some = wide.filter((F.col("mask") == 0) | (F.col("own") < near)).select("a", F.lit(k).alias("seg"), near.alias("key"), (F.col("mask") == 0).alias("same"))  # noqa: E501
        probes = some if probes is None else probes.unionByName(some)
    at = ["seg", "key"]
    crowded = cut_lineage(entries.groupBy(*at).agg(F.count("*").alias("n")).filter(F.col("n") > max_bucket).drop("n"))
    any_crowded = not crowded.isEmpty()
    thin = entries.join(crowded, at, "left_anti") if any_crowded else entries
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = probes.join(thin, at).filter((~F.col("same") | (F.col("a") < F.col("b"))) & (differ <= distance)).select("a", "b")
    if not any_crowded:
        return pairs.distinct()
    members = entries.join(crowded, at, "left_semi").select("b").union(probes.join(crowded, at, "left_semi").select("a"))
    ball = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS)))
    meets = members.distinct().select("b", F.explode(ball).alias("bit")).select("b", F.col("b").bitwiseXOR(F.col("bit")).alias("meet"))  # noqa: E501
    least = meets.groupBy("meet").agg(F.min("b").alias("a"))
    stars = meets.join(least, "meet").filter("a <> b").select("a", "b")
    return pairs.union(stars).distinct()


def grouped(
    docs: DataFrame, carry: list[str], doc_id: str = "doc_id", text: str = "text", distance: int = 2, max_bucket: int = 256
) -> DataFrame:
    """The carried columns, ``fp``, ``root`` (of the component) and ``component_id``, its smallest id."""
    names = list(dict.fromkeys([*carry, doc_id]))
    prints = cut_lineage(fingerprints(docs, names, text))
    reps = prints.groupBy("fp").agg(F.min(doc_id).alias("__least"))
    reps = cut_lineage(reps)
    found = components(links(reps.select("fp"), distance, max_bucket=max_bucket))
    rooted = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("__least").alias("component_id"))
    label = rooted.select("fp", "root").join(named, "root")
    return prints.join(label, "fp").select(*carry, "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs``, one per component: that with the smallest id, then text hash."""
    rows, name, back = set_aside(docs)
    mine, t = name[doc_id], name[text]
    rows = rows.withColumn("key", F.xxhash64(text_of(t)))
    known = grouped(rows.select(mine, "key", t), [mine, "key"], mine, t, **how)
    first = F.min(F.struct(F.col(mine).isNull().alias("none"), F.col(mine).alias("id"), F.col("key").alias("k")))
    kept = known.groupBy("root").agg(first.alias("of")).select("of.id", "of.k")
    same = F.col(mine).eqNullSafe(F.col("id")) & (F.col("key") == F.col("k"))
    return back(rows.join(kept, same, "left_semi").dropDuplicates([mine, "key"]))
