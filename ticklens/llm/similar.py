"""Near-duplicates by the similarity of word shingles, complete and verified.

Two documents are linked if the Jaccard similarity of their sets of ``GRAM``-word shingles is at least ``similar``;
linked ones form components. Candidates come from SimHash by multi-index hashing first, over the same shingles: equal
fingerprints, and those that differ in two bits, are compared (``near_prints``). A few bits' distance cannot promise
that similarity, so a prefix filter is the exact way for what that leaves apart: all sets are read in one order, and sets that are similar enough share a shingle among the first
``n - ceil(similar * n) + 1`` of their n. Every order finds every pair; the rarer the first shingles, the fewer others.
Shingles with small hashes come first, rare ones before common ones by their exact counts over all sets; the other hashes
follow, and shingles that are frequent in a sample are last. There are more small hashes than a prefix has, so a text
reaches a shared line only if it holds little else.

Equal sets collapse first. Sets that share a prefix shingle are led to the least set that has it; sizes and a
histogram of shingles, whose smaller counts add up to no less than what two sets share, rule most leads out
before whole sets are compared. What is linked forms components. Then pairs of different components are left. A
shingle with fewer than ``CROWDED`` sets pairs those of fitting size. A crowded one pairs none: its sets are read once
more, rare shingles first by the counts of all their shingles. What is then still crowded, sets of little but shared
lines, is compared in tiles of ``TILE`` sets by as many (``_tiled``), so no pair is ever a row.

A null or blank text has the empty shingle, one of fewer words a single shingle. Repeated rows are documents of
their own. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.llm.common import drop_put_by, give_back, new_folder, remove_folder, set_aside, small_batches, text_of
from ticklens.llm.graph import components
from ticklens.llm.simhash import BITS, links as near_links

if TYPE_CHECKING:
    import numpy as np

GRAM = 5
SIMILAR = 0.8
SAMPLE = 4096
FREQUENT = 4  # times in the sample
MAX_FREQUENT = 50_000
CROWDED = 32  # sets of a shingle
LEVELS = 2
MOST_BUCKETS = 4096  # of a histogram; a set has about one for four shingles
NO_COUNT = 32767  # stands for counts too large for the column, which rule nothing out
SMALL = 500_000  # chosen sets that are sent to all tasks, at some 40 bytes each
KEY_BITS = 48  # of a shingle in a prefix: a false meeting is one more candidate
SPARE = 1.25  # small hashes that a set has for each place of its prefix, in expectation
TILE = 96  # sets
TILE_GRAMS = 1 << 19  # shingles of a tile
COLUMNS = 4096  # shingles that a tile's tables have at a time


def grams(text: bytes, gram: int = GRAM) -> np.ndarray:
    """Hashes of the text's different word shingles, in order."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and white space only
    flat = b" ".join(words)
    if len(words) <= gram:
        return np.array([xxh64_intdigest(flat)], "uint64").view("int64")
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    hashes = (xxh64_intdigest(flat[a:b]) for a, b in zip(starts, ends[gram - 1 :], strict=False))
    return np.unique(np.fromiter(hashes, "uint64", len(words) - gram + 1).view("int64"))


def majority(g: np.ndarray) -> int:
    """64-bit majority vote over the hashes of a set, as a signed number."""
    import numpy as np

    ones = np.zeros(BITS, "int64")
    for part in range(0, len(g), 65_536):
        some = g[part : part + 65_536].astype(">i8")
        ones += np.unpackbits(some.view("uint8").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(2 * ones > len(g)).tobytes(), "big", signed=True)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values a sorted list has."""
    import numpy as np

    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def keys_of(g: np.ndarray) -> np.ndarray:
    return g & ((1 << KEY_BITS) - 1)


def prefix_size(n: int, similar: float) -> int:
    return n - math.ceil(similar * n - 1e-9) + 1


def prefix(g: np.ndarray, last: np.ndarray, similar: float) -> tuple[np.ndarray, int]:
    """The keys that may be in a set's prefix, and how many of them are small; ``last`` has the frequent keys.

    Small hashes come first, all of them; then, while these don't fill the prefix, the others by hash and frequent ones.
    """
    import numpy as np

    k = keys_of(g)
    often = among(k, last)
    small = (k < SPARE * (1 - similar) * (1 << KEY_BITS)) & ~often
    low = int(small.sum())
    return k[np.lexsort((k, often, ~small))[: max(low, prefix_size(len(g), similar))]], low


def _mapped(rows: DataFrame, text: str, made: str, one) -> DataFrame:
    """``rows`` with ``text`` replaced by the columns ``made``, which ``one`` gives for the text."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [c for c in rows.columns if c != text]
    fields = T._parse_datatype_string(made).fields
    kinds, names = [to_arrow_type(f.dataType) for f in fields], [*kept, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_put_by()
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary())
            out = [one(texts[i].as_py()) for i in range(len(texts))]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names)
        give_back()

    small_batches(rows.sparkSession)
    rows = rows.select(*kept, text_of(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(kept)], *fields]))


def frequent(docs: DataFrame, text: str, gram: int) -> np.ndarray:
    """Shingles that occur in several texts of a sample."""
    import numpy as np

    rate = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < int(rate * (1 << 30))).select(text)
    found = _mapped(some, text, "grams array<bigint>", lambda t: (grams(t, gram),)).select(F.explode("grams").alias("g"))
    often = found.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    return np.array(sorted(r.g for r in often.orderBy(F.desc("n"), "g").limit(MAX_FREQUENT).collect()), "int64")


SETS = "r bigint, n int, histogram array<smallint>, prefix array<bigint>, low int, fp bigint"


def sets(docs: DataFrame, text: str, last: np.ndarray, gram: int = GRAM, similar: float = SIMILAR) -> DataFrame:
    """The columns of ``docs`` but the text, ``r`` (of the set of shingles), its size ``n``, histogram, ``prefix`` and fingerprint."""
    import numpy as np
    from xxhash import xxh64_intdigest

    last = np.unique(keys_of(last))

    def one(t: bytes) -> tuple:
        g = grams(t, gram)
        r = xxh64_intdigest(g.tobytes())
        buckets = min(MOST_BUCKETS, 1 << max(2, (len(g) // 4).bit_length()))
        counts = np.bincount(g & (buckets - 1), minlength=buckets)
        if counts.max() >= NO_COUNT // 2:
            counts = np.full(buckets, NO_COUNT)
        return r - (1 << 64) if r >> 63 else r, len(g), counts, *prefix(g, last, similar), majority(g)

    return _mapped(docs, text, SETS, one)


class Tables:
    """Intermediate tables in the shared folder, removed together."""

    def __init__(self) -> None:
        self.folders: list[tuple] = []

    def store(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        folder = new_folder(spark, "similar")
        df.write.parquet(folder)
        self.folders.append((spark, folder))
        # A hint only: shuffle files that nothing refers to go when the driver next collects its garbage.
        spark.sparkContext._jvm.System.gc()
        return spark.read.schema(df.schema).parquet(folder)

    def remove(self) -> None:
        for spark, folder in self.folders:
            remove_folder(spark, folder)
        self.folders = []


def alike(pairs: DataFrame, reps: DataFrame, similar: float) -> DataFrame:
    """The ``pairs`` (a, b, …) that can be similar by the sizes and histograms of their sets."""
    of = lambda s: reps.select(F.col("r").alias(s), F.col("n").alias(f"n{s}"), F.col("histogram").alias(f"h{s}"))
    names = pairs.columns
    near = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similar - 1e-9)
    # Buckets are the last bits of a hash, so a longer histogram folds to one of half its length.
    half = lambda h: F.zip_with(F.slice(h, 1, (F.size(h) / 2).cast("int")), F.slice(h, (F.size(h) / 2).cast("int") + 1, F.size(h)), lambda x, y: (x + y).cast("smallint"))  # noqa: E501, E731
    ha, hb = F.col("ha"), F.col("hb")
    fa = F.when(F.size("ha") == 2 * F.size("hb"), half("ha")).otherwise(ha)
    fb = F.when(F.size("hb") == 2 * F.size("ha"), half("hb")).otherwise(hb)
    shared = F.aggregate(F.zip_with(fa, fb, lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    enough = shared * (1 + similar) >= (F.col("na") + F.col("nb")) * F.lit(similar - 1e-9)
    unknown = F.array_contains("ha", NO_COUNT) | F.array_contains("hb", NO_COUNT) | F.isnull(shared)
    enough = unknown | enough
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(near & enough).select(*names)


def verified(pairs: DataFrame, found: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets in ``found`` (r, grams) are similar."""
    rows = pairs.select("a", "b").join(found.toDF("a", "ga"), "a").join(found.toDF("b", "gb"), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return rows.filter(both >= (F.size("ga") + F.size("gb") - both) * F.lit(similar - 1e-9)).select("a", "b")


def near_prints(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or differ in two bits; of equal ones, each with the least set."""
    least = reps.groupBy("fp").agg(F.min("r").alias("low"))
    same = reps.select("r", "fp").join(least, "fp").filter("r <> low").select(F.col("low").alias("a"), F.col("r").alias("b"))
    of = lambda s: least.select(F.col("fp").alias(s), F.col("low").alias(f"r{s}"))
    near = near_links(least.select("fp")).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))).distinct()


def rare_first(listed: DataFrame, similar: float) -> DataFrame:
    """(g, r, n) of the shingles in the prefixes of the sets ``listed`` (r, n, prefix, low) that another set lists, too.

    Of a set's ``low`` first keys, all of which every set lists, the rarest come first; those that no other set has take
    their places. A set with fewer of them than its prefix has places lists no more keys than that.
    """
    entries = listed.select("r", F.explode("prefix").alias("g"))
    known = entries.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    shared = entries.join(known, "g").groupBy("r").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("s"))
    places = F.col("n") - F.ceil(F.col("n") * F.lit(similar) - 1e-9).cast("int") + 1
    left = F.greatest(places - (F.col("low") - F.size("s")), F.lit(0))
    some = F.when(F.col("low") <= places, F.col("s")).otherwise(F.slice("s", F.lit(1), left))
    return shared.join(listed.select("r", "n", "low"), "r").select("r", "n", F.explode(some["g"]).alias("g"))


def _pairs_within(rows: DataFrame, by: list[str | Column], similar: float) -> DataFrame:
    """All pairs (a, b) of sets of different roots and fitting sizes in a group that is bounded."""
    members = F.array_sort(F.collect_set(F.struct("n", "r", "root"))).alias("m")
    fits = lambda x, y: (y["root"] != x["root"]) & (x["n"] >= y["n"] * F.lit(similar - 1e-9))
    later = lambda x, i: F.filter(F.slice("m", i + 2, F.size("m")), lambda y: fits(x, y))
    pair = lambda x, y: F.struct(F.least(x["r"], y["r"]).alias("a"), F.greatest(x["r"], y["r"]).alias("b"))
    each = F.transform("m", lambda x, i: F.transform(later(x, i), lambda y: pair(x, y)))
    return rows.groupBy(*by).agg(members).select(F.inline(F.flatten(each))).distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``."""
    import numpy as np

    fa, fb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(fa, fb)
    out = np.zeros((len(a), len(b)))

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = among(flat, both)
        rows, at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[there], np.searchsorted(both, flat[there])
        order = np.argsort(at, kind="stable")
        return rows[order], at[order]

    sides = [(len(s), *places(s, f)) for s, f in ((a, fa), (b, fb))]
    for start in range(0, len(both), COLUMNS):
        tables = []
        for size, rows, at in sides:
            some = slice(*np.searchsorted(at, [start, start + COLUMNS]))
            table = np.zeros((size, COLUMNS), "float32")
            table[rows[some], at[some] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype("int64")


def _tiled(crowd: DataFrame, reps: DataFrame, texts, gram: int, similar: float, tables: Tables) -> DataFrame:
    """Links (a, b), one for each two roots that have any, among sets of ``crowd`` (g, r, root) that meet in a shingle or over others.

    Such a cluster is cut by bands of size, a band into tiles by the set's number; a tile meets those of its own band and
    of the next one.
    """
    import numpy as np
    import pyarrow as pa

    least = crowd.groupBy("g").agg(F.min("r").alias("low"))
    cluster = components(crowd.join(least, "g").select(F.col("r").alias("a"), F.col("low").alias("b"))).toDF("r", "cluster")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / similar)).cast("int")
    sets = crowd.select("r", "root").distinct().join(cluster, "r").join(reps.select("r", "n"), "r")
    sets = tables.store(sets.withColumn("band", band))
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_GRAMS)).cast("int")
    tiles = sets.groupBy("cluster", "band").agg(tiles.alias("k"))
    below, above = (tiles.select("cluster", (F.col("band") + d).alias("band"), F.col("k").alias(c)) for d, c in ((1, "kb"), (-1, "ka")))
    by = ["cluster", "band"]
    rows = sets.join(tiles, by).join(below, by, "left").join(above, by, "left").withColumn("t", F.pmod(F.xxhash64("r"), "k").cast("int"))

    def meets(k: str, hi: Column, lo: Column, i, j, side) -> Column:
        each = lambda u: F.struct(hi.alias("hi"), lo.alias("lo"), i(u).alias("i"), j(u).alias("j"), side(u).alias("side"))
        return F.transform(F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.array().cast("array<int>")), each)

    t, b = F.col("t"), F.col("band")
    own = meets("k", b, b, lambda u: F.least(t, u), lambda u: F.greatest(t, u), lambda u: (t > u).cast("int"))
    lower = meets("kb", b, b - 1, lambda u: t, lambda u: u, lambda u: F.lit(0))
    upper = meets("ka", b + 1, b, lambda u: u, lambda u: t, lambda u: F.lit(1))
    found = _mapped(texts(sets.select("r")), "t", "grams array<bigint>", lambda x: (grams(x, gram),)).dropDuplicates(["r"])
    dealt = rows.select("cluster", "r", "root", F.explode(F.concat(own, lower, upper)).alias("m")).select("cluster", "r", "root", "m.*")

    def run(table: pa.Table) -> pa.Table:
        drop_put_by()
        side, r, root = (table.column(c).to_numpy() for c in ("side", "r", "root"))
        some = [x.values.to_numpy() for x in table.column("grams")]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hi, lo, i, j = (table.column(c)[0].as_py() for c in ("hi", "lo", "i", "j"))
        if (hi, i) == (lo, j):
            right = left
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = overlaps([some[x] for x in left], [some[x] for x in right])
        n = np.array([len(x) for x in some])
        near = both >= (n[left][:, None] + n[right][None] - both) * (similar - 1e-9)
        x, y = np.nonzero(near & (root[left][:, None] != root[right][None]))
        x, y = left[x], right[y]
        of = zip(np.minimum(root[x], root[y]).tolist(), np.maximum(root[x], root[y]).tolist(), strict=True)
        one = list({pair: k for k, pair in enumerate(of)}.values())
        return pa.table({"a": np.minimum(r[x], r[y])[one], "b": np.maximum(r[x], r[y])[one]})

    return dealt.join(found, "r").groupBy("cluster", "hi", "lo", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def linked(reps: DataFrame, texts, last: np.ndarray, gram: int, similar: float, tables: Tables) -> DataFrame:
    """(r, root) of every set of ``reps`` that has a link; ``texts(chosen)`` gives (r, text) of the sets chosen."""
    store = tables.store
    at = reps.select("r", F.col("r").alias("root")).limit(0)
    listed = reps.select("r", "n", "prefix", "low")
    found: DataFrame | None = None

    def joined(more: DataFrame) -> DataFrame:
        """The components with ``more`` links (a, b); of what was found before, a link of each set to its root is enough."""
        more = store(more)
        if more.isEmpty():
            return at
        return components(at.toDF("a", "b").unionByName(more)).withColumnRenamed("node", "r")

    def compared(pairs: DataFrame) -> DataFrame:
        """The components with the links among ``pairs``; sets that were not compared before are read."""
        nonlocal found
        chosen = pairs.select(F.col("a").alias("r")).unionByName(pairs.select(F.col("b").alias("r"))).distinct()
        if found is not None:
            chosen = chosen.join(found.select("r"), "r", "left_anti")
        new = store(_mapped(texts(store(chosen)), "t", "grams array<bigint>", lambda t: (grams(t, gram),)).dropDuplicates(["r"]))
        found = new if found is None else found.unionByName(new)
        return joined(verified(pairs, found, similar))

    root_of = lambda df, own, name: df.join(at.toDF(own, name), own, "left").withColumn(name, F.coalesce(name, own))
    apart_of = lambda df: root_of(root_of(df, "a", "ra"), "b", "rb").filter("ra <> rb")
    at = compared(store(alike(near_prints(reps), reps, similar)))
    for level in range(1, LEVELS + 1):
        entries = store(rare_first(listed, similar))
        met = entries.groupBy("g").agg(F.min("r").alias("low"), F.count("*").alias("df")).filter("df > 1")
        shared = store(entries.join(met, "g"))
        # Each set is first compared with the one set that most of its shingles lead to.
        leads = shared.filter("r <> low").groupBy(F.col("r").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("times"))
        leads = store(alike(leads, reps, similar))
        best = apart_of(leads).groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
        at = compared(store(best))

        open_leads = apart_of(leads.select("a", "b")).select("a", "b")
        placed = root_of(shared.select("g", "r", "n", "df"), "r", "root")
        split = placed.groupBy("g").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("g")
        apart = store(placed.join(split, "g"))
        few = store(_pairs_within(apart.filter(F.col("df") < CROWDED), ["g"], similar))
        pairs = few.join(leads.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        pairs = alike(pairs.join(leads.select("a", "b"), ["a", "b"], "left_anti"), reps, similar)
        at = compared(store(pairs.unionByName(open_leads)))
        # What is still apart in a crowded shingle goes on, first with its rarest shingles, then in tiles.
        many = root_of(apart.filter(F.col("df") >= CROWDED).drop("root"), "r", "root")
        crowd = many.groupBy("g").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other")
        crowd = store(many.select("g", "r", "root").join(crowd.select("g"), "g"))
        if crowd.isEmpty():
            break
        if level == LEVELS:
            at = joined(_tiled(crowd, reps, texts, gram, similar, tables))
            break
        again = store(crowd.select("r").distinct())
        every = _mapped(texts(again), "t", "prefix array<bigint>, low int", lambda t: ((k := keys_of(grams(t, gram))), len(k)))
        listed = store(every.dropDuplicates(["r"]).join(reps.select("r", "n"), "r"))
    return at


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, similar: float = SIMILAR
) -> DataFrame:
    """The rows of ``docs``, one per component: that with the smallest id, then text hash."""
    rows, name, back = set_aside(docs)
    mine, t = name[doc_id], name[text]
    # A struct, so that null ids meet each other.
    rows = rows.withColumn("who", F.struct(F.col(mine).alias("i"), F.xxhash64(text_of(t)).alias("k")))
    tables = Tables()
    last = frequent(rows.select("who", F.col(t).alias("t")), "t", gram)
    known = sets(rows.select("who", F.col(t).alias("t")), "t", last, gram, similar)
    least = F.min(F.struct(F.col("who.i").isNull().alias("none"), "who")).alias("of")
    reps = known.groupBy("r").agg(least, F.first(F.struct("n", "histogram", "prefix", "low", "fp")).alias("s"))
    reps = tables.store(reps.select("r", "of", "s.*"))

    def texts(chosen: DataFrame) -> DataFrame:
        whose = reps.join(chosen, "r", "left_semi").select("r", F.col("of.who").alias("who"))
        whose = F.broadcast(whose) if chosen.count() <= SMALL else whose
        return rows.select("who", F.col(t).alias("t")).join(whose, "who").select("r", "t")

    at = linked(reps, texts, last, gram, similar, tables)
    kept = reps.select("r", "of").join(at, "r", "left").groupBy(F.coalesce("root", "r").alias("root")).agg(F.min("of").alias("of"))
    kept = Tables().store(kept.select("of.who"))
    tables.remove()
    return back(rows.join(kept, "who", "left_semi").dropDuplicates(["who"]))
