"""Secret scans with corpus-wide ownership frequency.

Candidates are found in whole texts by pattern. Their values are hashed, and the hashes are
counted over the corpus by distinct repositories and distinct owners. A value that several
owners share, or that lies in far more repositories than a value in use gets into, is an example that was copied
around; a value that stays with one or two owners and few of their repositories looks live. The base kinds (``assign``, ``access``, ``hex``) are reported either way; a mixed
token without any telling context (kind ``token``) is reported only if it looks live and no
base span overlaps it.

One scan of the texts leaves a narrow table (lengths and hashes, no text), which is written
once to the shared checkpoint folder. Values are pre-aggregated by (value, owner, repository)
before they meet, so a value in a third of all rows is a few rows per task; the join back is an
ordinary equi-join that adaptive execution may split. Places come from running sums over the
matches of one text. Null texts count as empty; rows without candidates, repeated rows and
rows with null ids, owners or repositories are all returned (nulls form an owner of their own).
Columns of the input other than those named in the arguments are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklens.llm.common import set_aside, text_of
from ticklens.session import cut_lineage


def _either(word: str) -> str:
    """The word as a pattern with ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Patterns of the kinds, in the order in which they are listed.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = rf"""({"|".join(map(_either, NAMES))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "token")
MIN_ASSIGNED = 12
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 50


def _matches(text: Column, kind: int, pattern: str, group: int) -> Column:
    """(kind, index, gap before, length, value length, value hash, mixed) of each match.

    The pieces between the matches give the gaps; only texts with a match are split.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def row(x: Column, i: Column) -> Column:
        mixed = x.value.rlike("[0-9]") & x.value.rlike("[A-Z]") & x.value.rlike("[a-z]")
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(x.gap).alias("gap"),
            F.length(x.match).alias("len"),
            F.length(x.value).alias("value_len"),
            F.md5(x.value).alias("value"),
            mixed.alias("mixed"),
        )

    found = F.filter(F.transform(parts, row), lambda x: x.len.isNotNull())
    kind_of = "array<struct<kind:int,i:int,gap:int,len:int,value_len:int,value:string,mixed:boolean>>"
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(kind_of)


def candidates(docs: DataFrame, carry: list[str], repo: str, owner: str, text: str = "text") -> DataFrame:
    """The carried columns, a row number and all matches of each row, written once."""
    t = text_of(text)
    matches = F.concat(
        _matches(t, 0, ASSIGN, 2), _matches(t, 1, ACCESS, 0), _matches(t, 2, HEX, 0), _matches(t, 3, TOKEN, 0)
    )
    return cut_lineage(
        docs.select(
            F.struct(*carry).alias("doc"),
            F.col(repo).alias("repo"),
            F.col(owner).alias("owner"),
            F.monotonically_increasing_id().alias("rid"),
            matches.alias("matches"),
        )
    )


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value; three sums that combine early."""
    return (
        spans.groupBy("value", "owner", "repo")
        .agg(F.lit(1).alias("one"))
        .groupBy("value", "owner")
        .agg(F.count("*").alias("n_repos"))
        .groupBy("value")
        .agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))
    )


def scan(
    docs: DataFrame,
    carry: list[str],
    repo: str = "doc_id",
    owner: str = "source",
    text: str = "text",
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """Per row of ``docs``: the carried columns and ``found``, sorted by (start, kind).

    ``found`` lists (start, kind, end, base, live, n_owners, n_repos), places in code points from 0,
    ends exclusive. ``live`` is false for values that ``example_owners`` owners or more share or ``example_repos``
    repositories or more hold.
    """
    rows = candidates(docs, carry, repo, owner, text)
    exploded = rows.select("rid", "repo", "owner", F.explode("matches").alias("m")).select(
        "rid", "repo", "owner", "m.*"
    )
    before = W.partitionBy("rid", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    base = F.col("kind") < 3
    long_enough = (F.col("kind") != 0) | (F.col("value_len") >= MIN_ASSIGNED)
    placed = (
        exploded.repartition("rid")
        .withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("len"))
        .filter(long_enough & (base | F.col("mixed")))
        .withColumn("base", base)
    )
    by_place = W.partitionBy("rid").orderBy("start", "kind")
    until = F.max(F.when(F.col("base"), F.col("end"))).over(by_place.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by_place.rowsBetween(1, W.unboundedFollowing))
    met = F.coalesce(until > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    spans = placed.withColumn("met", met).filter(F.col("base") | ~F.col("met"))
    spans = cut_lineage(spans.select("rid", "repo", "owner", "value", "start", "kind", "end", "base"))
    judged = spans.join(ownership(spans), "value")
    judged = judged.withColumn("live", (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos))
    found = (
        judged.filter(F.col("base") | F.col("live"))
        .groupBy("rid")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base", "live", "n_owners", "n_repos"))).alias("found"))
    )
    none = F.array().cast(found.schema["found"].dataType)
    return rows.join(found, "rid", "left").select("doc.*", F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and the joined places of ``scan``'s lists."""
    names = F.array(*(F.lit(k) for k in KINDS))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", names[x.kind], x.start, x.end)), ",")
    count = lambda f: F.size(F.filter("found", f)).cast("long")
    base = F.filter("found", lambda x: x.base)
    return scanned.select(
        *(c for c in scanned.columns if c != "found"),
        count(lambda x: x.kind == 0).alias("n_assign"),
        count(lambda x: x.kind == 1).alias("n_access"),
        count(lambda x: x.kind == 2).alias("n_hex"),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
        count(lambda x: x.live).alias("n_live"),
        count(lambda x: ~x.live).alias("n_examples"),
        F.array_join(F.transform("found", lambda x: x.n_owners), ",").alias("n_owners"),
        F.array_join(F.transform("found", lambda x: x.n_repos), ",").alias("n_repos"),
    )


def without_live(text: Column, found: Column, mark: str = "<secret>") -> Column:
    """The text with every live span replaced by ``mark``; overlapping spans give one mark."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc.at + 1, x.start - acc.at)
        return (
            F.when(x.start >= acc.at, F.struct(x.end.cast("int").alias("at"), F.concat(acc.out, gap, F.lit(mark)).alias("out")))
            .when(x.end > acc.at, F.struct(x.end.cast("int").alias("at"), acc.out.alias("out")))
            .otherwise(acc)
        )

    rest = lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text)))
    return F.aggregate(F.filter(found, lambda x: x.live), state, step, rest)


def masked(docs: DataFrame, doc_id: str = "doc_id", owner: str = "source", text: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` with live secrets masked.

    Spans are found per row and looked up by id and text hash: equal texts have equal spans, so rows that
    repeat need no number of their own. Only rows of texts with a live span are looked up successfully.
    """
    rows, name, back = set_aside(docs)
    mine, whose, t = name[doc_id], name[owner], name[text]
    rows = rows.withColumn("key", F.xxhash64(text_of(t)))
    found = scan(rows.select(mine, whose, t, "key"), [mine, "key"], mine, whose, t, **how)
    live = found.filter(F.exists("found", lambda x: x.live)).dropDuplicates([mine, "key"])
    live = live.select(F.col(mine).alias("id"), F.col("key").alias("k"), "found")
    same = (F.col("key") == F.col("k")) & F.col(mine).eqNullSafe(F.col("id"))
    clean = F.when(F.col("found").isNull(), F.col(t)).otherwise(without_live(text_of(t), F.col("found")))
    return back(rows.join(live, same, "left").withColumn(t, clean))
