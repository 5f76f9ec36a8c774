"""The operators without user functions against their SQL and against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import data
from tests.test_check_sql import canon
from ticklens.llm import licenses, mixing, quality, secrets, sharding
from ticklens.llm.queries import ORACLE, QUERIES

NATIVE = ("op2_secret_scan", "op3_license_scan", "op5_mix_sources", "op9_quality_rules", "op13_minimax_shards")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("odd"), data.documents())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("empty"), [])


def wide(spark, rows):
    """The documents with columns whose names the operators use inside."""
    docs = spark.createDataFrame(rows, data.DOCS)
    return docs.select("*", *(F.lit("mine").alias(c) for c in data.CLASHING))


@pytest.mark.parametrize("name", NATIVE)
@pytest.mark.parametrize("table", ["odd", "empty"])
def test_equals_sql(spark, request, name, table):
    folder = request.getfixturevalue(table)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLE[name]).df()
    assert canon(got) == canon(want)
    assert len(got) == (len(data.documents()) if table == "odd" else 0)


def test_plans_have_no_python(spark, odd):
    for name in NATIVE:
        plan = QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_quality_counts(spark):
    rows = data.documents()
    got = {(r.doc_id, r.text): r for r in quality.judge(wide(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        cover = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc_id, text]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(cover))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert r.base_failed == (len(words) < 50 or 100 * len(cover) > 50 * len(words))
        assert r.rid == "mine"


def test_quality_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "word " * 60)], "doc_id int, text string")
    strict = (quality.Rule("long", "mean_word_length", None, 3.0), quality.Rule("few", "n_words", 61, None))
    r = quality.judge(docs, strict, max_repeat_percent=100).first()
    assert r.failed_rules == ["long", "few"] and not r.kept and not r.base_failed
    assert quality.judge(docs, (), max_repeat_percent=100).first().kept


def base_spans(text):
    t, out = text or "", []
    names = r"(?i:password|passwd|secret|token|api_?key)"
    assign = rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, (pattern, ok) in enumerate(
        ((assign, lambda m: len(m[2]) >= 12), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), (r"[0-9a-f]+", lambda m: len(m[0]) >= 16))
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if ok(m)]
    return sorted(out)


def test_secret_base_spans(spark):
    rows = data.documents()
    got = secrets.digest(secrets.scan(wide(spark, rows), ["doc_id", "text"])).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = base_spans(r.text)
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), r.text[:80]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_ownership_tells_examples_from_live_tokens(spark):
    rows = [(i, f"key Zx81LpQw93TtRr72YyUu1 and Qq{i}81LpQw93TtRr72YyUu", f"s{i % 4}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    for r in secrets.scan(docs, ["doc_id"]).collect():
        assert [x.start for x in r.found] == [30]  # the shared one is an example
        assert r.found[0].live and r.found[0].n_owners == 1
    clean = secrets.masked(docs).collect()
    assert all(x.text == "key Zx81LpQw93TtRr72YyUu1 and <secret>" for x in clean)


def test_masking_merges_overlaps_and_keeps_rows(spark):
    rows = [(1, "é token=abcdef0123456789abcdef end", "a"), (1, "é token=abcdef0123456789abcdef end", "a"), (None, None, None), (2, "fine", "b")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("rid", F.lit(0))
    got = sorted(str(r.text) for r in secrets.masked(docs).collect())
    assert got == ["None", "fine", "é <secret> end", "é <secret> end"]


def lower_words(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def test_license_phrases(spark):
    rows = data.documents()
    got = licenses.digest(licenses.scan(wide(spark, rows), ["doc_id", "text"])).collect()
    assert len(got) == len(rows)
    for r in got:
        words, places, labels = lower_words(r.text), [], set()
        for label, phrase in licenses.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} - {""}


def test_neighbouring_diagonals_are_merged(spark):
    text = "this work is licensed under the really gnu general public license version 3"
    docs = spark.createDataFrame([(1, text), (2, "general public library")], "doc_id int, text string")
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(docs, ["doc_id"], min_cover=0.7)).collect()}
    assert got[1].labels == "gpl-3" and 0.7 <= got[1].score < 1
    assert got[2].labels == "" and got[2].score == 0


def test_templates_are_bounded():
    with pytest.raises(ValueError, match="broadcast"):
        licenses.template_rows((("x", "a b c " * 7000),), ())


def test_mix_meets_its_targets(spark):
    rows = data.documents()
    got = mixing.mix(mixing.sized(wide(spark, rows))).collect()
    assert len(got) == len(rows)
    by_source, total = {}, sum(r["size"] for r in got)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by_source.setdefault(r.source, []).append(r)
    names = sorted((s for s in by_source if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap = {s: 3 * sum(r["size"] for r in by_source[s]) for s in names}
    level, open_ = 0.0, set(names)
    while True:
        level = (total - sum(cap[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= cap[s]}
        if not full:
            break
        open_ -= full
    for s in names:
        want = weight[s] * level if s in open_ else cap[s]
        assert by_source[s][0].target == pytest.approx(want)
        assert abs(sum(r.taken for r in by_source[s]) - want) <= 0.5 + 1e-6
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)


def test_mix_repeats_itself_and_keeps_the_schedule(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    once = mixing.copies(mixing.sized(docs)).select("doc_id", "source", "position").collect()
    again = mixing.copies(mixing.sized(docs.repartition(7))).select("doc_id", "source", "position").collect()
    assert once == again
    share = lambda s, a, b: sum(r.source == s and a <= r.position < b for r in once)
    assert share("s0", 0, 0.5) < 0.75 * share("s0", 0.5, 1)  # its weight rises from 3 to 7
    assert share("s1", 0, 0.5) == pytest.approx(share("s1", 0.5, 1), rel=0.02)


def test_schedules_are_inverted(spark):
    knots = ((0.0, 1.0), (0.25, 4.0), (0.5, 0.0), (1.0, 2.0))
    area, done = mixing.integral(knots), 0.0
    points = []
    for (a, w0), (b, w1) in zip(knots, knots[1:], strict=False):
        for x in (0.0, 0.3, 0.8):
            t = x * (b - a)
            points.append((a + t, (done + w0 * t + (w1 - w0) / (b - a) * t * t / 2) / area))
        done += (b - a) * (w0 + w1) / 2
    df = spark.createDataFrame(points, "t double, share double")
    for r in df.select("t", mixing.inverted(knots, F.col("share")).alias("got")).collect():
        assert r.got == pytest.approx(r.t, abs=1e-9)


# ---- shards


def plain_shards(sizes, k):
    """The smallest capacity by trying all, and the cuts that every shard's load keeps within."""

    def needed(cap):
        n, load = 1, 0
        for s in sizes:
            n, load = (n, load + s) if load + s <= cap else (n + 1, s)
        return n

    return next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= k)


@pytest.mark.parametrize(("digits", "at_once", "seed"), [(3, 50_000, 0), (1, 20, 1), (0, 1, 2)])
def test_minimax_is_the_smallest_capacity(spark, monkeypatch, digits, at_once, seed):
    """However far the search has to split its elements."""
    monkeypatch.setattr(sharding, "DIGITS", digits)
    monkeypatch.setattr(sharding, "AT_ONCE", at_once)
    rng = random.Random(seed)
    rows = [(hashlib.md5(str(i).encode()).hexdigest(), rng.choice([9, 20, 50, 400 if seed else 60])) for i in range(300)]
    groups = spark.createDataFrame(rows, "key string, size bigint")
    capacity, cuts = sharding.minimax(groups, 7)
    rows.sort()
    assert capacity == plain_shards([s for _, s in rows], 7)
    shards = Counter()
    for key, s in rows:
        shards[sum(key >= c for c in cuts)] += s
    assert len(shards) == 7 and max(shards.values()) <= capacity
    assert sorted(cuts) == cuts and set(cuts) <= {k for k, _ in rows}


def test_shards_keep_groups_whole_and_slots_gapless(spark):
    rows = data.documents() + [(1000 + i, "the one text that many share", "en", "s0", 1) for i in range(400)]
    out = sharding.sharded(sharding.sized(wide(spark, rows)), 5).collect()
    assert len(out) == len(rows) and {r.kept for r in out} == {"mine"}
    by_text, by_shard, load = {}, {}, Counter()
    for r in out:
        assert r.size == len((r.text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        by_text.setdefault(r.text or "", set()).add(r.shard)
        by_shard.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values()) and set(by_shard) == set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    # The two that are larger than an even share stand alone; the rest is even but for its largest group.
    alone = [load[by_text[t].copy().pop()] for t in ("the one text that many share", max(by_text, key=len))]
    rest = sorted(load[s] for s in load if load[s] not in alone)
    assert len(rest) == 3 and rest[-1] - rest[0] < 3000


def test_fewer_groups_than_shards(spark):
    for texts in ([], ["a"], ["a", "b", None, "", "a"], ["x" * 10_000, "y"]):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
        out = sharding.sharded(sharding.sized(docs)).collect()
        assert len({r.shard for r in out}) == len({r.text or "" for r in out}) and len(out) == len(texts)
        assert all(0 <= r.shard < 24 for r in out)


def test_values_in_many_repositories_are_examples(spark):
    """A value that two owners hold in many repositories is an example, one that they hold in few looks live."""
    many, few = "Ab3ExampleKey0000000001", "Ab3LiveKey000000000000002"
    rows = [(i, f"k {many}", "en", f"s{i % 2}", 1) for i in range(secrets.EXAMPLE_REPOS)]
    rows += [(1000 + i, f"k {few}", "en", f"s{i % 2}", 1) for i in range(secrets.EXAMPLE_REPOS - 1)]
    docs = spark.createDataFrame(rows, data.DOCS)
    found = {r.doc_id: [(x.live, x.n_owners, x.n_repos) for x in r.found] for r in secrets.scan(docs, ["doc_id"]).collect()}
    assert all(found[i] == [] for i in range(secrets.EXAMPLE_REPOS))
    assert all(found[1000 + i] == [(True, 2, secrets.EXAMPLE_REPOS - 1)] for i in range(secrets.EXAMPLE_REPOS - 1))
