"""The pipeline, stage by stage."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import data
from ticklens.llm import langid, pieces, secrets, similar


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(data.documents(), data.DOCS)
    docs = docs.select("*", *(F.lit("mine").alias(c) for c in (*data.CLASHING, "c0", "position", "taken")))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], folder).write.parquet(f"{folder}/out/{name}")
        out.append(spark.read.parquet(f"{folder}/out/{name}"))
    return folder, out


def test_order_and_columns(stages):
    _, out = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "source_mix", "sentencepiece"]
    assert all(d.columns == out[0].columns for d in out[:-1])


def test_each_stage_decides(stages):
    _, (docs, kept, single, masked, mixed, tokens) = stages
    model = langid.fit(docs)
    want = {r.doc_id for r in langid.predict(docs, model, ["doc_id"]).collect() if not r.rejected}
    assert {r.doc_id for r in kept.collect()} == want and want >= set(range(60))
    words = [((r.text or "").lower().split(), r.doc_id) for r in kept.collect()]
    shingles = [({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}, i) for w, i in words]
    first = [all(5 * len(a & b) < 4 * len(a | b) or i is None or j is not None and j >= i for b, j in shingles) for a, i in shingles]
    assert {r.doc_id for r in single.collect()} == {i for (_, i), one in zip(shingles, first, strict=True) if one}
    found = {(r.doc_id, r.text): [x for x in r.found if x.live] for r in secrets.scan(single, ["doc_id", "text"]).collect()}
    clean = {r.doc_id: r for r in masked.collect()}
    for (doc_id, text), spans in found.items():
        assert (clean[doc_id].text == text) == (not spans)
        assert clean[doc_id].n_chars == len(clean[doc_id].text)
    copies = mixed.groupBy("doc_id", "text").count().collect()
    assert max(r["count"] for r in copies) <= 3 and {r.text for r in copies} <= {r.text for r in clean.values()}
    sizes = {s: sum(len(re.findall(r"\S+", r.text)) for r in clean.values() if r.source == s) for s in ("s0", "s1", "s2")}
    taken = {s: sum(len(re.findall(r"\S+", r.text)) for r in mixed.filter(f"source = '{s}'").collect()) for s in sizes}
    assert taken["s2"] < 3 * sizes["s2"] + 200 and taken["s0"] > 0
    sp = pieces.encoder(public_tokenizers.path("piece_bpe_32k.model")).library
    want = sorted(hashlib.sha256(sp.decode(sp.encode(r.text, add_eos=True)).encode()).hexdigest() for r in mixed.collect())
    assert sorted(r.decoded_sha256 for r in tokens.collect()) == want


def test_run_is_its_stages(spark, stages):
    folder, out = stages
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(corpus_pipeline.run(spark, folder)) == rows(out[-1])


def test_empty_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, data.write(spark, tmp_path, [])).count() == 0


def test_a_line_that_unlike_texts_share_costs_pairs_in_proportion(spark, monkeypatch):
    """2,000 texts with one long line in common, and 30 of little else: candidates grow with the texts, links are whole."""
    rng, seen = random.Random(5), []
    line = data.prose(rng, "en", 40)
    rows = [data.prose(rng, "fr", 70) + " " + line for _ in range(2000)]
    rows += [line + " " + data.prose(rng, "de", i % 5 + 1) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(similar, "FREQUENT", 10**9)  # nothing is known beforehand
    alike = similar.alike

    def counted(pairs, *more):
        seen.append(pairs.count())
        return alike(pairs, *more)

    monkeypatch.setattr(similar, "alike", counted)
    kept = {r.doc_id for r in similar.one_of_each(docs).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, map(str.lower, rows))]
    near = [any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(2000, i)) for i in range(2000, 2030)]
    assert kept == set(range(2000)) | {i for i, again in zip(range(2000, 2030), near, strict=True) if not again}
    assert sum(seen) < 30 * len(rows)  # all pairs would be two million


def test_texts_that_are_half_shared_lines_cost_hardly_a_pair(spark, monkeypatch):
    """900 texts of three out of twenty lines and as many words of their own: their rarest shingles are nobody else's."""
    rng, seen = random.Random(7), []
    lines = [data.prose(rng, "en", 12) for _ in range(20)]
    rows = [" ".join([*rng.sample(lines, 3), data.prose(rng, "fr", 30)]) for _ in range(900)]
    rows += [r + " more" for r in rows[:20]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    monkeypatch.setattr(similar, "FREQUENT", 10**9)
    alike = similar.alike
    monkeypatch.setattr(similar, "alike", lambda pairs, *more: seen.append(pairs.count()) or alike(pairs, *more))
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == set(range(900))
    assert sum(seen) < 10 * len(rows)  # 86,700 before shingles were counted


@pytest.mark.parametrize(("crowded", "tile"), [(32, 96), (3, 7)])
def test_a_crowd_of_copies_meets_in_tiles(spark, monkeypatch, crowded, tile):
    """Changed copies of two texts, many of them just below the similarity: links are those of all pairs."""
    rng = random.Random(11)
    base = [data.prose(rng, "en", 120).split() for _ in range(2)]
    rows = []
    for i in range(240):
        words = list(base[i % 2])
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = data.prose(rng, "de", 1)
        rows.append(" ".join(words[: rng.randint(95, 120)]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, map(str.lower, rows))]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    monkeypatch.setattr(similar, "CROWDED", crowded)
    monkeypatch.setattr(similar, "TILE", tile)
    tiled, met = [], similar._tiled
    monkeypatch.setattr(similar, "_tiled", lambda *how: tiled.append(met(*how)) or tiled[-1])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == set(root)
    assert tiled


def test_overlaps():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.integers(0, 12_000, n)) for n in sizes] for sizes in ((1, 40, 9000), (7000, 3)))
    assert similar.overlaps(a, b).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]


def test_fingerprints_lead_to_near_copies(spark, monkeypatch):
    """Without the prefix filter: most long texts that differ in a word meet by their fingerprints, unlike ones never."""
    rng = random.Random(9)
    rows = [data.prose(rng, "en", 500) for _ in range(20)]
    rows += [r + " more" for r in rows]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(similar, "LEVELS", 0)
    kept = {r.doc_id for r in similar.one_of_each(docs).collect()}
    assert kept >= set(range(20)) and len(kept) <= 30
    monkeypatch.undo()
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == set(range(20))


def test_stages_give_back_what_the_encoder_put_by(spark, monkeypatch):
    """Python workers are used again: a task of another stage begins without the encoder's words."""
    docs = spark.createDataFrame([(i, f"some words {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    model, tasks, kind = public_tokenizers.path("piece_bpe_32k.model"), [], type(docs)
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *more, **how: tasks.append(f) or own(self, f, *more, **how))
    langid.predict(docs, langid.fit(docs), ["doc_id"])
    similar.sets(docs, "text", similar.frequent(docs, "text", 5))
    assert len(tasks) == 6
    for task in tasks:
        pieces.encoder(model).encode(["some words"])
        assert pieces.encoder.cache_info().currsize == 1
        list(task(iter(())))
        assert pieces.encoder.cache_info().currsize == 0
