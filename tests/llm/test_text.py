"""The operators on Arrow batches against SQL, plain loops, exact round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import io
import random
import re
from zlib import crc32

import duckdb
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import data
from tests.test_check_sql import canon
from ticklens.llm import graph, langid, pieces, simhash, topk, toxicity, warc
from ticklens.llm.common import new_folder
from ticklens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def wide(df):
    return df.select("*", *(F.lit("mine").alias(c) for c in data.CLASHING if c not in df.columns))


@pytest.fixture(scope="module")
def docs(spark):
    return wide(spark.createDataFrame(data.documents(), data.DOCS).repartition(3)).cache()


# WARC


def page_rows():
    rng = random.Random(1)
    blob = "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(70_000))
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" if i % 2 else data.prose(rng, "fr", i)) for i in range(40)]
    rows += [(None, None, "<p>1</p>"), (50, None, None), (51, "http://x/\r\ny", ""), (52, "http://x", blob), (52, "http://x", blob)]
    return rows + [(53, "http://x", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (54, "u", "only a row"), (54, "u", "another")]


@pytest.mark.parametrize("range_bytes", [37, 1000, 32 << 20])
def test_archives_read_back_whole(spark, range_bytes):
    rows = page_rows()
    pages = wide(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    files = warc.write(pages, new_folder(spark, "warc"), max_file_bytes=20_000)
    if range_bytes < 1000:
        files = files.filter("length < 20000")
    got = warc.read(files, range_bytes).collect()
    assert len(got) == sum(f.records for f in files.collect())
    assert len({(r.path, r.offset) for r in got}) == len(got)
    assert all(r.digest_ok is not False for r in got)
    if range_bytes < 1000:
        return
    assert len(got) == len(rows)
    held = {(r.record_id, r.payload_digest): bytes(r.payload) for r in got if r.record_type == "response"}
    whole = []
    for r in got:
        page_id = re.fullmatch(r"<urn:page:(.+)>", r.record_id)[1]
        payload = r.payload if r.payload is not None else held[r.refers_to, r.payload_digest]
        assert r.payload_bytes == len(payload)
        whole.append((page_id, bytes(payload)))
    assert sorted(whole) == sorted(("null" if i is None else str(i), (h or "").encode()) for i, _, h in rows)


def test_revisits_refer_to_the_largest_id(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read(warc.write(pages, new_folder(spark, "warc"))).collect()
    ids = {}
    for i, _, h in rows:
        ids.setdefault(warc.base32_sha1((h or "").encode()), []).append(i)
    for r in got:
        last = max((i for i in ids[r.payload_digest] if i is not None), default=None)
        assert (r.record_type == "response") == (r.record_id == warc.urn(last))
        assert r.refers_to == (None if r.record_type == "response" else warc.urn(last))
    long = warc.read(warc.write(pages, new_folder(spark, "warc"), min_revisit_bytes=1000)).collect()
    assert all(r.record_type == "response" or r.payload_bytes >= 1000 for r in long)


def test_archives_are_plain_gzip_and_odd_bytes_give_no_record(spark):
    members = [gzip.compress(warc.record(i, "u", b"x" * i, None, False, "d")) for i in range(5)]
    inner = gzip.compress(b"not an archive")
    blob = b"junk" + members[0] + inner + members[1] + warc.MAGIC + b"zz" + b"".join(members[2:]) + members[1][:-9]

    class File:
        def read_at(self, n, at):
            return blob[at : at + n]

    whole = [r[3] for r in warc.records_in(File(), "p", len(blob), 0, len(blob))]
    assert whole == [warc.urn(i) for i in range(5)]
    cuts = [r[3] for a in range(0, len(blob), 11) for r in warc.records_in(File(), "p", len(blob), a, a + 11)]
    assert cuts == whole
    assert gzip.GzipFile(fileobj=io.BytesIO(b"".join(members))).read().count(b"WARC/1.1") == 5


def test_long_addresses_are_read_and_lost_records_are_an_error(spark, tmp_path):
    rng = random.Random(6)
    urls = ["http://x/" + "".join(chr(rng.randint(33, 126)) for _ in range(n)) for n in (10, 66_000, 200_000)]
    rows = [(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write(pages, new_folder(spark, "warc"))
    assert sorted(r.target_uri for r in warc.read(files).collect()) == sorted(urls)
    with pytest.raises(RuntimeError, match="2 records read, 3 written"):
        warc.complete(warc.read(files).limit(2), files)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op1_warc_round_trip"](spark, str(tmp_path)).count() == 3


def test_archives_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages, new_folder(spark, "warc"))).count() == 0


@pytest.mark.parametrize("name", ["op1_warc_round_trip", "op8_exact_topk"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert canon(QUERIES[name](spark, SF).toPandas()) == canon(con.execute(ORACLE[name]).df())


# Language ID


def test_languages_of_held_out_rows(spark, docs):
    model = langid.fit(docs)
    got = langid.predict(docs, model, ["doc_id", "text", "lang", "rid"]).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "fr", "de") and 0 <= r.score <= 1
    held = [r for r in got if r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang and r.lang_pred != "und"]
    assert len(held) > 5 and sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert not any(r.rejected for r in got if r.doc_id is not None and r.doc_id < 60)


def test_far_off_texts_are_rejected_and_rows_kept(spark, docs):
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "漢字仮名交文" * 30), (2, "the there other in")], "doc_id int, text string")
    assert [r.rejected for r in langid.predict(odd, model, ["doc_id"]).orderBy("doc_id").collect()] == [True, False]
    assert langid.accepted(odd.withColumn("__t", F.lit(3)).withColumn("score", F.lit(1)), model).collect()[0].asDict() == {
        "doc_id": 2, "text": "the there other in", "__t": 3, "score": 1}


def test_foreign_texts_and_noise_of_any_length_are_rejected(spark):
    docs = spark.createDataFrame(data.documents(240)[:240], data.DOCS)
    rng = random.Random(4)
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem".split()
    letters = lambda abc: "".join(rng.choice(abc) for _ in range(rng.randint(2, 9)))
    odd = [" ".join(rng.choice(polish) for _ in range(n)) for n in (20, 300)]
    odd += [" ".join(letters("bcdfghjklmnpqrstvwxz") for _ in range(n)) for n in (40, 3000)]
    odd += [base64.b64encode(rng.randbytes(n)).decode() for n in (600, 6000)]
    odd += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n)) for n in (30, 3000)]
    own = [data.prose(rng, lang, n) for lang in data.SYLLABLES for n in (2, 5, 30, 400, 3000)] + ["There " * 500]
    rows = spark.createDataFrame(list(enumerate(odd + own)), "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in langid.predict(rows, langid.fit(docs), ["doc_id"]).collect()}
    assert [got[i] for i in range(len(rows.collect()))] == [True] * len(odd) + [False] * len(own)


def test_limits_come_from_all_rows(spark):
    """One text in a hundred is partly foreign: the limits hold for these also where the clustering sees few rows."""
    rng = random.Random(8)
    odd = lambda: data.prose(rng, "de", 30) + " " + data.prose(rng, "en", 20)
    rows = [(i, odd() if i % 100 == 7 else data.prose(rng, "en", 50), "en") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs, max_fit_rows=20, clusters=2)
    seen: dict[tuple[int, int], list[float]] = {}
    for i, text, _ in rows:
        if crc32(str(i).encode()) % 5:
            for part in [text[:n] for n in langid.BEGINNINGS if n < len(text)] + [text]:
                tf = langid.counts(part)
                cos = model.centroids @ langid.normalised(tf, model.idf)
                seen.setdefault((int(cos.argmax()), langid.band(tf)), []).append(float(cos.max()))
    full = {k: v for k, v in seen.items() if len(v) >= langid.FEW}
    assert len(full) > 4
    for (j, b), cosines in full.items():
        at = 0.005 * (len(cosines) - 1)
        low, high = sorted(cosines)[int(at)], sorted(cosines)[int(at) + 1]
        assert model.least[j, b] == pytest.approx(0.5 * (low + (high - low) * (at - int(at))), abs=1 / langid.STEPS)


def test_outliers_take_no_centroid():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(1)
    x = np.abs(np.concatenate([np.eye(40)[i] + rng.normal(0, 0.01, (50, 40)) for i in range(4)] + [np.eye(40)[20:24]]))
    c = langid.spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), 4)
    assert sorted(np.argmax(c, axis=1).tolist()) == [0, 1, 2, 3]


def test_language_is_no_input(spark, docs):
    model = langid.fit(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None))
    as_rows = lambda d: sorted(map(str, langid.predict(d, model, ["text"]).collect()))
    assert as_rows(docs) == as_rows(other)


def test_nothing_to_learn_from(spark, docs):
    model = langid.fit(docs.filter("false"))
    assert {r.lang_pred for r in langid.predict(docs, model, ["doc_id"]).collect()} == {"und"}
    machine = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, machine, ["doc_id"]).collect()} == {0.0}


# Sentence pieces


def test_ids_and_texts_are_the_librarys(spark, docs):
    sp = pieces.encoder(MODEL).library
    got = pieces.encode_decode(docs, ["doc_id", "text", "size"], MODEL, keep_ids=True).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = sp.encode(r.text or "", add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_agenda_equals_library_on_noise():
    own = pieces.Encoder(MODEL, max_parts=50)
    rng = random.Random(5)
    alphabet = "abcdeE  \n\t▁éß漢😀<s>0x\x00.,'thin"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(400)] + [" ", "a" * 3000, "</s> <0x0A>"]
    for at in range(0, len(texts), 37):
        some = texts[at : at + 37]
        for t, (said, ids) in zip(some, own.encode(some), strict=True):
            assert ids == own.library.encode(t, add_eos=True), t
            assert said == " ".join(map(str, ids))
    for t in texts:
        symbols = [own.symbol_of.get(c, own.other) for c in t]
        assert own._merged_short(list(symbols)) == own._merged_long(list(symbols))


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id per id, linking fingerprints two by two."""
    at = {i: i for i in prints}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                at[max(x, y)] = min(x, y)
    return {i: top(i) for i in prints}


def test_fingerprints_and_groups(spark, docs):
    got = simhash.grouped(docs, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.fp & (1 << 64) - 1 == plain_fingerprint(r.text)
    known = {r.doc_id: r.fp for r in got if r.doc_id is not None}
    want = plain_components(known)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)


@pytest.mark.parametrize("max_bucket", [1, 3, 1000])
def test_links_are_complete_for_any_bucket_size(spark, max_bucket):
    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(25)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints] + [0, -1]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(df, max_bucket=max_bucket)).collect()}
    want = plain_components({p: p & (1 << 64) - 1 for p in signed})
    assert {p: roots.get(p, p) for p in signed} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(7, 7), (700, 701), (701, 700)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 600)} | {700: 700, 701: 700}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    known = simhash.grouped(docs, ["doc_id"]).collect()
    assert len(rows) == len({r.root for r in known})
    assert {r.doc_id for r in rows if r.doc_id is not None} == {r.component_id for r in known if r.doc_id is not None}
    assert simhash.one_of_each(docs.filter("false")).count() == 0


def test_near_copies_of_five_word_shingles_go(spark):
    rng = random.Random(8)
    line = " licensed under the usual terms of this one and the same licence"
    rows, changed = [], lambda ws, n: [rng.choice("qxzv") * 4 if k in hit else w for hit in [set(rng.sample(range(len(ws)), n))] for k, w in enumerate(ws)]  # noqa: E501
    for size in (12, 60, 150, 400):
        base = data.prose(rng, "en", size).split()
        rows += [" ".join(changed(base, n)) + line * (n % 2) for n in (0, 1, 2, 3, 4, 6, 8, 12)]
    crowd = data.prose(rng, "fr", 100).split()
    rows += [" ".join(changed(crowd, rng.randint(1, 3))) for _ in range(60)]
    rows += ["", None, " ", "a b", "A  b", line, line * 2] + [data.prose(rng, "de", 30) + line for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(rows)) + [(None, rows[0])], "doc_id long, text string")
    words = [(t or "").lower().split() for t in rows]
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    top = list(range(len(rows)))
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = top[i], top[j]
                top = [min(x, y) if k in (x, y) else k for k in top]
    kept = corpus_pipeline.near_duplicates(spark, wide(docs), "")
    assert kept.columns == wide(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(top))
    assert len(set(top)) < len(rows) - 20
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), "").count() == 0


# Top-k


def test_topk_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.random() - 0.5]) for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, [0.1, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [0.5] * 8)]
    rows += [(304, rows[7][1]), (304, rows[7][1]), (305, []), (306, [0.5])]
    df = wide(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.search(df, F.col("id") % 50 == 0, block_rows=64, query_rows=3).collect()
    ok = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < 9 for x in v)]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.search(df.filter("false"), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("n", range(1, 8))
def test_topk_of_tiny_tables(spark, n):
    rows = [(50 * i, [0.25 * i, 0.5]) for i in range(n)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).collect()
    want = []
    for q, v in rows:
        scored = sorted((-int(sum(65536 * a * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_lists_are_not_read_to_the_end():
    np = pytest.importorskip("numpy")
    v = np.zeros((960, 4))
    v[:5] = 200 - np.arange(5)[:, None]
    found = topk.read_lists(np.ones((1, 4)), np.array([-1]), v, np.arange(960), 5)
    assert found == [[(j, 4 * (200 - j)) for j in range(5)]]


# Toxicity


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = data.prose(rng, "en", 60).split()
        if toxic:
            words[5] = rng.choice(["idiot", "Moron,", "scumbag", "scumlike", "scumish"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "idiot", "x"), (3, rows[3][1], "x")]
    labels += [(None, 1), (901, None), (5, 0), (5, 0)]
    docs = wide(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    machine = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, machine, ["doc_id", "key"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.95 * len(held)


def test_pairs_count_where_single_terms_do_not():
    np = pytest.importorskip("numpy")
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]] * 50, "float32")
    y = np.array([0, 0, 0, 1] * 50, "float32")
    bias, w, v = toxicity.train(x, y, 4, 600, 0.05, 0.0)
    score = lambda a: bias + a @ w + 0.5 * (((a @ v) ** 2) - (a @ v**2)).sum()
    assert score(np.array([1, 1])) > 0 > max(score(np.array([1, 0])), score(np.array([0, 1])))
    assert (v[0] * v[1]).sum() > 0.5
