"""Queries of the operators that run Python on Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.llm import clustering, langid, pieces, simhash, topk, toxicity, warc, whitening
from ticklens.llm.common import new_folder, query, remainder, table


@query("op7_simhash_groups")
def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash.grouped(docs, ["doc_id"]).select("doc_id", hexed.alias("fingerprint"), "component_id")


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_decode(docs, ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), langid.FOLDS) == 0, F.lit(False)).alias("held_out")
    predicted = langid.predict(docs, langid.fit(docs), ["doc_id"])
    return predicted.select("doc_id", held_out, "lang_pred", "score", "rejected")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.coalesce(remainder(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT, F.lit(False)).alias("held_out")
    return toxicity.score(docs, machine, ["doc_id"]).select("doc_id", held_out, "score", "predicted")


OP8_SQL = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op8_exact_topk", OP8_SQL)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


_SHA = "sha1(coalesce(html, ''))"
OP1_SQL = f"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_SHA} AS h,
           max(page_id) OVER (PARTITION BY {_SHA}) AS last
    FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '')
           AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
"""


@query("op1_warc_round_trip", OP1_SQL)
def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    found = warc.read(files, payloads=False).select(
        warc.id_in("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.id_in("refers_to").alias("refers_to"),
    )
    return warc.complete(found, files)


def _round_sql(r: int) -> str:
    """One round of the check: every vector's nearest centroid, then the floors of the means."""
    return f"""
a{r} AS MATERIALIZED (
    SELECT rid, arg_min(c, (far, c)) AS c, min(far) AS far
    FROM (SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (e[i] - m[i]) * (e[i] - m[i])))::BIGINT AS far
          FROM v, c{r}) GROUP BY rid),
m{r} AS (
    SELECT c, list(s ORDER BY i) AS m
    FROM (SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS s
          FROM (SELECT a{r}.c, unnest(range(64)) AS i, unnest(e) AS x FROM a{r} JOIN v USING (rid)) GROUP BY c, i)
    GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (c)),"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e AS m
    FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT 40)),
{"".join(_round_sql(r) for r in range(5))}
last AS (
    SELECT rid, arg_min(c, (far, c)) AS c, min(far) AS far
    FROM (SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (e[i] - m[i]) * (e[i] - m[i])))::BIGINT AS far
          FROM v, c5) GROUP BY rid)
SELECT vec_id, c::INT AS cluster, far AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM last JOIN c5 USING (c) JOIN v USING (rid)
"""


@query("op11_heap_clusters", OP11_SQL)
def op11_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustering.cluster(table(spark, sf_dir, "embeddings"))
    return clustering.digest(rows, centroids).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, dims = whitening.rows_of(table(spark, sf_dir, "embeddings"))
    machine, distinct = whitening.fit(rows, dims)
    return whitening.whiten(rows, machine, whitening.identity_error(distinct, machine))
