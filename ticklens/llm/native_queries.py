"""Queries of the operators that are built of DataFrame functions alone, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.llm import licenses, mixing, quality, secrets, sharding
from ticklens.llm.common import query, table
from ticklens.session import cut_lineage

# DuckDB reads \x escapes in its patterns as Java does.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws.split()}))


def _broken(rules: tuple[quality.Rule, ...]) -> str:
    """The rule table as an SQL condition."""
    parts = [f"{r.measure} < {r.least}" for r in rules if r.least is not None]
    return " OR ".join(parts + [f"{r.measure} > {r.most}" for r in rules if r.most is not None])


OP9_SQL = rf"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w, coalesce(text, '') AS t,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
g AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n
    FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
          FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
r AS (SELECT rid, count(DISTINCT i + j) AS n FROM g, (VALUES (0), (1), (2)) AS o(j) WHERE n > 1 GROUP BY rid),
m AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS nl,
           len(list_intersect(w, [{_STOP}])) AS stop_words,
           len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered,
           len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
           len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses
    FROM d LEFT JOIN r USING (rid)),
q AS (
    SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_length,
           CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_ratio,
           CASE WHEN nl > 0 THEN n_dup_lines::DOUBLE / nl ELSE 0 END AS dup_line_ratio,
           CASE WHEN nl > 0 THEN bullets::DOUBLE / nl ELSE 0 END AS bullet_line_ratio,
           CASE WHEN nl > 0 THEN ellipses::DOUBLE / nl ELSE 0 END AS ellipsis_line_ratio,
           CASE WHEN n_words > 0 THEN (n_words - lettered)::DOUBLE / n_words ELSE 0 END AS bare_word_ratio,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_broken(quality.RULES)}) AS kept
FROM q
"""


@query("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", *quality.MEASURES, "base_failed", "kept")


_LICENSE_ROWS = licenses.values(licenses.template_rows(licenses.PHRASES, licenses.NOTICES))
OP3_SQL = rf"""
WITH t AS (
    SELECT * FROM (VALUES {_LICENSE_ROWS}) AS v(tid, label, exact, t_words, t_grams, t_pos, g0, g1, g2)),
d AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
h AS (
    SELECT rid, tid, label, exact, t_words, t_grams, t_pos, p, p - t_pos AS diagonal
    FROM (SELECT rid, i - 1 AS p, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
          FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)) g
    JOIN t ON g0 = a AND g1 = b AND g2 = c),
v AS (
    SELECT rid, tid, diagonal,
           CASE WHEN any_value(exact) OR diagonal - lag(diagonal) OVER (PARTITION BY rid, tid ORDER BY diagonal) <= 4
                THEN 0 ELSE 1 END AS apart
    FROM h GROUP BY rid, tid, diagonal),
i AS (SELECT rid, tid, diagonal, sum(apart) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS island FROM v),
s AS (
    SELECT rid, label, exact, min(p) AS lo, max(p) + 3 AS hi, t_words, t_grams,
           count(DISTINCT t_pos)::DOUBLE / t_grams AS cover
    FROM h JOIN i USING (rid, tid, diagonal)
    GROUP BY rid, tid, label, exact, t_words, t_grams, CASE WHEN exact THEN diagonal ELSE island END),
f AS (
    SELECT * FROM s
    WHERE CASE WHEN exact THEN cover = 1 ELSE cover >= 0.75 AND 2 * (hi - lo) <= 3 * t_words END),
a AS (
    SELECT rid, count(*) FILTER (exact) AS n_base, min(lo) FILTER (exact) AS first_word,
           max(lo) FILTER (exact) AS last_word, max(cover) AS score,
           array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
    FROM f GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (rid)
"""


@query("op3_license_scan", OP3_SQL)
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.digest(licenses.scan(docs, ["doc_id"]))


def _places(kind: int, pattern: str, group: int) -> str:
    """Matches of one kind with their places, from the pieces between them."""
    p = pattern.replace("'", "''")
    return rf"""
    SELECT rid, doc_id, source, {kind} AS kind, v[i] AS v, length(m[i]) AS n,
           list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)
               AS lo
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
          FROM (SELECT rid, doc_id, source, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m,
                       regexp_extract_all(t, '{p}', {group}) AS v
                FROM d WHERE regexp_matches(t, '{p}')))"""


OP2_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS MATERIALIZED (
    SELECT rid, doc_id, source, kind, v, lo, lo + n AS hi
    FROM ({_places(0, secrets.ASSIGN, 2)} UNION ALL {_places(1, secrets.ACCESS, 0)}
          UNION ALL {_places(2, secrets.HEX, 0)} UNION ALL {_places(3, secrets.TOKEN, 0)})
    WHERE CASE kind WHEN 0 THEN length(v) >= 12
               WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
               ELSE true END),
s AS MATERIALIZED (
    SELECT * FROM c
    WHERE kind < 3 OR NOT EXISTS (
        SELECT 1 FROM c b WHERE b.rid = c.rid AND b.kind < 3 AND b.lo < c.hi AND c.lo < b.hi)),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS n_owners,
             count(DISTINCT (coalesce(source, chr(0)), coalesce(doc_id::VARCHAR, ''))) AS n_repos FROM s GROUP BY v),
l AS (SELECT *, n_owners < {secrets.EXAMPLE_OWNERS} AND n_repos < {secrets.EXAMPLE_REPOS} AS live FROM o),
j AS (SELECT s.*, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || lo::BIGINT || ':' || hi::BIGINT AS said,
             l.* EXCLUDE (v)
      FROM s JOIN l USING (v) WHERE kind < 3 OR live),
f AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
             count(*) FILTER (kind = 2) AS n_hex, string_agg(said, ',' ORDER BY lo, kind) FILTER (kind < 3) AS base,
             string_agg(said, ',' ORDER BY lo, kind) AS spans, count(*) FILTER (live) AS n_live,
             count(*) FILTER (NOT live) AS n_examples, string_agg(n_owners, ',' ORDER BY lo, kind) AS n_owners,
             string_agg(n_repos, ',' ORDER BY lo, kind) AS n_repos
      FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_examples, 0)::BIGINT AS n_examples,
       coalesce(n_owners, '') AS n_owners, coalesce(n_repos, '') AS n_repos
FROM d LEFT JOIN f USING (rid)
"""


@query("op2_secret_scan", OP2_SQL)
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.digest(secrets.scan(docs, ["doc_id"]))


OP5_SQL = r"""
WITH d AS MATERIALIZED (
    SELECT doc_id, '0' || source AS s0, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
    FROM documents),
r AS (SELECT doc_id, coalesce(s0, '1') AS s, size, key FROM d),
g AS (SELECT s, sum(size)::BIGINT AS source_size,
             [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT] AS w,
             ((row_number() OVER (ORDER BY s) - 1) % 3)::INT AS turn
      FROM r GROUP BY s),
q AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS ratio FROM g),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, s
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(w) OVER (ORDER BY ratio, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM q),
t AS (SELECT s, source_size, turn,
             CASE WHEN ratio > level
                  THEN w * (SELECT arg_min(level, (ratio, s)) FROM l WHERE ratio > level) ELSE cap END AS target
      FROM l),
a AS (SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS want, turn,
             coalesce(sum(size) OVER (PARTITION BY s ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 ::BIGINT AS off
      FROM r JOIN t USING (s))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (greatest(least(want - off, size), 0) + greatest(least(want - source_size - off, size), 0)
        + greatest(least(want - 2 * source_size - off, size), 0))::BIGINT AS taken,
       CASE WHEN greatest(least(want - off, size), 0) > 0 THEN
            CASE turn WHEN 0 THEN 2 * (off::DOUBLE / want * 5) / (3 + sqrt(9.0::DOUBLE + 8 * (off::DOUBLE / want * 5)))
                      WHEN 1 THEN 2 * (off::DOUBLE / want * 2) / 4
                      ELSE 2 * (off::DOUBLE / want * 1) / (1.5 + sqrt(2.25::DOUBLE - 2 * (off::DOUBLE / want * 1))) END END
           AS position
FROM a
"""


@query("op5_mix_sources", OP5_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    narrow = cut_lineage(docs.drop("text"))
    return mixing.mix(narrow).select("doc_id", "size", "source_size", "target", "taken", "position")


OP13_SQL = """
WITH RECURSIVE tab AS (
    SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
    FROM range(256) r(b)),
d AS MATERIALIZED (
    SELECT doc_id, md5(coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h
    FROM documents),
r AS MATERIALIZED (
    SELECT doc_id, key, n + 8 AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || key) AS ord,
           xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(range(n), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
               lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS crc
    FROM d, tab),
g AS MATERIALIZED (SELECT key, sum(size)::BIGINT AS size FROM r GROUP BY key),
o AS (
    SELECT key, size, row_number() OVER (ORDER BY size DESC, key) - 1 AS i,
           sum(size) OVER (ORDER BY size DESC, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM g),
alone AS MATERIALIZED (
    SELECT key, i FROM o WHERE i < 23 AND i < coalesce((SELECT min(i) FROM o WHERE size * (24 - i) <= rest), 24)),
e AS MATERIALIZED (
    SELECT list(key ORDER BY key) AS keys, list(size ORDER BY key) AS sizes, sum(size)::BIGINT AS total, max(size) AS big,
           24 - (SELECT count(*) FROM alone) AS k
    FROM g WHERE key NOT IN (SELECT key FROM alone)),
search AS (
    SELECT greatest((total + k - 1) // k, big)::BIGINT AS low, (greatest((total + k - 1) // k, big) + big)::BIGINT AS high FROM e
    UNION ALL
    SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END
    FROM (SELECT low, high, middle, list_reduce(
              list_prepend([1, 0]::BIGINT[], list_transform(sizes, lambda s: [0, s]::BIGINT[])),
              lambda a, x: CASE WHEN a[2] + x[2] <= middle THEN [a[1], a[2] + x[2]]::BIGINT[] ELSE [a[1] + 1, x[2]]::BIGINT[] END)[1] <= k
              AS fits
          FROM (SELECT low, high, (low + high) // 2 AS middle FROM search WHERE low < high), e)),
c AS (SELECT min(high) AS cap FROM search),
back AS (
    SELECT list_reduce(
        list_prepend([0, 0]::BIGINT[], list_transform(list_reverse(sizes), lambda s: [s]::BIGINT[])),
        lambda a, x: CASE WHEN a[2] + x[1] - a[1] <= cap THEN list_concat([a[1], a[2] + x[1]]::BIGINT[], a[3:])
                          ELSE list_concat([a[2], a[2] + x[1]]::BIGINT[], a[3:], [a[2]]::BIGINT[]) END)[3:] AS ends
    FROM e, c),
cuts AS (
    SELECT list_transform(list_reduce(
        list_prepend([1, 0, 0]::BIGINT[], list_transform(range(len(sizes)), lambda i: [i + 1, sizes[i + 1]]::BIGINT[])),
        lambda a, x: CASE WHEN a[1] < k AND a[3] > a[2] AND (a[3] - a[2] + x[2] > cap
                OR (2 * (total - a[2]) <= (2 * (a[3] - a[2]) + x[2]) * (k - a[1] + 1)
                    AND a[3] >= total - CASE WHEN k - a[1] > len(ends) THEN total ELSE ends[k - a[1]] END))
            THEN list_concat([a[1] + 1, a[3], a[3] + x[2]]::BIGINT[], a[4:], [x[1]]::BIGINT[])
            ELSE list_concat([a[1], a[2], a[3] + x[2]]::BIGINT[], a[4:]) END)[4:], lambda i: keys[i]) AS firsts
    FROM e, c, back),
s AS (
    SELECT r.*, coalesce(a.i, (SELECT count(*) FROM alone) + (SELECT len(list_filter(firsts, lambda f: f <= r.key)) FROM cuts)) AS shard
    FROM r LEFT JOIN alone a ON a.key = r.key)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY ord) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM s
"""


@query("op13_minimax_shards", OP13_SQL)
def op13_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.sized(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = sharding.sharded(cut_lineage(docs.drop("text")))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
