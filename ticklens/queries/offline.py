"""Registered queries: labels, costs, split, back-test metrics, calibration, texts, data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticklens.config import HORIZONS_MS, SplitConfig
from ticklens.functions.cost import costs_both_profiles, impact_bps
from ticklens.functions.numeric import rnd
from ticklens.functions.text import numbers_in_text, reason_text_ok
from ticklens.operators import asof, calibration, explain, labels, metrics, normalize, split
from ticklens.queries.common import F, LC, S, flag, joined, load, query, tape_of
from ticklens.sources.writers import dataset_metadata

TAPE = "WITH " + S.TAPE

# --- labels -----------------------------------------------------------------------------

_EDGES = ", ".join(f"('{h}', '{p}', {x}::DOUBLE)" for h, p, x in LC.min_edge_bps)
_HZ = ", ".join(f"('{h}', {ms})" for h, ms in HORIZONS_MS.items())

_LABELS = (
    "WITH RECURSIVE "
    + S.TAPE
    + f""", bk AS MATERIALIZED (SELECT symbol, ts, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask FROM tape WHERE NOT is_trade AND bid > 0 AND ask > 0 GROUP BY 1, 2),
    ends AS (SELECT symbol, max(ts) - {LC.lookahead_ms} AS end_ts FROM bk GROUP BY 1 HAVING max(ts) - {LC.lookahead_ms} > min(ts)),
    b AS MATERIALIZED (SELECT bk.* FROM bk JOIN ends USING (symbol) WHERE ts <= end_ts),
    kept AS (SELECT symbol, min(ts) AS ts FROM b GROUP BY 1
      UNION ALL SELECT b.symbol, min(b.ts) FROM kept k JOIN b ON b.symbol = k.symbol AND b.ts >= k.ts + {LC.sample_interval_ms} GROUP BY b.symbol, k.ts),
    smp AS (SELECT b.symbol, b.ts, bid, ask, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) * 10000 AS spread FROM b JOIN kept USING (symbol, ts)),
    fut AS (SELECT s.symbol, s.ts, any_value(s.mid) AS mid, any_value(s.spread) AS spread, count(*) AS n,
      {", ".join(f"max(price) FILTER (p.ts <= s.ts + {ms}) AS hi_{h}, min(price) FILTER (p.ts <= s.ts + {ms}) AS lo_{h}" for h, ms in HORIZONS_MS.items())}
      FROM smp s JOIN tape p ON p.symbol = s.symbol AND p.is_trade AND p.ts BETWEEN s.ts AND s.ts + {LC.lookahead_ms} GROUP BY 1, 2),
    hz(horizon, h) AS (VALUES {_HZ}), edge(horizon, profile, x) AS (VALUES {_EDGES}),
    lng AS (SELECT f.symbol, f.ts, e.horizon, e.profile, e.x, mid, spread,
      CASE e.horizon WHEN '30s' THEN hi_30s WHEN '2m' THEN hi_2m ELSE hi_5m END AS hi,
      CASE e.horizon WHEN '30s' THEN lo_30s WHEN '2m' THEN lo_2m ELSE lo_5m END AS lo,
      spread + CASE e.profile WHEN 'a' THEN 2 ELSE 4 END AS cost FROM fut f, edge e),
    lab AS (SELECT symbol, ts, horizon, profile, x, spread, cost,
      greatest((greatest(coalesce(hi, mid), mid) - mid) / mid * 10000, 0) AS mfe,
      greatest((mid - least(coalesce(lo, mid), mid)) / mid * 10000, 0) AS mae FROM lng),
    labels_long AS (SELECT symbol, ts, horizon, profile, mfe, mae, cost, mfe - cost AS net_edge, (spread <= 10)::INT AS gates_passed,
      CASE WHEN spread > 10 THEN 'SPREAD_GATE' ELSE '' END AS gate_failures, (mfe - cost >= x AND spread <= 10)::INT AS i_tradeable FROM lab),
    tox AS (SELECT symbol, ts, mid, spread, greatest((mid - least(coalesce(lo_30s, mid), mid)) / mid * 10000, 0) AS severity FROM fut)"""
)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.build_labels(tape_of(spark, sf), LC)


@query(
    "labels_long",
    _LABELS + f""" SELECT symbol, ts, horizon, profile, {S.rnd("mfe", 6)} AS mfe_bps, {S.rnd("mae", 6)} AS mae_bps, {S.rnd("cost", 6)} AS cost_bps,
    {S.rnd("net_edge", 6)} AS net_edge_bps, gates_passed, gate_failures, i_tradeable FROM labels_long""",
)
def labels_long(spark: SparkSession, sf: str) -> DataFrame:
    rows = labels.labels_long(_labels(spark, sf))
    r6 = {c: rnd(F.col(c), 6) for c in ("mfe_bps", "mae_bps", "cost_bps", "net_edge_bps")}
    return rows.withColumns(
        {**r6, "gates_passed": flag(F.col("gates_passed")), "gate_failures": joined("gate_failures")}
    )


@query(
    "labels_wide",
    _LABELS + f""" SELECT symbol, ts, {", ".join(
        f"{S.rnd(f'''max(net_edge) FILTER (horizon = '{h}' AND profile = '{p}')''', 6)} AS net_edge_bps_{h}_{p}, max(i_tradeable) FILTER (horizon = '{h}' AND profile = '{p}') AS i_tradeable_{h}_{p}"
        for h in HORIZONS_MS for p in ("a", "b"))} FROM labels_long GROUP BY 1, 2""",
)
def labels_wide(spark: SparkSession, sf: str) -> DataFrame:
    w = labels.labels_wide(_labels(spark, sf))
    cols = []
    for h in HORIZONS_MS:
        for p in ("a", "b"):
            cols.append(rnd(F.col(f"net_edge_bps_{h}_{p}"), 6).alias(f"net_edge_bps_{h}_{p}"))
            cols.append(F.col(f"i_tradeable_{h}_{p}"))
    return w.select("symbol", "ts", *cols)


@query(
    "toxicity",
    _LABELS + f" SELECT symbol, ts, {S.rnd('mid', 4)} AS mid_price, (severity > 10)::INT AS y_toxic, {S.rnd('severity', 6)} AS severity_toxic_bps FROM tox",
)
def toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select(
        "symbol",
        "ts",
        rnd(F.col("mid_price"), 4).alias("mid_price"),
        "y_toxic",
        rnd(F.col("severity_toxic_bps"), 6).alias("severity_toxic_bps"),
    )


@query(
    "label_summary",
    _LABELS + f""" SELECT horizon, profile, count(*) AS n, sum(i_tradeable)::BIGINT AS positives, {S.rnd("sum(i_tradeable) * 100.0::DOUBLE / count(*)", 6)} AS percent
    FROM labels_long GROUP BY 1, 2
    UNION ALL SELECT 'toxic', '-', count(*), sum((severity > 10)::INT)::BIGINT, {S.rnd("sum((severity > 10)::INT) * 100.0::DOUBLE / count(*)", 6)} FROM tox""",
)
def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_summary(_labels(spark, sf)).withColumn("percent", rnd(F.col("percent"), 6))


@query(
    "future_prices",
    TAPE + """ SELECT b.symbol, b.ts, max(p.price) AS hi, min(p.price) AS lo FROM (SELECT DISTINCT symbol, ts FROM tape WHERE NOT is_trade) b
    LEFT JOIN tape p ON p.symbol = b.symbol AND p.is_trade AND p.ts BETWEEN b.ts AND b.ts + 45000 GROUP BY 1, 2""",
)
def future_prices(spark: SparkSession, sf: str) -> DataFrame:
    t = tape_of(spark, sf)
    samples = t.filter("NOT is_trade").select("symbol", "ts").distinct()
    trades = t.filter("is_trade").select("symbol", "ts", "price")
    return asof.future_prices(samples, trades, 45_000).select("symbol", "ts", "hi", "lo")


# --- costs ------------------------------------------------------------------------------

_BOOKS = """WITH lv AS (SELECT l_orderkey AS id, l_linenumber, floor(l_extendedprice * 100 / l_quantity) AS price, l_quantity AS qty FROM lineitem),
    srt AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY price, qty, l_linenumber) AS i FROM lv),
    cum AS (SELECT *, coalesce(sum(price * qty) OVER w, 0) AS used, coalesce(sum(qty) OVER w, 0) AS qty_before
      FROM srt WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT o_orderkey AS id, floor(o_totalprice * 50) AS usd FROM orders),
    best AS (SELECT id, min(price) AS ask FROM lv GROUP BY 1),
    take AS (SELECT c.*, o.usd, CASE WHEN price * qty >= usd - used THEN (usd - used) / price ELSE qty END AS got FROM cum c JOIN o USING (id) WHERE usd - used > 0),
    tot AS (SELECT id, any_value(usd) AS usd, arg_max(qty_before + got, i) AS q, arg_max(used + got * price, i) AS cost FROM take GROUP BY 1),
    imp AS (SELECT o.id, ask, o.usd, CASE WHEN o.usd <= 0 THEN 0 WHEN q IS NULL OR q <= 0 THEN 100
      ELSE least(greatest((cost / q - (ask - 1)) / (ask - 1) * 10000, 0), 100) END AS impact FROM o LEFT JOIN best b USING (id) LEFT JOIN tot t USING (id))"""


def _book_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Per order: its lines (seven at most) as ask levels, and an amount to fill."""
    lv = F.struct(
        F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double").alias("price"),
        F.col("l_quantity").alias("qty"),
        "l_linenumber",
    )
    asks = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_list(lv)).alias("asks")
    )
    o = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") * 50).cast("double").alias("usd")
    )
    rows = o.join(asks, "id", "left").withColumn("asks", F.coalesce("asks", F.array().cast(asks.schema["asks"].dataType)))
    return rows.withColumn("ask", F.get("asks", F.lit(0))["price"])


@query("book_impact", _BOOKS + f" SELECT id, usd, {S.rnd('impact', 4)} AS impact_bps FROM imp")
def book_impact(spark: SparkSession, sf: str) -> DataFrame:
    rows = _book_rows(spark, sf)
    imp = impact_bps(F.col("asks"), F.col("ask") - 1, F.col("usd"))
    return rows.select("id", "usd", rnd(imp, 4).alias("impact_bps"))


@query(
    "execution_costs",
    _BOOKS.replace("floor(o_totalprice * 50)", "0.01::DOUBLE * (floor(o_totalprice * 50) * 100)")
    + f""" SELECT id, p AS profile, {S.rnd("coalesce(2 / (ask - 1) * 10000, 0)", 6)} AS spread_bps, CASE p WHEN 'a' THEN 2 ELSE 4 END::DOUBLE AS fees_bps,
    {S.rnd("impact", 4)} AS impact_bps, {S.rnd("coalesce(2 / (ask - 1) * 10000, 0) + CASE p WHEN 'a' THEN 2 ELSE 4 END + impact", 4)} AS total_bps
    FROM imp, (VALUES ('a'), ('b')) v(p)""",
)
def execution_costs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _book_rows(spark, sf).withColumn("vol", F.col("usd") * 100)
    both = costs_both_profiles(F.col("ask") - 2, F.col("ask"), F.col("asks"), F.col("vol"))
    rows = rows.select("id", F.inline(both)).select("id", "profile", "costs.*")
    return rows.select(
        "id",
        "profile",
        rnd(F.col("spread_bps"), 6).alias("spread_bps"),
        "fees_bps",
        rnd(F.col("impact_bps"), 4).alias("impact_bps"),
        rnd(F.col("total_bps"), 4).alias("total_bps"),
    )


# --- split ------------------------------------------------------------------------------


def _split_sql(gap: int) -> str:
    return (
        TAPE
        + f""", r AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM tape),
        cuts AS (SELECT max(ts) FILTER (rn = floor(n * 0.7::DOUBLE)) AS a, max(ts) FILTER (rn = floor(n * {0.7 + 0.15!r}::DOUBLE)) AS b FROM r),
        parts AS (SELECT symbol, seq, ts, CASE WHEN ts <= a AND ts <= a - {gap} THEN 'train' WHEN ts > a AND ts <= b AND ts >= a + {gap} AND ts <= b - {gap} THEN 'val'
          WHEN ts > b AND ts >= b + {gap} THEN 'test' END AS part FROM tape, cuts)"""
    )


_GAP = SplitConfig(purge_gap_ms=5_000)


@query("time_split", _split_sql(0) + " SELECT symbol, seq, part FROM parts WHERE part IS NOT NULL")
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.time_split(tape_of(spark, sf)).select("symbol", "seq", "part")


@query("time_split_purged", _split_sql(5_000) + " SELECT part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM parts WHERE part IS NOT NULL GROUP BY 1")
def time_split_purged(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_summary(split.time_split(tape_of(spark, sf), _GAP))


@query(
    "split_leakage",
    _split_sql(0) + """, s AS (SELECT part, min(ts) AS lo, max(ts) AS hi FROM parts GROUP BY 1)
    SELECT (max(hi) FILTER (part = 'train') < max(lo) FILTER (part = 'val') AND max(hi) FILTER (part = 'val') < max(lo) FILTER (part = 'test'))::INT AS no_leakage FROM s""",
)
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    ok = split.verify_no_leakage(split.split_summary(split.time_split(tape_of(spark, sf))))
    return ok.select(flag(F.col("no_leakage")).alias("no_leakage"))


# --- metrics over documents and their labels --------------------------------------------

_DOCS = """WITH d AS (SELECT lang, doc_id, source, quality AS y, toxic, n_chars::DOUBLE / (n_chars + 1000) AS score, n_chars::DOUBLE AS edge FROM documents JOIN labels USING (doc_id)),
    pairs AS (SELECT a.lang, sum(CASE WHEN a.score >= b.score THEN 1 ELSE 0 END)::DOUBLE AS wins FROM d a JOIN d b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY 1),
    cnt AS (SELECT lang, count(*) AS n, sum(y)::BIGINT AS p FROM d GROUP BY 1),
    pos AS (SELECT *, row_number() OVER w AS i, sum(y) OVER (PARTITION BY lang ORDER BY score DESC, y DESC ROWS UNBOUNDED PRECEDING) AS tp FROM d WINDOW w AS (PARTITION BY lang ORDER BY score DESC, y DESC)),
    pr AS (SELECT lang, sum(tp / i::DOUBLE) AS s FROM pos WHERE y = 1 GROUP BY 1)"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    return load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id").select(
        "lang",
        F.col("quality").alias("y"),
        "toxic",
        (n.cast("double") / (n + 1000)).alias("score"),
        n.cast("double").alias("edge"),
        "doc_id",
    )


@query(
    "ranking_quality",
    _DOCS + f""" SELECT c.lang, c.n AS n_samples, c.p AS n_positives, {S.rnd("CASE WHEN c.p = 0 OR c.p = c.n THEN 0.5 ELSE wins / (c.p::DOUBLE * (c.n - c.p)) END", 8)} AS auc,
    {S.rnd("coalesce(s / c.p, 0)", 6)} AS pr_auc FROM cnt c LEFT JOIN pairs USING (lang) LEFT JOIN pr USING (lang)""",
)
def ranking_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = metrics.ranking_quality(_docs(spark, sf), ["lang"])
    return q.withColumns({"auc": rnd(F.col("auc"), 8), "pr_auc": rnd(F.col("pr_auc"), 6)})


_BINS = ", b AS (SELECT lang, least(floor(score * 10)::INT, 9) AS bin, count(*) AS n, sum(y)::DOUBLE AS ys, sum(score) AS ss, sum((score - y) * (score - y)) AS sq FROM d GROUP BY 1, 2)"


@query(
    "calibration_error",
    _DOCS + _BINS + f""" SELECT lang, {S.rnd("sum(sq) / sum(n)", 6)} AS brier_score, {S.rnd("sum(n * abs(ys / n - ss / n)) / sum(n)", 6)} AS ece,
    {S.rnd("max(abs(ys / n - ss / n))", 6)} AS mce FROM b GROUP BY 1""",
)
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    q = metrics.calibration_error(_docs(spark, sf), ["lang"])
    return q.withColumns({c: rnd(F.col(c), 6) for c in ("brier_score", "ece", "mce")})


@query(
    "brier",
    _DOCS + f" SELECT lang, {S.rnd('avg((score - toxic) * (score - toxic))', 6)} AS brier_score FROM d GROUP BY 1",
)
def brier(spark: SparkSession, sf: str) -> DataFrame:
    q = metrics.brier(_docs(spark, sf).withColumn("y", F.col("toxic")), ["lang"])
    return q.withColumn("brier_score", rnd(F.col("brier_score"), 6))


@query(
    "reliability",
    _DOCS + _BINS + f""", f AS (SELECT lang, unnest(range(10))::INT AS bin FROM (SELECT DISTINCT lang FROM d))
    SELECT lang, bin, coalesce(n, 0) AS n, {S.rnd("coalesce(ys / n, 0)", 6)} AS accuracy, {S.rnd("coalesce(ss / n, (bin + 0.5::DOUBLE) / 10)", 6)} AS confidence FROM f LEFT JOIN b USING (lang, bin)""",
)
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    q = metrics.reliability_bins(_docs(spark, sf), ["lang"])
    return q.withColumns({c: rnd(F.col(c), 6) for c in ("accuracy", "confidence")})


@query(
    "topk_metrics",
    _DOCS + f""", t1 AS (SELECT lang, y, row_number() OVER (PARTITION BY lang ORDER BY score DESC, y DESC) AS i FROM d),
    t2 AS (SELECT lang, edge, row_number() OVER (PARTITION BY lang ORDER BY score DESC, edge DESC) AS i FROM d)
    SELECT lang, {S.rnd("CASE WHEN any_value(p) = 0 THEN 0 ELSE sum(y) / any_value(p)::DOUBLE END", 6)} AS topk_capture, {S.rnd("sum(y) / count(*)::DOUBLE", 6)} AS topk_precision,
      {S.rnd("(SELECT avg(edge) FROM t2 WHERE t2.lang = t1.lang AND i <= 20)", 6)} AS topk_mean_edge_bps FROM t1 JOIN cnt USING (lang) WHERE i <= 20 GROUP BY lang""",
)
def topk_metrics(spark: SparkSession, sf: str) -> DataFrame:
    q = metrics.topk_metrics(_docs(spark, sf), ["lang"], 20)
    return q.withColumns({c: rnd(F.col(c), 6) for c in ("topk_capture", "topk_precision", "topk_mean_edge_bps")})


_CHURN = (
    TAPE
    + """, s AS (SELECT symbol, ts // 60000 AS ts, sum(qty)::DOUBLE AS score FROM tape WHERE is_trade GROUP BY 1, 2),
    r AS (SELECT ts, symbol FROM s QUALIFY row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) <= 10),
    steps AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS was FROM (SELECT DISTINCT ts FROM r)),
    moves AS (SELECT st.ts, (SELECT count(*) FROM r a WHERE a.ts = st.ts AND a.symbol NOT IN (SELECT symbol FROM r b WHERE b.ts = st.was)) AS entered,
      (SELECT count(*) FROM r a WHERE a.ts = st.was AND a.symbol NOT IN (SELECT symbol FROM r b WHERE b.ts = st.ts)) AS exited,
      (SELECT count(*) FROM r a WHERE a.ts = st.ts AND a.symbol IN (SELECT symbol FROM r b WHERE b.ts = st.was)) AS common FROM steps st WHERE was IS NOT NULL)"""
)


def _minute_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = tape_of(spark, sf).filter("is_trade")
    minute = F.floor(F.col("ts") / 60_000).cast("long")
    return t.groupBy("symbol", minute.alias("ts")).agg(F.sum("qty").alias("score"))


@query("set_changes", _CHURN + " SELECT ts, entered, exited, common FROM moves")
def set_changes(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.set_changes(_minute_scores(spark, sf), [], 10, slice_ms=5)
    return s.select("ts", *[F.size(c).cast("long").alias(c) for c in ("entered", "exited", "common")])


@query(
    "churn",
    _CHURN + f""" SELECT {S.rnd("avg(entered + exited) / 2", 6)} AS rank_changes_per_step, {S.rnd("avg(entered + exited)", 6)} AS state_changes_per_step,
    {S.rnd("avg(common / (common + entered + exited)::DOUBLE)", 6)} AS jaccard_similarity FROM moves""",
)
def churn(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.churn(_minute_scores(spark, sf).withColumn("g", F.lit(1)), ["g"], 10, slice_ms=5).drop("g")
    return c.select(*[rnd(F.col(x), 6).alias(x) for x in c.columns])


# --- back-test on the labels ------------------------------------------------------------

_BACKTEST = """, sc AS (SELECT horizon, profile, ts, symbol, i_tradeable AS y, net_edge AS edge, least(1, greatest(0, (net_edge + 50) / 100)) AS score FROM labels_long
    UNION ALL SELECT 'toxic', '-', ts, symbol, (severity > 10)::INT, 0, least(1, greatest(0, severity / 50)) FROM tox)"""
_BT_METRICS = f""", cnt AS (SELECT horizon, profile, count(*) AS n, sum(y)::BIGINT AS p FROM sc GROUP BY 1, 2),
    srt AS (SELECT *, row_number() OVER w AS i, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM sc WINDOW w AS (PARTITION BY horizon, profile ORDER BY score DESC, y DESC)),
    rq AS (SELECT horizon, profile, sum(tp) FILTER (y = 0) AS wins, sum(tp / i::DOUBLE) FILTER (y = 1) AS prec FROM srt GROUP BY 1, 2),
    bn AS (SELECT horizon, profile, least(floor(score * 10)::INT, 9) AS bin, count(*) AS n, sum(y)::DOUBLE AS ys, sum(score) AS ss, sum((score - y) * (score - y)) AS sq FROM sc GROUP BY 1, 2, 3),
    ce AS (SELECT horizon, profile, sum(sq) / sum(n) AS brier, sum(n * abs(ys / n - ss / n)) / sum(n) AS ece, max(abs(ys / n - ss / n)) AS mce FROM bn GROUP BY 1, 2),
    tk AS (SELECT horizon, profile, sum(y) / 20.0::DOUBLE AS prec20, sum(y) AS hits FROM srt WHERE i <= 20 AND horizon <> 'toxic' GROUP BY 1, 2),
    te AS (SELECT horizon, profile, avg(edge) AS medge FROM (SELECT *, row_number() OVER (PARTITION BY horizon, profile ORDER BY score DESC, edge DESC) AS k FROM sc) WHERE k <= 20 AND horizon <> 'toxic' GROUP BY 1, 2)
    SELECT c.horizon, c.profile, c.n AS n_samples, c.p AS n_positives, {S.rnd("CASE WHEN c.p = 0 OR c.p = c.n THEN 0.5 ELSE wins / (c.p::DOUBLE * (c.n - c.p)) END", 6)} AS auc,
      {S.rnd("coalesce(prec / c.p, 0)", 6)} AS pr_auc, {S.rnd("brier", 6)} AS brier_score, {S.rnd("ece", 6)} AS ece, {S.rnd("mce", 6)} AS mce,
      {S.rnd("prec20", 6)} AS topk_precision, {S.rnd("CASE WHEN c.p = 0 THEN 0 ELSE hits / c.p::DOUBLE END", 6)} AS topk_capture, {S.rnd("medge", 6)} AS topk_mean_edge_bps
    FROM cnt c LEFT JOIN rq USING (horizon, profile) LEFT JOIN ce USING (horizon, profile) LEFT JOIN tk USING (horizon, profile) LEFT JOIN te USING (horizon, profile)"""
_BT_COLS = ("auc", "pr_auc", "brier_score", "ece", "mce", "topk_precision", "topk_capture", "topk_mean_edge_bps")


def _flat(result: DataFrame) -> DataFrame:
    return result.select(
        "horizon", "profile", "n_samples", "n_positives", *[rnd(F.col(c), 6).alias(c) for c in _BT_COLS]
    )


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from ticklens.session import cut_lineage

    lab = cut_lineage(_labels(spark, sf))  # every metric reads it
    return lab, labels.labels_long(lab)


@query("backtest_labels", _LABELS + _BACKTEST + _BT_METRICS)
def backtest_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(metrics.backtest_labels(*_both(spark, sf)))


_PROBS = """, probs AS (SELECT symbol, ts, (ts % 101) / 101.0::DOUBLE AS p30, (ts % 97) / 97.0::DOUBLE AS p2, (ts % 89) / 89.0::DOUBLE AS p5, (ts % 53) / 53.0::DOUBLE AS ptox FROM tox),
    sc AS (SELECT horizon, profile, ts, symbol, i_tradeable AS y, net_edge AS edge, CASE horizon WHEN '30s' THEN p30 WHEN '2m' THEN p2 ELSE p5 END AS score FROM labels_long JOIN probs USING (symbol, ts)
    UNION ALL SELECT 'toxic', '-', ts, symbol, (severity > 10)::INT, 0, ptox FROM tox JOIN probs USING (symbol, ts))"""


def _scores(lab: DataFrame) -> DataFrame:
    """Pseudo-probabilities of a model, one row per sample."""
    part = lambda m: (F.col("ts") % m) / float(m)
    return lab.select(
        "symbol",
        "ts",
        part(101).alias("p_inplay_30s"),
        part(97).alias("p_inplay_2m"),
        part(89).alias("p_inplay_5m"),
        part(53).alias("p_toxic"),
    )


@query("backtest_scores", _LABELS + _PROBS + _BT_METRICS)
def backtest_scores(spark: SparkSession, sf: str) -> DataFrame:
    lab, long = _both(spark, sf)
    return _flat(metrics.backtest_scores(lab, long, _scores(lab)))


@query(
    "acceptance",
    _LABELS + _BACKTEST + f""", bn AS (SELECT horizon, profile, least(floor(score * 10)::INT, 9) AS bin, count(*) AS n, sum(y)::DOUBLE AS ys, sum(score) AS ss FROM sc WHERE horizon <> 'toxic' GROUP BY 1, 2, 3),
    ce AS (SELECT horizon, profile, sum(n * abs(ys / n - ss / n)) / sum(n) AS ece FROM bn GROUP BY 1, 2)
    SELECT horizon, profile, {S.rnd("ece", 6)} AS ece, (ece < 0.05::DOUBLE)::INT AS accepted FROM ce""",
)
def acceptance(spark: SparkSession, sf: str) -> DataFrame:
    a = metrics.acceptance(metrics.backtest_labels(*_both(spark, sf)))
    return a.select("horizon", "profile", rnd(F.col("ece"), 6).alias("ece"), flag(F.col("accepted")).alias("accepted"))


# --- calibration ------------------------------------------------------------------------

_PARAMS = {"p_inplay_30s": (1.2, -0.1), "p_inplay_2m": (0.8, 0.25), "p_toxic": (1.0, -0.5)}


@query(
    "platt_apply",
    TAPE + f""", h AS (SELECT symbol, seq, head, (seq % m) / m::DOUBLE AS score FROM tape, (VALUES ('p_inplay_30s', 101), ('p_inplay_2m', 97), ('p_inplay_5m', 89), ('p_toxic', 53)) v(head, m)),
    c(head, a, b) AS (VALUES {", ".join(f"('{h}', {a}::DOUBLE, {b}::DOUBLE)" for h, (a, b) in _PARAMS.items())}),
    x AS (SELECT h.*, c.a, c.b, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, score)) AS q FROM h LEFT JOIN c USING (head))
    SELECT seq, head, {S.rnd("CASE WHEN a IS NULL THEN score ELSE 1 / (1 + exp(-(a * ln(q / (1 - q)) + b))) END", 7)} AS calibrated FROM x""",
)
def platt_apply(spark: SparkSession, sf: str) -> DataFrame:
    t = tape_of(spark, sf)
    mods = {"p_inplay_30s": 101, "p_inplay_2m": 97, "p_inplay_5m": 89, "p_toxic": 53}
    heads = F.array(
        *[F.struct(F.lit(h).alias("head"), ((F.col("seq") % m) / float(m)).alias("score")) for h, m in mods.items()]
    )
    long = t.select("seq", F.inline(heads))
    out = calibration.apply_calibrators(long, calibration.calibrators_table(long, _PARAMS))
    return out.select("seq", "head", rnd(F.col("calibrated"), 7).alias("calibrated"))


def _fit_sql(iters: int) -> str:
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT y, ln(q / (1 - q)) AS x FROM (SELECT quality AS y, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, n_chars::DOUBLE / (n_chars + 1000))) AS q
        FROM documents JOIN labels USING (doc_id))),
      k AS (SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p FROM d),
      g AS MATERIALIZED (SELECT x, CASE WHEN y = 1 THEN (p + 1) / (p + 2) ELSE 1 / (n - p + 2) END AS t, n FROM d, k),
      it AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, NULL::DOUBLE AS loss
        UNION ALL SELECT i + 1, a - 0.1::DOUBLE * ga, b - 0.1::DOUBLE * gb, now FROM (
          SELECT i, any_value(a) AS a, any_value(b) AS b, any_value(loss) AS loss, sum((p - t) * x) / any_value(n) AS ga, sum(p - t) / any_value(n) AS gb,
            sum(-(t * ln(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p))) + (1 - t) * ln(1 - greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p))))) / any_value(n) AS now
          FROM (SELECT it.*, g.x, g.t, g.n, 1 / (1 + exp(-(it.a * g.x + it.b))) AS p FROM it, g WHERE it.i < {iters}) GROUP BY i)
          WHERE loss IS NULL OR abs(loss - now) >= 1e-6)
      SELECT 'quality' AS head, {S.rnd("a", 5)} AS a, {S.rnd("b", 5)} AS b FROM it ORDER BY i DESC LIMIT 1"""


@query("fit_platt", _fit_sql(100))
def fit_platt(spark: SparkSession, sf: str) -> DataFrame:
    long = _docs(spark, sf).select(F.lit("quality").alias("head"), "score", "y")
    got = calibration.fit_platt(long, reject_negative_slope=False)
    return calibration.calibrators_table(long, got).select(
        "head", rnd(F.col("a"), 5).alias("a"), rnd(F.col("b"), 5).alias("b")
    )


@query("calibrate_all")
def calibrate_all(spark: SparkSession, sf: str) -> DataFrame:
    lab, _ = _both(spark, sf)
    df = labels.labels_wide(lab).join(_scores(lab), ["symbol", "ts"])
    return calibration.calibrate_all(df, reject_negative_slope=False)


# --- texts ------------------------------------------------------------------------------

_RE = r"'-?\d+\.?\d*|-?\.\d+'"


@query(
    "numbers_in_text",
    f"""SELECT doc_id, len(x) AS n, array_to_string(x, ',') AS numbers FROM (SELECT doc_id, regexp_extract_all(text, {_RE}) AS x FROM documents)""",
)
def numbers_in_text_q(spark: SparkSession, sf: str) -> DataFrame:
    x = load(spark, sf, "documents").select("doc_id", numbers_in_text(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n"), joined("x").alias("numbers"))


@query(
    "reason_texts",
    r"SELECT doc_id, (NOT regexp_matches(text, '\d') AND length(text) <= 64)::INT AS ok FROM documents",
)
def reason_texts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", flag(reason_text_ok(F.col("text"))).alias("ok"))


_EXPLAIN = f"""WITH x AS (SELECT doc_id, text, source, n_chars, 'DOC' || doc_id AS symbol, CASE doc_id % 5 WHEN 0 THEN 'TRADEABLE' WHEN 1 THEN 'WATCH' WHEN 2 THEN 'TRAP' WHEN 3 THEN 'DEAD' ELSE 'DATA_ISSUE' END AS status,
      CASE WHEN doc_id % 3 = 0 THEN 'Watch' WHEN doc_id % 3 = 1 THEN 'Avoid' ELSE 'Great' END AS label,
      list_concat([(n_chars * 0.25::DOUBLE)::VARCHAR, (n_chars + 0.5::DOUBLE)::VARCHAR, '0.5', '7.0', '7'], CASE WHEN n_chars % 4 = 0 THEN [(n_chars // 4)::VARCHAR] ELSE [] END) AS allowed FROM documents),
    y AS (SELECT *, list_filter(regexp_extract_all(text, {_RE}), lambda n: NOT list_contains(allowed, n)) AS bad FROM x),
    z AS (SELECT *, list_concat(CASE WHEN label = 'Great' THEN ['status_label: Great'] ELSE [] END, list_transform(bad, lambda n: 'headline: number ' || n),
      CASE WHEN length(text) > 180 THEN ['headline: too long'] ELSE [] END) AS violations FROM y)"""


def _explanations(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts, whole, as if they were the headline of an explanation."""
    d = F.col("doc_id")
    status = F.element_at(
        F.array(*map(F.lit, ("TRADEABLE", "WATCH", "TRAP", "DEAD", "DATA_ISSUE"))), (d % 5 + 1).cast("int")
    )
    reasons = F.array(
        F.struct(
            F.lit("RC_FLOW_SURGE").alias("code"), F.lit(7.0).alias("value"), F.lit("z").alias("unit"), F.lit("").alias("evidence")
        )
    )
    return load(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("DOC"), d.cast("string")).alias("symbol"),
        status.alias("status"),
        (F.col("n_chars") * 0.25).alias("score"),
        (F.col("n_chars") + 0.5).alias("spread_bps"),
        F.lit(0.5).alias("impact_bps"),
        F.lit(7.0).alias("p_toxic"),
        reasons.alias("reasons"),
        F.lit(180).alias("max_chars"),
        F.col("text").alias("headline"),
        F.lit("").alias("subtext"),
        F.when(d % 3 == 0, "Watch").when(d % 3 == 1, "Avoid").otherwise("Great").alias("status_label"),
        F.create_map().cast("map<string,string>").alias("tooltips"),
    )


@query("explanation_check", _EXPLAIN + " SELECT doc_id, array_to_string(violations, '; ') AS violations FROM z")
def explanation_check(spark: SparkSession, sf: str) -> DataFrame:
    c = explain.check_explanations(_explanations(spark, sf))
    return c.select("doc_id", joined("violations", "; ").alias("violations"))


@query(
    "explanation_texts",
    _EXPLAIN + """ SELECT doc_id, (len(violations) = 0)::INT AS was_valid, CASE WHEN len(violations) = 0 THEN text ELSE symbol || ': flow surge.' END AS headline,
    CASE WHEN len(violations) = 0 THEN label ELSE CASE status WHEN 'TRADEABLE' THEN 'Tradeable' WHEN 'WATCH' THEN 'Watch' WHEN 'TRAP' THEN 'Trap' WHEN 'DEAD' THEN 'Dead' ELSE 'Data issue' END END AS status_label FROM z""",
)
def explanation_texts(spark: SparkSession, sf: str) -> DataFrame:
    v = explain.validate_or_fallback(_explanations(spark, sf))
    return v.select("doc_id", flag(F.col("was_valid")).alias("was_valid"), "headline", "status_label")


# --- data sets --------------------------------------------------------------------------


@query(
    "dataset_metadata",
    _LABELS + " SELECT '1.0.0' AS schema_version, count(*) AS row_count, count(DISTINCT symbol) AS symbol_count FROM fut",
)
def dataset_metadata_q(spark: SparkSession, sf: str) -> DataFrame:
    m = dataset_metadata(labels.labels_wide(_labels(spark, sf)), LC)
    return m.select("schema_version", "row_count", "symbol_count")


@query(
    "dataset_check",
    _LABELS + """ SELECT 'rows' AS "check", '*' AS subject, count(*) AS value, 1 AS ok FROM fut
    UNION ALL SELECT 'extra', 'gates_passed_' || horizon || '_' || profile, 1, 1 FROM edge
    UNION ALL SELECT 'nulls', c, 0, 1 FROM (SELECT unnest(['ts', 'symbol', 'mid_price', 'spread_bps', 'y_toxic', 'severity_toxic_bps']) AS c
      UNION ALL SELECT n || '_' || horizon || '_' || profile FROM edge, (VALUES ('i_tradeable'), ('net_edge_bps'), ('mfe_bps'), ('mae_bps'), ('cost_bps')) v(n))""",
)
def dataset_check(spark: SparkSession, sf: str) -> DataFrame:
    v = normalize.validate_dataset(labels.labels_wide(_labels(spark, sf)))
    return v.withColumn("ok", flag(F.col("ok")))


@query(
    "feature_matrix",
    _LABELS + f" SELECT symbol, ts, {S.rnd('mid', 4)} AS mid_price, {S.rnd('spread', 6)} AS spread_bps FROM fut",
)
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    w = labels.labels_wide(_labels(spark, sf))
    cols = normalize.feature_columns_of(w)
    return w.select("symbol", "ts", *[rnd(F.col(c), 4 if c == "mid_price" else 6).alias(c) for c in cols])


