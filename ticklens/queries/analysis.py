"""Registered queries: isotonic calibration, drift, robust scores, moving moments, update throttle, order budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticklens.config import HEADS, RankConfig
from ticklens.functions.market import depth_slope, microprice
from ticklens.functions.numeric import rnd
from ticklens.operators import budget, drift, isotonic, labels, metrics, moments, ranking, robust, train
from ticklens.queries.common import FC, LC, PRED_SQL, RC, F, S, flag, load, preds_of, query, snaps_of, tape_of
from ticklens.queries.market import _FSM
from ticklens.queries.offline import _LABELS, _book_rows

TAPE = "WITH " + S.TAPE

# --- isotonic calibration ---------------------------------------------------------------

_HEADS = """WITH d AS (SELECT doc_id, n_chars::DOUBLE / (n_chars + 1000) AS score, quality, toxic FROM documents JOIN labels USING (doc_id)),
    h AS (SELECT 'quality' AS head, doc_id, score, quality AS y FROM d UNION ALL SELECT 'toxic', doc_id, score, toxic FROM d),
    g AS (SELECT head, score, count(*) AS n, sum(y) AS pos FROM h GROUP BY 1, 2),
    c AS (SELECT head, score, n, pos, sum(n) OVER w AS n_to, sum(pos) OVER w AS pos_to FROM g WINDOW w AS (PARTITION BY head ORDER BY score)),
    m AS (SELECT a.head, a.score AS a, b.score AS b, (b.pos_to - a.pos_to + a.pos)::DOUBLE / (b.n_to - a.n_to + a.n) AS mean
      FROM c a JOIN c b ON a.head = b.head AND a.score <= b.score),
    low AS (SELECT head, a, b, min(mean) OVER (PARTITION BY head, a ORDER BY b DESC) AS least FROM m),
    iso AS (SELECT head, b AS score, max(least) AS value FROM low GROUP BY 1, 2),
    fit AS (SELECT head, value, min(score) AS lo, max(score) AS hi, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos FROM iso JOIN g USING (head, score) GROUP BY 1, 2)"""
_APPLIED = """, x AS (SELECT h.head, h.doc_id, h.score, h.y, (SELECT max(lo) FROM fit f WHERE f.head = h.head AND f.lo <= h.score) AS lo,
      (SELECT min(lo) FROM fit f WHERE f.head = h.head AND f.lo > h.score) AS up FROM h),
    cal AS (SELECT x.head, doc_id, x.score, y, CASE WHEN a.lo IS NULL THEN b.value WHEN b.lo IS NULL OR x.score <= a.hi THEN a.value
        ELSE a.value + (b.value - a.value) * ((x.score - a.hi) / (b.lo - a.hi)) END AS calibrated
      FROM x LEFT JOIN fit a ON a.head = x.head AND a.lo = x.lo LEFT JOIN fit b ON b.head = x.head AND b.lo = x.up)"""


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    """Two heads over the labelled documents, with a score that grows with the length."""
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    one = lambda h: F.struct(F.lit(h).alias("head"), F.col(h).alias("y"))
    score = F.col("n_chars").cast("double") / (F.col("n_chars") + 1000)
    return d.select("doc_id", score.alias("score"), F.inline(F.array(one("quality"), one("toxic"))))


@query("isotonic_fit", _HEADS + f" SELECT head, {S.rnd('lo', 9)} AS lo, {S.rnd('hi', 9)} AS hi, n, pos, {S.rnd('value', 9)} AS value FROM fit")
def isotonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    fit = isotonic.isotonic_fit(_heads(spark, sf))
    return fit.withColumns({c: rnd(F.col(c), 9) for c in ("lo", "hi", "value")})


@query(
    "isotonic_apply",
    _HEADS.replace("JOIN labels", "LEFT JOIN labels").replace("FROM h GROUP", "FROM h WHERE doc_id % 3 > 0 AND y IS NOT NULL GROUP")
    + _APPLIED + f" SELECT head, doc_id, {S.rnd('calibrated', 9)} AS calibrated FROM cal",
)
def isotonic_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on two thirds of the labelled documents, applied to all documents."""
    fit = isotonic.isotonic_fit(_heads(spark, sf).filter("doc_id % 3 > 0"))
    n = F.col("n_chars")
    docs = load(spark, sf, "documents").select(
        "doc_id", (n.cast("double") / (n + 1000)).alias("score"), F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("head")
    )
    out = isotonic.isotonic_apply(docs, fit)
    return out.select("head", "doc_id", rnd(F.col("calibrated"), 9).alias("calibrated"))


def _errors_sql(column: str) -> str:
    return f"""(SELECT head, avg(({column} - y) * ({column} - y)) AS brier FROM cal GROUP BY 1)"""


@query(
    "isotonic_gain",
    _HEADS + _APPLIED + f""" SELECT head, {S.rnd("a.brier", 8)} AS brier_before, {S.rnd("b.brier", 8)} AS brier_after
    FROM {_errors_sql("score")} a JOIN {_errors_sql("calibrated")} b USING (head)""",
)
def isotonic_gain(spark: SparkSession, sf: str) -> DataFrame:
    long = _heads(spark, sf)
    out = isotonic.isotonic_apply(long, isotonic.isotonic_fit(long))
    before = metrics.brier(out, ["head"]).withColumnRenamed("brier_score", "brier_before")
    after = metrics.brier(out.select("head", "y", F.col("calibrated").alias("score")), ["head"])
    both = before.join(after.withColumnRenamed("brier_score", "brier_after"), "head")
    return both.withColumns({c: rnd(F.col(c), 8) for c in ("brier_before", "brier_after")})


# --- drift ------------------------------------------------------------------------------

_DRIFTING = ("spread_bps", "mid", "book_imbalance", "flow_imbalance", "natr_14_5m", "impact_bps_q")
_SPLIT = 324_000  # half of the market view
_LONG = (
    "WITH "
    + S.features(FC)
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS value, ts < {_SPLIT} AS is_base FROM feat" for f in _DRIFTING)
    + """), cnt AS (SELECT feature, value, count(*) FILTER (is_base) AS base, count(*) FILTER (NOT is_base) AS now FROM long GROUP BY 1, 2),
    cum AS (SELECT *, (sum(base) OVER w)::DOUBLE AS base_to, (sum(now) OVER w)::DOUBLE AS now_to, (sum(base) OVER g)::BIGINT AS n_base,
      (sum(now) OVER g)::BIGINT AS n_now FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY value), g AS (PARTITION BY feature))"""
)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    rows = snaps_of(spark, sf).select("ts", "features.*")
    return drift.features_long(rows, _DRIFTING, F.col("ts") < _SPLIT)


@query(
    "ks_drift",
    _LONG + f""", gap AS (SELECT *, abs(base_to / n_base - now_to / n_now) AS gap FROM cum),
    best AS (SELECT feature, any_value(n_base) AS n_base, any_value(n_now) AS n_now, max(gap) AS ks, arg_max(value, (gap, -value)) AS at_value FROM gap GROUP BY 1)
    SELECT feature, n_base, n_now, {S.rnd("ks", 9)} AS ks, {S.rnd("at_value", 6)} AS at_value,
      (ks > 1.36::DOUBLE * sqrt((n_base + n_now)::DOUBLE / (n_base::DOUBLE * n_now)))::INT AS drifted FROM best""",
)
def ks_drift(spark: SparkSession, sf: str) -> DataFrame:
    d = drift.ks_drift(_features(spark, sf))
    return d.select(
        "feature", "n_base", "n_now", rnd(F.col("ks"), 9).alias("ks"), rnd(F.col("at_value"), 6).alias("at_value"),
        flag(F.col("drifted")).alias("drifted"),
    )


_PSI = (
    _LONG
    + """, srt AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS i, count(*) OVER (PARTITION BY feature) AS n FROM long WHERE is_base),
    edges AS (SELECT feature, value AS edge FROM srt, range(1, 10) r(j) WHERE i = (j * n + 9) // 10),
    binned AS (SELECT l.feature, l.is_base, (SELECT count(*) FROM edges e WHERE e.feature = l.feature AND e.edge < l.value)::INT AS bin FROM long l),
    bins AS (SELECT feature, bin, count(*) FILTER (is_base) AS base, count(*) FILTER (NOT is_base) AS now FROM binned GROUP BY 1, 2),
    tot AS (SELECT *, sum(base) OVER g AS n_base, sum(now) OVER g AS n_now FROM bins WINDOW g AS (PARTITION BY feature)),
    sh AS (SELECT *, greatest(base::DOUBLE / n_base, 1e-4::DOUBLE) AS b, greatest(now::DOUBLE / n_now, 1e-4::DOUBLE) AS c FROM tot)"""
)


@query("psi_bins", _PSI + " SELECT feature, bin, base, now FROM bins")
def psi_bins(spark: SparkSession, sf: str) -> DataFrame:
    return drift.psi_bins(_features(spark, sf)).select("feature", "bin", "base", "now")


@query(
    "psi_drift",
    _PSI + f""", psi AS (SELECT feature, count(*) AS n_bins, sum((c - b) * ln(c / b)) AS psi FROM sh GROUP BY 1)
    SELECT feature, n_bins, {S.rnd("psi", 8)} AS psi, CASE WHEN psi >= 0.25::DOUBLE THEN 'CRITICAL' WHEN psi >= 0.1::DOUBLE THEN 'WARN' ELSE 'OK' END AS level FROM psi""",
)
def psi_drift(spark: SparkSession, sf: str) -> DataFrame:
    return drift.psi_drift(_features(spark, sf)).select("feature", "n_bins", rnd(F.col("psi"), 8).alias("psi"), "level")


@query(
    "prediction_drift",
    "WITH " + PRED_SQL + f""", per AS (SELECT ts // 60000 AS cell, count(*) AS n, avg(p_inplay_2m) AS mean, var_pop(p_inplay_2m) AS variance FROM pred GROUP BY 1)
    SELECT cell, n, {S.rnd("mean", 8)} AS mean, {S.rnd("variance", 8)} AS variance, {S.rnd("mean - lag(mean) OVER (ORDER BY cell)", 8)} AS mean_step,
      {S.rnd("variance - lag(variance) OVER (ORDER BY cell)", 8)} AS variance_step FROM per""",
)
def prediction_drift(spark: SparkSession, sf: str) -> DataFrame:
    d = drift.prediction_drift(preds_of(spark, sf), "ts", "p_inplay_2m", 60_000)
    return d.select("cell", "n", *[rnd(F.col(c), 8).alias(c) for c in ("mean", "variance", "mean_step", "variance_step")])


# --- robust scores ----------------------------------------------------------------------

_ROBUST_MS = 120_000


@query(
    "robust_z",
    TAPE + f""", t AS (SELECT symbol, seq, price AS x, list(price) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {_ROBUST_MS - 1} PRECEDING AND CURRENT ROW) AS l FROM tape WHERE is_trade),
    m AS (SELECT *, list_median(l)::DOUBLE AS med FROM t),
    d AS (SELECT *, list_median(list_transform(l, lambda y: abs(y - med)))::DOUBLE AS mad FROM m)
    SELECT symbol, seq, len(l) AS n, med AS median, mad, CASE WHEN mad > 0 THEN {S.rnd("(x - med) / (1.4826::DOUBLE * mad)", 8)}
      WHEN x > med THEN 'inf'::DOUBLE WHEN x < med THEN '-inf'::DOUBLE END AS robust_z FROM d""",
)
def robust_z(spark: SparkSession, sf: str) -> DataFrame:
    trades = tape_of(spark, sf).filter("is_trade").select("symbol", "seq", "ts", "price")
    z = robust.robust_z(trades, ["symbol"], "ts", "price", _ROBUST_MS)
    rounded = F.when(F.abs("robust_z") == float("inf"), F.col("robust_z")).otherwise(rnd(F.col("robust_z"), 8))
    return z.select("symbol", "seq", "n", "median", "mad", rounded.alias("robust_z"))


# --- moving moments ---------------------------------------------------------------------

_MIDS = TAPE + """, mids AS (SELECT symbol, ts, arg_max((bid + ask) / 2, seq)::DOUBLE AS mid FROM tape WHERE NOT is_trade GROUP BY 1, 2),
    rets AS (SELECT symbol, ts, mid, ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM mids)"""
_REFERENCE = "U1"
_MOMENTS_MS = 120_000


def _mids(spark: SparkSession, sf: str) -> DataFrame:
    """The last mid price of each instant with a quote."""
    quotes = tape_of(spark, sf).filter("NOT is_trade")
    return quotes.groupBy("symbol", "ts").agg(F.max_by((F.col("bid") + F.col("ask")) / 2, "seq").alias("mid"))


@query(
    "realized_vol",
    _MIDS + f""", w AS (SELECT symbol, ts, list(ret) FILTER (ret IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {_MOMENTS_MS - 1} PRECEDING AND CURRENT ROW) AS l FROM rets),
    c AS (SELECT *, coalesce(len(l), 0) AS n, list_avg(l) AS m FROM w)
    SELECT symbol, ts, n AS n_returns, {S.rnd("CASE WHEN n >= 2 THEN sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / (n - 1)) END * 10000", 7)} AS realized_vol_bps FROM c""",
)
def realized_vol(spark: SparkSession, sf: str) -> DataFrame:
    v = moments.realized_vol(_mids(spark, sf), ["symbol"], "ts", "mid", _MOMENTS_MS)
    return v.select("symbol", "ts", "n_returns", rnd(F.col("realized_vol") * 10000, 7).alias("realized_vol_bps"))


# Instants without both prices carry nothing, so the prices are taken on a grid of ten seconds.
_GRID = TAPE + f""", mids AS (SELECT symbol, ts // 10000 AS ts, arg_max(mid, t)::DOUBLE AS mid FROM (SELECT symbol, ts, (bid + ask) / 2 AS mid, (ts, seq) AS t FROM tape WHERE NOT is_trade) GROUP BY 1, 2),
    rets AS (SELECT symbol, ts, mid, ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY ts)) AS ret FROM mids),
    ref AS (SELECT ts, ret AS ref FROM rets WHERE symbol = '{_REFERENCE}'),
    w AS (SELECT symbol, ts, list({{'x': ret, 'y': ref}}) FILTER (ret IS NOT NULL AND ref IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS l
      FROM rets LEFT JOIN ref USING (ts)),
    c AS (SELECT *, coalesce(len(l), 0) AS n, list_avg(list_transform(l, lambda p: p.x)) AS mx, list_avg(list_transform(l, lambda p: p.y)) AS my FROM w),
    q AS (SELECT *, list_sum(list_transform(l, lambda p: (p.x - mx) * (p.y - my))) AS xy, list_sum(list_transform(l, lambda p: (p.x - mx) * (p.x - mx))) AS xx,
      list_sum(list_transform(l, lambda p: (p.y - my) * (p.y - my))) AS yy FROM c)"""


@query(
    "market_beta",
    _GRID + f""" SELECT symbol, ts, n AS n_returns, {S.rnd("CASE WHEN n >= 2 AND yy > 0 THEN xy / yy END", 6)} AS beta,
    {S.rnd("CASE WHEN n >= 2 AND yy > 0 AND xx > 0 THEN xy / (sqrt(xx) * sqrt(yy)) END", 6)} AS corr FROM q""",
)
def market_beta(spark: SparkSession, sf: str) -> DataFrame:
    quotes = tape_of(spark, sf).filter("NOT is_trade").withColumn("g", F.floor(F.col("ts") / 10_000).cast("long"))
    grid = quotes.groupBy("symbol", F.col("g").alias("ts")).agg(
        F.max_by((F.col("bid") + F.col("ask")) / 2, F.struct(quotes["ts"], quotes["seq"])).alias("mid")
    )
    b = moments.market_beta(grid, _REFERENCE, window_ms=30)
    return b.select("symbol", "ts", "n_returns", rnd(F.col("beta"), 6).alias("beta"), rnd(F.col("corr"), 6).alias("corr"))


@query(
    "depth_slope",
    f"""WITH lv AS (SELECT l_orderkey AS id, floor(l_extendedprice * 100 / l_quantity) AS price, l_quantity AS qty FROM lineitem),
    m AS (SELECT id, count(*) AS n, avg(price) AS mp, avg(qty) AS mq FROM lv GROUP BY 1),
    s AS (SELECT id, sum((price - mp) * (qty - mq)) AS xy, sum((price - mp) * (price - mp)) AS xx FROM lv JOIN m USING (id) GROUP BY 1)
    SELECT id, {S.rnd("CASE WHEN xx > 0 THEN xy / xx END * 1e6", 6)} AS slope FROM (SELECT o_orderkey AS id FROM orders) LEFT JOIN s USING (id)""",
)
def depth_slope_q(spark: SparkSession, sf: str) -> DataFrame:
    books = _book_rows(spark, sf)
    return books.select("id", rnd(depth_slope(F.col("asks")) * 1e6, 6).alias("slope"))


@query(
    "microprice",
    TAPE + f" SELECT symbol, seq, {S.rnd('(ask * bid_qty + bid * ask_qty) / (bid_qty + ask_qty)', 6)} AS microprice FROM tape WHERE NOT is_trade",
)
def microprice_q(spark: SparkSession, sf: str) -> DataFrame:
    m = microprice(F.col("bid"), F.col("ask"), F.col("bid_qty"), F.col("ask_qty"))
    return tape_of(spark, sf).filter("NOT is_trade").select("symbol", "seq", rnd(m, 6).alias("microprice"))


# --- ranking of updates that leave symbols out -----------------------------------------

_FAST = RankConfig(update_interval_ms=1_000, burst_delta=0.95, score_threshold=0.1)
_QUICK_TICKS = TAPE + """, sc AS MATERIALIZED (SELECT symbol, (ts + 249) // 250 * 250 AS ts, max(coalesce(qty * 10, bid_qty)) / 100.0::DOUBLE AS score FROM tape GROUP BY 1, 2),
    tk AS MATERIALIZED (SELECT ts, list(symbol) AS names FROM sc GROUP BY 1)"""
_BURST = f"""r.score >= {_FAST.score_threshold}::DOUBLE AND CASE WHEN s.score IS NOT NULL THEN abs(r.score - s.score) >= {_FAST.burst_delta}::DOUBLE
      ELSE list_contains(a.known, r.symbol) AND r.score >= {_FAST.burst_delta}::DOUBLE END"""


@query(
    "throttled_updates",
    "WITH RECURSIVE " + _QUICK_TICKS.removeprefix("WITH ") + f""", acc AS (
      SELECT ts, names AS known FROM tk WHERE ts = (SELECT min(ts) FROM tk)
      UNION ALL
      SELECT tk.ts, list_distinct(list_concat(n.known, tk.names)) FROM (
        SELECT a.ts, any_value(a.known) AS known, min(r.ts) FILTER (r.ts >= a.ts + {_FAST.update_interval_ms} OR ({_BURST})) AS nxt
        FROM acc a JOIN sc r ON r.ts > a.ts LEFT JOIN sc s ON s.ts = a.ts AND s.symbol = r.symbol
        WHERE r.ts <= (SELECT min(u.ts) FROM tk u WHERE u.ts >= a.ts + {_FAST.update_interval_ms}) OR (SELECT max(ts) FROM tk) < a.ts + {_FAST.update_interval_ms}
        GROUP BY a.ts) n JOIN tk ON tk.ts = n.nxt)
    SELECT tk.ts, (acc.ts IS NOT NULL)::INT AS accepted FROM tk LEFT JOIN acc USING (ts)""",
)
def throttled_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks of 250 ms, at each of which most symbols are absent."""
    tick = (F.ceil(F.col("ts") / 250) * 250).cast("long")
    size = F.coalesce(F.col("qty") * 10, F.col("bid_qty"))
    scored = tape_of(spark, sf).groupBy("symbol", tick.alias("ts")).agg((F.max(size) / 100.0).alias("score"))
    return ranking.throttle(scored, _FAST).select("ts", flag(F.col("accepted")).alias("accepted"))


_HERE = "(substr(symbol, 2)::BIGINT + ts // 7000) % 3 > 0"
_ABSENT = f""", here AS (SELECT symbol, ts, score FROM pred WHERE {_HERE}),
    mem AS (SELECT symbol, ts, score, CASE WHEN score >= {RC.score_threshold}::DOUBLE THEN
      row_number() OVER (PARTITION BY ts ORDER BY score >= {RC.score_threshold}::DOUBLE DESC, score DESC, symbol) END AS position FROM here),
    m AS MATERIALIZED (SELECT f.symbol, t.ts, coalesce(mem.score, 0) AS score, position, coalesce(position <= {RC.top_k}, false) AS member
      FROM (SELECT symbol, min(ts) AS t0 FROM here GROUP BY 1) f JOIN (SELECT DISTINCT ts FROM here) t ON t.ts >= f.t0 LEFT JOIN mem USING (symbol, ts)),
    """ + _FSM[_FSM.index("fsm AS ("):]  # fmt: skip


@query(
    "absent_symbols",
    "WITH RECURSIVE " + PRED_SQL + _ABSENT + f""" SELECT ts, ev AS event, symbol, coalesce(CASE WHEN ev = 'SYMBOL_ENTER' THEN prev_rank ELSE held_rank END, 0)::INT AS rank,
    {S.rnd("score", 8)} AS score FROM ranks WHERE ev <> ''""",
)
def absent_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Each symbol is left out of a third of the updates, seven seconds at a time."""
    number = F.substring("symbol", 2, 20).cast("long")
    here = preds_of(spark, sf).filter((number + F.floor(F.col("ts") / 7_000)) % 3 > 0)
    ev = ranking.rank_events(ranking.ranked_states(here, RC, absent=True))
    return ev.withColumn("score", rnd(F.col("score"), 8))


# --- order budgets ----------------------------------------------------------------------

_ORDERS = TAPE + ", o AS (SELECT 'A' || seq % 3 AS account, ts, seq, is_trade, row_number() OVER (PARTITION BY seq % 3 ORDER BY ts, seq) AS i FROM tape)"
_CAPACITY, _PER_SECOND, _BUFFER = 20, 5, 4


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of the tape as an order of one of three accounts."""
    account = F.concat(F.lit("A"), (F.col("seq") % 3).cast("string"))
    return tape_of(spark, sf).select(account.alias("account"), "ts", "seq", "is_trade")


@query(
    "order_budget",
    "WITH RECURSIVE " + _ORDERS.removeprefix("WITH ") + f""", om AS MATERIALIZED (SELECT * FROM o), b AS (
      SELECT account, i, ts, seq, {_CAPACITY * 1000 - 1000}::BIGINT AS level, false AS throttled FROM om WHERE i = 1
      UNION ALL
      SELECT account, i, ts, seq, level, CASE WHEN level <= {_BUFFER * 1000} THEN true WHEN level > {2 * _BUFFER * 1000} THEN false ELSE throttled END FROM (
        SELECT om.account, om.i, om.ts, om.seq, least({_CAPACITY * 1000}, b.level + (om.ts - b.ts) * {_PER_SECOND}) - 1000 AS level, b.throttled
        FROM b JOIN om ON om.account = b.account AND om.i = b.i + 1))
    SELECT account, seq, level / 1000.0::DOUBLE AS remaining, throttled::INT AS throttled FROM b""",
)
def order_budget(spark: SparkSession, sf: str) -> DataFrame:
    b = budget.order_budget(
        _orders(spark, sf), ["account"], ("ts", "seq"), _CAPACITY, _PER_SECOND, _BUFFER, slice_ms=20_000
    )
    return b.select("account", "seq", "remaining", flag(F.col("throttled")).alias("throttled"))


@query(
    "order_churn",
    _ORDERS + " SELECT account, seq, n AS in_window, (n > 40)::INT AS paused FROM (SELECT *, row_number() OVER (PARTITION BY account, ts // 10000 ORDER BY ts, seq) AS n FROM o)",
)
def order_churn(spark: SparkSession, sf: str) -> DataFrame:
    c = budget.order_churn(_orders(spark, sf), ["account"], ("ts", "seq"), 10_000, 40)
    return c.select("account", "seq", "in_window", flag(F.col("paused")).alias("paused"))


@query(
    "fill_cooldown",
    _ORDERS + """, f AS (SELECT *, max(CASE WHEN is_trade THEN ts END) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_ts FROM o)
    SELECT account, seq, last_ts, coalesce(ts - last_ts < 500, false)::INT AS fill_cooldown FROM f WHERE NOT is_trade""",
)
def fill_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    orders = _orders(spark, sf)
    c = budget.cooldown(
        orders.filter("NOT is_trade"), orders.filter("is_trade"), ["account"], 500, slice_ms=20_000, reason="fill_cooldown"
    )
    return c.select("account", "seq", "last_ts", flag(F.col("fill_cooldown")).alias("fill_cooldown"))


# --- training ---------------------------------------------------------------------------

_JOINED = (
    "WITH RECURSIVE "
    + S.features(FC)
    + _LABELS.removeprefix("WITH RECURSIVE " + S.TAPE)
    + """, tr AS (SELECT t.symbol, t.ts, severity, f.ts AS feature_ts, f.spread_bps AS feature_spread, f.flow_imbalance
      FROM tox t ASOF JOIN feat f ON t.symbol = f.symbol AND t.ts >= f.ts)"""
)


def _training(spark: SparkSession, sf: str) -> DataFrame:
    lab = labels.labels_wide(labels.build_labels(tape_of(spark, sf), LC))
    return train.training_rows(snaps_of(spark, sf), lab)


@query(
    "training_rows",
    _JOINED + f""" SELECT symbol, ts, feature_ts, (severity > 10)::INT AS y_toxic, {S.rnd("feature_spread", 6)} AS feature_spread,
    {S.rnd("flow_imbalance", 6)} AS flow_imbalance FROM tr""",
)
def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training(spark, sf)
    return rows.select(
        "symbol", "ts", "feature_ts", "y_toxic", rnd(F.col("features.spread_bps"), 6).alias("feature_spread"),
        rnd(F.col("features.flow_imbalance"), 6).alias("flow_imbalance"),
    )


@query("train_heads")
def train_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Brier scores of trained heads, the baseline and the plain share on held-out time."""
    parts = train.split_rows(_training(spark, sf))
    base = preds_of(spark, sf).select("symbol", "ts", *HEADS)
    return train.evaluate_heads(parts, train.train_heads(parts), base)
