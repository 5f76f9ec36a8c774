"""Registered queries: ledgers from line items, resting orders, policy, monitoring series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticklens.config import PolicyConfig, QuoteConfig
from ticklens.functions.numeric import rnd
from ticklens.operators import ledger, monitor, policy
from ticklens.queries.common import F, S, flag, joined, load, query, tape_of

TAPE = "WITH " + S.TAPE

# --- fills ------------------------------------------------------------------------------

_FILLS = """fills AS (SELECT 'S' || l_suppkey AS session_id, 'P' || l_partkey % 3 AS symbol, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) * 86400000 AS ts,
    l_orderkey AS order_id, l_linenumber::BIGINT AS trade_id, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, l_quantity AS fill_qty,
    floor(l_extendedprice / l_quantity) AS fill_price FROM lineitem)"""

# One fill after the other, all ledgers at once.
_LEDGER = (
    "WITH RECURSIVE "
    + _FILLS
    + f""", n AS MATERIALIZED (SELECT *, CASE side WHEN 'BUY' THEN fill_qty ELSE -fill_qty END AS d,
      row_number() OVER (PARTITION BY session_id, symbol ORDER BY ts, order_id, trade_id) AS i FROM fills),
    led AS (
      SELECT session_id, symbol, 0::BIGINT AS i, 0::BIGINT AS ts, 0::BIGINT AS order_id, 0::BIGINT AS trade_id, 0.0::DOUBLE AS q, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS fee FROM (SELECT DISTINCT session_id, symbol FROM n)
      UNION ALL
      SELECT n.session_id, n.symbol, n.i, n.ts, n.order_id, n.trade_id, l.q + n.d,
        CASE WHEN l.q + n.d = 0 THEN 0 WHEN l.q = 0 THEN n.fill_price
          WHEN abs(l.q + n.d) > abs(l.q) AND (l.q > 0) = (l.q + n.d > 0) THEN (abs(l.q) * l.entry + n.fill_qty * n.fill_price) / abs(l.q + n.d)
          WHEN (l.q > 0) <> (l.q + n.d > 0) THEN n.fill_price ELSE l.entry END,
        CASE WHEN l.q * n.d < 0 THEN least(n.fill_qty, abs(l.q)) * CASE WHEN l.q > 0 THEN n.fill_price - l.entry ELSE l.entry - n.fill_price END ELSE 0 END,
        n.fill_price * n.fill_qty * {ledger.MAKER_FEE}::DOUBLE
      FROM led l JOIN n ON n.session_id = l.session_id AND n.symbol = l.symbol AND n.i = l.i + 1),
    pos AS (SELECT *, sum(pnl) OVER (PARTITION BY session_id, symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS realized FROM led WHERE i > 0)"""
)


def _snap(x: str, digits: int = 4) -> str:
    """Round twice: sums taken in another order cannot fall on the other side of a tie."""
    return S.rnd(S.rnd(x, 7), digits)


def _snapc(c: str, digits: int = 4):
    return rnd(rnd(F.col(c), 7), digits).alias(c)


def _fills(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return load(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), text("l_suppkey")).alias("session_id"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 3).cast("string")).alias("symbol"),
        (day.cast("long") * 86_400_000).alias("ts"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("trade_id"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").alias("fill_qty"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("fill_price"),
    )


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.realized_so_far(ledger.position_ledger(_fills(spark, sf)))


_KEY = ["session_id", "symbol"]
_ORDER = ["ts", "order_id", "trade_id"]


@query(
    "position_ledger",
    _LEDGER + f" SELECT session_id, symbol, ts, order_id, trade_id, q AS position_qty, {_snap('entry')} AS entry_price, {_snap('pnl', 3)} AS realized_pnl, {_snap('fee', 3)} AS commission FROM pos",
)
def position_ledger(spark: SparkSession, sf: str) -> DataFrame:
    led = ledger.position_ledger(_fills(spark, sf))
    return led.select(
        *_KEY, *_ORDER, "position_qty", _snapc("entry_price"), _snapc("realized_pnl", 3), _snapc("commission", 3)
    )


@query(
    "pnl_metrics",
    _LEDGER + f""", o AS (SELECT 'S' || l_suppkey AS session_id, count(DISTINCT l_orderkey) + count(*) AS orders_placed FROM lineitem GROUP BY 1)
    SELECT session_id, {_snap("sum(pnl) - sum(fee)", 2)} AS net_pnl, {_snap("sum(fee)", 2)} AS total_commissions, count(*) AS total_fills, max(abs(q)) AS max_position,
      (max(ts) - min(ts)) / 60000.0::DOUBLE AS session_minutes, any_value(orders_placed) AS orders_placed, {S.rnd("count(*) / any_value(orders_placed)::DOUBLE", 6)} AS fill_rate
    FROM pos JOIN o USING (session_id) GROUP BY session_id""",
)
def pnl_metrics(spark: SparkSession, sf: str) -> DataFrame:
    fills = _fills(spark, sf)
    placed = fills.select("session_id", "order_id").distinct().unionByName(fills.select("session_id", "order_id"))
    m = ledger.pnl_metrics(ledger.position_ledger(fills), placed)
    return m.select(
        "session_id",
        _snapc("net_pnl", 2),
        _snapc("total_commissions", 2),
        "total_fills",
        "max_position",
        "session_minutes",
        "orders_placed",
        rnd(F.col("fill_rate"), 6).alias("fill_rate"),
    )


@query(
    "drawdown",
    _LEDGER + f""", p AS (SELECT *, greatest(0, max(realized) OVER (PARTITION BY session_id, symbol ORDER BY i ROWS UNBOUNDED PRECEDING)) AS peak FROM pos)
    SELECT session_id, symbol, {_snap("max(peak - realized)", 2)} AS max_drawdown FROM p GROUP BY 1, 2""",
)
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    d = ledger.max_drawdown(_positions(spark, sf), _KEY, "realized_pnl_session", _ORDER)
    return d.select(*_KEY, _snapc("max_drawdown", 2))


_TRIPS = """, f AS (SELECT *, q = 0 AS flat, coalesce(lag(q = 0) OVER w, true) AS was FROM pos WINDOW w AS (PARTITION BY session_id, symbol ORDER BY i)),
    g AS (SELECT *, sum((was AND NOT flat)::INT) OVER (PARTITION BY session_id, symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS trip FROM f),
    trips AS (SELECT session_id, symbol, trip, min(ts) AS open_ts, max(ts) FILTER (flat) AS close_ts, arg_max(realized, i) FILTER (flat) - arg_min(realized, i) AS trip_pnl
      FROM g WHERE NOT (was AND flat) GROUP BY 1, 2, 3 HAVING count(*) FILTER (flat) > 0)"""


@query("round_trips", _LEDGER + _TRIPS + f" SELECT session_id, symbol, open_ts, close_ts, {_snap('trip_pnl', 3)} AS trip_pnl FROM trips")
def round_trips(spark: SparkSession, sf: str) -> DataFrame:
    t = ledger.round_trips(_positions(spark, sf), _KEY, _ORDER)
    return t.select(*_KEY, "open_ts", "close_ts", _snapc("trip_pnl", 3))


@query(
    "trip_summary",
    _LEDGER + _TRIPS + f""" SELECT session_id, count(*) AS round_trips, {S.rnd("count(*) FILTER (trip_pnl > 0) / count(*)::DOUBLE", 6)} AS win_rate,
    {_snap("CASE WHEN coalesce(sum(-trip_pnl) FILTER (trip_pnl <= 0), 0) > 0 THEN coalesce(sum(trip_pnl) FILTER (trip_pnl > 0), 0) / sum(-trip_pnl) FILTER (trip_pnl <= 0) ELSE 999999 END", 5)} AS profit_factor FROM trips GROUP BY 1""",
)
def trip_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = ledger.round_trips(_positions(spark, sf), _KEY, _ORDER)
    s = ledger.trip_summary(t, ["session_id"])
    return s.select("session_id", "round_trips", rnd(F.col("win_rate"), 6).alias("win_rate"), _snapc("profit_factor", 5))


@query(
    "fill_dedupe",
    "WITH " + _FILLS + """, again AS (SELECT * FROM fills UNION ALL SELECT session_id, symbol, ts + 5, order_id, trade_id, side, fill_qty, fill_price FROM fills WHERE order_id % 3 = 0)
    SELECT symbol, order_id, trade_id, min(ts) AS ts, count(*) AS copies FROM again GROUP BY 1, 2, 3""",
)
def fill_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    f = _fills(spark, sf)
    again = f.filter("order_id % 3 = 0").withColumn("ts", F.col("ts") + 5)
    rows = f.unionByName(again)
    key = ["symbol", "order_id", "trade_id"]
    copies = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    return ledger.dedupe(rows, "fill").select(*key, "ts").join(copies, key)


@query(
    "loss_limit",
    _LEDGER + " SELECT session_id, min(ts) AS breach_ts FROM pos WHERE realized < -50000 GROUP BY 1",
)
def loss_limit(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.loss_limit_breach(_positions(spark, sf), 50_000.0, "realized_pnl_session")


_STATES = """st AS (SELECT o_custkey AS c, 'C' || o_custkey AS session_id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) * 86400000 AS ts, o_orderkey AS seq,
    CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'PAUSED' ELSE 'STOPPED' END AS state, o_totalprice > 480000 AS kill FROM orders)"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return load(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("session_id"),
        (day.cast("long") * 86_400_000).alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.when(s == "O", "ACTIVE").when(s == "F", "PAUSED").otherwise("STOPPED").alias("state"),
        (F.col("o_totalprice") > 480000).alias("kill"),
    )


@query(
    "session_transitions",
    "WITH " + _STATES + """, l AS (SELECT *, lag(state) OVER (PARTITION BY session_id ORDER BY ts, seq) AS prev_state FROM st)
    SELECT session_id, ts, seq, state, prev_state FROM l WHERE state IS DISTINCT FROM prev_state""",
)
def session_transitions(spark: SparkSession, sf: str) -> DataFrame:
    t = ledger.session_transitions(_states(spark, sf), slice_ms=30 * ledger.DAY_MS, tie=["seq"])
    return t.select("session_id", "ts", "seq", "state", "prev_state")


@query(
    "kill_latch",
    "WITH " + _STATES + """, l AS (SELECT *, coalesce(max(kill::INT) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS killed FROM st)
    SELECT session_id, ts, seq, killed FROM l""",
)
def kill_latch(spark: SparkSession, sf: str) -> DataFrame:
    k = ledger.kill_latch(_states(spark, sf), F.col("kill"), ["ts", "seq"], slice_ms=30 * ledger.DAY_MS)
    return k.select("session_id", "ts", "seq", flag(F.col("killed")).alias("killed"))


# --- resting orders on the market view --------------------------------------------------

_RESTING = """o AS (SELECT symbol, seq AS order_id, ts, seq, CASE WHEN seq % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN seq % 2 = 0 THEN bid ELSE ask END AS price FROM tape WHERE NOT is_trade),
    fl AS (SELECT o.symbol, o.order_id, min(p.ts) AS fill_ts FROM o JOIN tape p ON p.symbol = o.symbol AND p.is_trade AND (p.ts > o.ts OR p.ts = o.ts AND p.seq > o.seq) AND p.ts <= o.ts + 120000
      AND CASE o.side WHEN 'BUY' THEN p.price <= o.price ELSE p.price >= o.price END GROUP BY 1, 2)"""


def _resting(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("seq") % 2 == 0
    return tape_of(spark, sf).filter("NOT is_trade").select(
        "symbol",
        F.col("seq").alias("order_id"),
        "ts",
        "seq",
        F.when(even, "BUY").otherwise("SELL").alias("side"),
        F.when(even, F.col("bid")).otherwise(F.col("ask")).alias("price"),
    )


def _touched(spark: SparkSession, sf: str) -> DataFrame:
    trades = tape_of(spark, sf).filter("is_trade").select("symbol", "ts", "seq", "price")
    return ledger.first_touch_fills(_resting(spark, sf), trades, 120_000)


@query(
    "first_touch_fills",
    TAPE + f", {_RESTING} SELECT o.symbol, o.order_id, o.side, coalesce(fill_ts, -1) AS fill_ts, CASE WHEN fill_ts IS NOT NULL THEN price END AS fill_price FROM o LEFT JOIN fl USING (symbol, order_id)",
)
def first_touch_fills(spark: SparkSession, sf: str) -> DataFrame:
    rows = _touched(spark, sf).withColumn("fill_ts", F.coalesce("fill_ts", F.lit(-1)))
    return rows.select("symbol", "order_id", "side", "fill_ts", "fill_price")


@query(
    "stale_quote_cancels",
    TAPE + f""", {_RESTING}, bk AS (SELECT symbol, ts, seq, max(CASE WHEN NOT is_trade THEN ts END) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS book_ts FROM tape),
    st AS (SELECT symbol, ts FROM bk WHERE ts - book_ts > 5000),
    c AS (SELECT o.symbol, o.order_id, fill_ts, min(st.ts) AS hit FROM o LEFT JOIN fl USING (symbol, order_id) LEFT JOIN st ON st.symbol = o.symbol AND st.ts > o.ts GROUP BY 1, 2, 3)
    SELECT symbol, order_id, coalesce(CASE WHEN fill_ts IS NULL OR fill_ts > hit THEN hit END, -1) AS cancel_ts FROM c""",
)
def stale_quote_cancels(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger.stale_quote_cancels(_touched(spark, sf), tape_of(spark, sf), 5_000)
    return rows.select("symbol", "order_id", F.coalesce("cancel_ts", F.lit(-1)).alias("cancel_ts"))


_MARKS = """ps AS (SELECT symbol, ts, seq, CASE WHEN seq % 2 = 0 THEN qty ELSE -qty END AS position_qty, price AS entry_price FROM tape WHERE is_trade),
    mk AS (SELECT p.symbol, p.seq, p.ts, any_value(position_qty) AS q, any_value(entry_price) AS e, arg_max((b.bid + b.ask) / 2, (b.ts, b.seq)) AS mid, max(b.ts) AS book_ts
      FROM ps p LEFT JOIN tape b ON b.symbol = p.symbol AND NOT b.is_trade AND b.ts <= p.ts GROUP BY 1, 2, 3)"""


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    t = tape_of(spark, sf)
    sign = F.when(F.col("seq") % 2 == 0, F.col("qty")).otherwise(-F.col("qty"))
    pos = t.filter("is_trade").select(
        "symbol", "ts", "seq", sign.alias("position_qty"), F.col("price").alias("entry_price")
    )
    return ledger.unrealized_pnl(pos, t.filter("NOT is_trade"))


@query(
    "unrealized_pnl",
    TAPE + f", {_MARKS} SELECT symbol, seq, coalesce(mid, 0) AS mark_price, CASE WHEN mid > 0 AND q <> 0 THEN q * (mid - e) ELSE 0 END AS unrealized_pnl FROM mk",
)
def unrealized_pnl(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("symbol", "seq", "mark_price", "unrealized_pnl")


@query(
    "ledger_measures",
    TAPE + f""", {_MARKS} SELECT symbol, seq, {S.rnd("abs(q) / 8", 6)} AS inventory_ratio, abs(q) * coalesce(mid, 0) AS notional,
    coalesce(ts - book_ts, -1) AS book_age_ms, CASE WHEN mid > 0 AND q <> 0 THEN q * (mid - e) ELSE 0 END + q AS total_pnl FROM mk""",
)
def ledger_measures(spark: SparkSession, sf: str) -> DataFrame:
    from ticklens.operators.asof import asof_join

    t = tape_of(spark, sf)
    books = t.filter("NOT is_trade").select("symbol", "ts", F.col("seq").alias("book_seq"))
    rows = asof_join(_marked(spark, sf), books, ["symbol"], "b", tie="book_seq")
    q = F.col("position_qty")
    return rows.select(
        "symbol",
        "seq",
        rnd(ledger.inventory_ratio(q, F.lit(8.0)), 6).alias("inventory_ratio"),
        ledger.notional(F.abs(q), F.col("mark_price")).alias("notional"),
        F.coalesce(ledger.book_age_ms(F.col("ts"), F.col("b.ts")), F.lit(-1)).alias("book_age_ms"),
        ledger.total_pnl(q, F.col("unrealized_pnl")).alias("total_pnl"),
    )


# --- policy -----------------------------------------------------------------------------

PC = PolicyConfig(inventory_hard_limit=9.0, max_session_loss=60_000.0)
QC = QuoteConfig(order_qty=1.0, max_position=5.0)

_POLICY = (
    TAPE
    + f""", {_MARKS}, ctx AS (SELECT symbol AS session_id, seq, ts, CASE WHEN seq % 5 = 0 THEN 0 ELSE q END AS q, coalesce(mid, 0) AS mid, coalesce(ts - book_ts, 0) AS age,
      CASE WHEN mid > 0 AND q <> 0 THEN q * (mid - e) ELSE 0 END AS pnl, (seq % 100) / 100.0::DOUBLE AS tox, (seq % 37) / 37.0::DOUBLE AS p2, seq % 3 AS pend FROM mk),
    ev AS (SELECT *, pnl < -{PC.max_session_loss} AS kill, abs(q) >= {PC.inventory_hard_limit} AS hard, age > {PC.stale_quote_ms} AS stale,
      tox >= {PC.toxicity_disable}::DOUBLE AS dis, tox >= {PC.toxicity_widen}::DOUBLE AS wid, p2 < {PC.inplay_exit_prob}::DOUBLE AS quiet FROM ctx),
    pol AS (SELECT *, hard OR stale OR dis AS stop, CASE WHEN kill THEN 'kill_max_loss' WHEN hard OR stale OR dis THEN concat_ws(',', CASE WHEN hard THEN 'hard_limit_block' END,
        CASE WHEN stale THEN 'stale_book_pause' END, CASE WHEN dis THEN 'toxic_disable' END) ELSE concat_ws(',', CASE WHEN wid THEN 'toxic_widen' END, CASE WHEN quiet THEN 'low_inplay_pause' END) END AS codes,
      CASE WHEN kill THEN 'FORCE_CLOSE' WHEN hard OR stale OR dis THEN 'SUPPRESS_ALL' ELSE concat_ws(',', CASE WHEN wid THEN 'MODIFY_PARAMS' END, CASE WHEN quiet THEN 'SUPPRESS_ENTRY' END) END AS patterns,
      CASE WHEN NOT kill AND NOT (hard OR stale OR dis) AND wid THEN 2.0 ELSE 1.0 END::DOUBLE AS mult,
      coalesce(max(kill::INT) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS killed FROM ev)"""
)


def _policy(spark: SparkSession, sf: str) -> DataFrame:
    from ticklens.operators.asof import asof_join

    t = tape_of(spark, sf)
    books = t.filter("NOT is_trade").select("symbol", "ts", F.col("seq").alias("book_seq"))
    m = asof_join(_marked(spark, sf), books, ["symbol"], "b", tie="book_seq")
    seq, mid = F.col("seq"), F.col("mark_price")
    ctx = m.select(
        F.col("symbol").alias("session_id"),
        "seq",
        "ts",
        F.coalesce("b.ts", F.col("ts")).alias("last_book_ts"),
        F.when(seq % 5 == 0, 0.0).otherwise(F.col("position_qty")).alias("position_qty"),
        F.lit(0.0).alias("realized_pnl"),
        "unrealized_pnl",
        mid.alias("mid"),
        (mid - 1).alias("bid"),
        (mid + 1).alias("ask"),
        ((seq % 100) / 100.0).alias("p_toxic"),
        ((seq % 37) / 37.0).alias("p_inplay_2m"),
        (seq % 3).alias("pending_order_count"),
    )
    ev = policy.evaluate_policy(ctx, PC)
    return ledger.kill_latch(ev, F.col("kill"), ["ts", "seq"], slice_ms=300_000)


@query("policy_eval", _POLICY + " SELECT session_id, seq, kill::INT AS kill, codes AS reason_codes, patterns, mult AS spread_mult, killed::INT AS killed FROM pol")
def policy_eval(spark: SparkSession, sf: str) -> DataFrame:
    return _policy(spark, sf).select(
        "session_id",
        "seq",
        flag(F.col("kill")).alias("kill"),
        joined("reason_codes").alias("reason_codes"),
        joined("patterns").alias("patterns"),
        "spread_mult",
        flag(F.col("killed")).alias("killed"),
    )


_FRAC = f"({QC.spread_bps / 10000}::DOUBLE * mult)"
_SUFFIX = "CASE WHEN codes LIKE '%toxic_widen%' THEN '_toxic' ELSE '' END"


@query(
    "quote_intents",
    _POLICY + f""", live AS (SELECT * FROM pol WHERE NOT killed), qt AS (SELECT * FROM live WHERE NOT kill AND NOT stop AND mid > 1),
    sent AS (
      SELECT session_id, seq, CASE WHEN q > 0 THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN q > 0 THEN mid - 1 ELSE mid + 1 END AS price, abs(q) AS qty, 'kill_max_loss' AS reason FROM live WHERE kill AND q <> 0
      UNION ALL SELECT session_id, seq, 'SELL', mid * (1 + {_FRAC}), least({QC.order_qty}, q), 'close_long' || {_SUFFIX} FROM qt WHERE q > 0 AND pend = 0
      UNION ALL SELECT session_id, seq, 'BUY', mid * (1 - {_FRAC}), least({QC.order_qty}, -q), 'close_short' || {_SUFFIX} FROM qt WHERE q < 0 AND pend = 0
      UNION ALL SELECT session_id, seq, 'BUY', mid * (1 - {_FRAC}), {QC.order_qty}, 'enter_long' || {_SUFFIX} FROM qt WHERE q = 0 AND pend < 2 AND NOT quiet
      UNION ALL SELECT session_id, seq, 'SELL', mid * (1 + {_FRAC}), {QC.order_qty}, 'enter_short' || {_SUFFIX} FROM qt WHERE q = 0 AND pend < 2 AND NOT quiet)
    SELECT session_id, seq, side, {S.rnd("price", 4)} AS price, qty::DOUBLE AS qty, reason FROM sent""",
)
def quote_intents(spark: SparkSession, sf: str) -> DataFrame:
    q = policy.quote_intents(_policy(spark, sf), QC)
    return q.select("session_id", "seq", "side", rnd(F.col("price"), 4).alias("price"), "qty", "reason")


# --- monitoring series ------------------------------------------------------------------

_SERIES = """ser AS (SELECT symbol AS instance, (seq - seq % 7) AS w, ts, seq, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) * 3 - CASE WHEN seq % 11 = 0 THEN 10 ELSE 0 END)::DOUBLE AS value FROM tape),
    m AS (SELECT instance, ts, max(value) AS value FROM ser GROUP BY 1, 2)"""


def _series(spark: SparkSession, sf: str) -> DataFrame:
    """A counter per symbol that grows by 3 per event and falls back now and then."""
    from ticklens.plans.slices import Run, running, slice_of

    t = tape_of(spark, sf).select("symbol", "ts", "seq").withColumn("one", F.lit(1))
    t = running(t, ["symbol"], slice_of(F.col("ts"), 60_000), ["ts", "seq"], [Run("i", "sum", F.col("one"))])
    value = (F.col("i") * 3 - F.when(F.col("seq") % 11 == 0, 10).otherwise(0)).cast("double")
    return (
        t.select(F.col("symbol").alias("instance"), "ts", value.alias("value"))
        .groupBy("instance", "ts")
        .agg(F.max("value").alias("value"))
        .withColumn("metric", F.lit("events_total"))
    )


@query(
    "counter_increase",
    TAPE + f""", {_SERIES}, g AS (SELECT *, greatest(coalesce(value - lag(value) OVER (PARTITION BY instance ORDER BY ts), 0), 0) AS growth FROM m)
    SELECT instance, ts, value, sum(growth) OVER (PARTITION BY instance ORDER BY ts RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS increase FROM g""",
)
def counter_increase(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.counter_increase(_series(spark, sf), 60_000).select("instance", "ts", "value", "increase")


@query(
    "counter_rate",
    TAPE + f""", {_SERIES}, g AS (SELECT *, greatest(coalesce(value - lag(value) OVER (PARTITION BY instance ORDER BY ts), 0), 0) AS growth FROM m)
    SELECT instance, ts, {S.rnd("sum(growth) OVER (PARTITION BY instance ORDER BY ts RANGE BETWEEN 299999 PRECEDING AND CURRENT ROW) / 300", 6)} AS rate FROM g""",
)
def counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    r = monitor.counter_rate(_series(spark, sf), 300_000)
    return r.select("instance", "ts", rnd(F.col("rate"), 6).alias("rate"))


@query(
    "ratio_breach",
    TAPE + f""", w AS (SELECT symbol AS instance, ts, max(bid_qty) AS num, max(ask_qty) AS den FROM tape WHERE NOT is_trade GROUP BY 1, 2),
    o AS (SELECT *, num / greatest(den, 1) AS ratio, num / greatest(den, 1) >= 0.5::DOUBLE AS over FROM w),
    c AS (SELECT *, CASE WHEN over IS DISTINCT FROM lag(over) OVER (PARTITION BY instance ORDER BY ts) THEN ts END AS st FROM o),
    r AS (SELECT *, max(st) OVER (PARTITION BY instance ORDER BY ts ROWS UNBOUNDED PRECEDING) AS since FROM c)
    SELECT instance, ts, {S.rnd("ratio", 6)} AS ratio, since AS status_since, ts - since AS status_ms FROM r WHERE over AND ts - since >= 20000""",
)
def ratio_breach(spark: SparkSession, sf: str) -> DataFrame:
    b = tape_of(spark, sf).filter("NOT is_trade")
    kinds = F.array(
        F.struct(F.lit("depth").alias("metric"), F.col("bid_qty").alias("value")),
        F.struct(F.lit("limit").alias("metric"), F.col("ask_qty").alias("value")),
    )
    m = b.select(F.col("symbol").alias("instance"), "ts", F.inline(kinds))
    rows = monitor.ratio_breach(m, "depth", "limit", 0.5, 20_000)
    return rows.select("instance", "ts", rnd(F.col("ratio"), 6).alias("ratio"), "status_since", "status_ms")


@query(
    "max_rate_per_min",
    TAPE + f""", {_SERIES}, j AS (SELECT a.instance, a.ts, a.value, min(b.ts) AS bts FROM m a JOIN m b ON b.instance = a.instance AND b.ts >= a.ts + 60000 GROUP BY 1, 2, 3),
    r AS (SELECT j.instance, (b.value - j.value) / ((j.bts - j.ts) / 60000.0::DOUBLE) AS rate FROM j JOIN m b ON b.instance = j.instance AND b.ts = j.bts)
    SELECT instance, {S.rnd("greatest(max(rate), 0)", 6)} AS max_rate_per_min FROM m LEFT JOIN r USING (instance) GROUP BY 1""",
)
def max_rate_per_min(spark: SparkSession, sf: str) -> DataFrame:
    s = _series(spark, sf).select("instance", "ts", F.col("value").alias("count"))
    r = monitor.max_rate_per_min(s, ["instance"])
    return r.select("instance", rnd(F.col("max_rate_per_min"), 6).alias("max_rate_per_min"))


@query(
    "threshold_checks",
    TAPE + """, s AS (SELECT symbol AS run_id, count(*)::DOUBLE AS events, max(recv_ts - ts)::DOUBLE AS max_latency_ms FROM tape GROUP BY 1)
    SELECT run_id, 'events' AS field, 'min' AS kind, 60.0::DOUBLE AS "limit", events AS value, CASE WHEN events < 60 THEN 'FAIL' ELSE 'OK' END AS result FROM s
    UNION ALL SELECT run_id, 'max_latency_ms', 'max', 48.0, max_latency_ms, CASE WHEN max_latency_ms > 48 THEN 'FAIL' ELSE 'OK' END FROM s
    UNION ALL SELECT run_id, 'max_rss_mb', 'max', 200.0, NULL, 'MISSING' FROM s""",
)
def threshold_checks(spark: SparkSession, sf: str) -> DataFrame:
    s = tape_of(spark, sf).groupBy(F.col("symbol").alias("run_id")).agg(
        F.count(F.lit(1)).cast("double").alias("events"),
        F.max(F.col("recv_ts") - F.col("ts")).cast("double").alias("max_latency_ms"),
    )
    limits = {"events": ("min", 60.0), "max_latency_ms": ("max", 48.0), "max_rss_mb": ("max", 200.0)}
    return monitor.check_thresholds(s, limits)
