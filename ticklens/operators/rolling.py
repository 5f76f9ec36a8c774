"""Rolling features on a tick grid.

Rows reach the window stage already reduced to at most one row per symbol and
cadence bucket, so a busy symbol costs no more there than a quiet one. Windows
run per (symbol, time slice) and use growing frames only, so their cost is linear in
the rows: sums over ``(t-w, t]`` are differences of growing sums, min and max join
a growing frame of the own slice with one of the slice before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ticklens.config import RANGE_WINDOW_MS, WINDOWS_MS, FeatureConfig
from ticklens.functions.market import book_imbalance, flow_imbalance, mid, spread_bps
from ticklens.functions.numeric import ratio
from ticklens.plans.slices import SLICE, slice_of, with_slices


def _ceil_to(ts: Column, step: int) -> Column:
    return (F.ceil(ts / F.lit(step)) * F.lit(step)).cast("long")


_TAPE_COLS = ["is_trade", "price", "qty", "is_buyer_maker", "bid", "ask", "bid_qty", "ask_qty"]


def bucket_tape(
    tape: DataFrame, bucket_ms: int, order: Sequence[str] = ("ts", "seq"), cut: DataFrame | None = None
) -> DataFrame:
    """One row per (symbol, bucket end): mergeable trade sums and the last book.

    Price order inside a bucket matters for direction reversals, hence one
    shuffle of the raw rows by (symbol, bucket); lags and sums share it. With
    ``cut`` (ts, by) the rows of an instant after ``by`` form a bucket of their own.
    """
    place = F.struct(*order)
    cols = ["symbol", *order, *_TAPE_COLS, _ceil_to(F.col("ts"), bucket_ms).alias("bts")]
    keys = ["symbol", "bts"]
    tape = tape.select("symbol", *order, *_TAPE_COLS)
    if cut is not None:
        tape = tape.join(cut.select("ts", "by"), "ts", "left")
        cols.append(F.coalesce((place > F.col("by")).cast("int"), F.lit(0)).alias("late"))
        keys.append("late")
    rows = tape.select(*cols).repartition("symbol", "bts")
    # Trades sort before books, so the lags of a trade only ever see trades.
    w = Window.partitionBy(*keys).orderBy(F.col("is_trade").desc(), *order)
    rows = rows.select(
        "*",
        F.row_number().over(w).alias("rn"),
        F.lag("price", 1).over(w).alias("p1"),
        F.lag("price", 2).over(w).alias("p2"),
    )
    trade = F.col("is_trade")
    seller = F.col("is_buyer_maker")
    on_trade = F.when(trade, place)
    turn = (F.col("price") - F.col("p1")) * (F.col("p1") - F.col("p2")) < 0
    return rows.groupBy(*keys).agg(
        F.count_if(trade).alias("n"),
        F.sum("qty").alias("vol"),
        F.sum(F.when(~seller, F.col("qty")).when(seller, F.lit(0.0))).alias("buy"),
        F.sum(F.when(seller, F.col("qty")).when(~seller, F.lit(0.0))).alias("sell"),
        F.sum(F.col("price") * F.col("qty")).alias("pv"),
        F.sum("price").alias("psum"),
        F.min("price").alias("pmin"),
        F.max("price").alias("pmax"),
        F.max(F.when(trade & (F.col("rn") == 1), F.col("price"))).alias("first_px"),
        F.max(F.when(trade & (F.col("rn") == 2), F.col("price"))).alias("second_px"),
        F.max_by("price", on_trade).alias("last_px"),
        F.max_by("p1", on_trade).alias("before_last_px"),
        F.count_if(trade & turn).alias("turns"),
        F.max(F.when(trade, F.col("ts"))).alias("trade_ts"),
        F.max(F.when(~trade, F.col("ts"))).alias("book_ts"),
        F.max_by(
            F.struct("bid", "ask", "bid_qty", "ask_qty"), F.when(~trade, place)
        ).alias("book"),
    )


_BUCKET_COLS = [
    "n", "vol", "buy", "sell", "pv", "psum", "pmin", "pmax", "first_px", "second_px",
    "last_px", "before_last_px", "turns", "trade_ts", "book_ts", "book",
]


def _carry_in(
    tape: DataFrame, slice_ms: int, end_ts: Column, order: Sequence[str] = ("ts", "seq")
) -> DataFrame:
    """Every slice of every symbol up to ``end_ts`` with the state that comes into it.

    Partial aggregates per (symbol, slice) straight from the tape, then a scan over
    the slices of a symbol: one row per slice, whatever the number of events.
    """
    trade = F.col("is_trade")
    per = (
        tape.withColumn(SLICE, slice_of(F.col("ts"), slice_ms))
        .groupBy("symbol", SLICE)
        .agg(
            F.min("ts").alias("first_ts"),
            F.max(
                F.when(~trade, F.struct(*order, "bid", "ask", "bid_qty", "ask_qty"))
            ).alias("quote"),
            F.max(F.when(trade, F.col("ts"))).alias("trade_ts"),
        )
    )
    by_slice = Window.partitionBy("symbol").orderBy(SLICE)
    so_far = by_slice.rowsBetween(Window.unboundedPreceding, 0)
    spans = per.select(
        "symbol",
        F.col(SLICE).alias("since"),
        F.lead(SLICE).over(by_slice).alias("until"),
        F.min("first_ts").over(so_far).alias("first_ts"),
        F.last("quote", ignorenulls=True).over(so_far).alias("quote"),
        F.max("trade_ts").over(so_far).alias("trade_ts"),
    )
    # The state after slice s comes into s+1, s+2, ... until the next slice with events.
    last = F.least(F.coalesce(F.col("until"), slice_of(end_ts, slice_ms)), slice_of(end_ts, slice_ms))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("since")) == 1
    spans = spans.withColumn("is_first", first).withColumn("last", last)
    entered = spans.filter(F.col("last") > F.col("since")).select(
        "symbol",
        F.explode(F.sequence(F.col("since") + 1, F.col("last"))).alias(SLICE),
        "first_ts",
        F.col("quote.ts").alias("book_ts"),
        F.struct("quote.bid", "quote.ask", "quote.bid_qty", "quote.ask_qty").alias("b"),
        "trade_ts",
    )
    entered = entered.withColumn("book", F.when(F.col("book_ts").isNotNull(), F.col("b"))).drop("b")
    fresh = spans.filter("is_first").select("symbol", F.col("since").alias(SLICE), "first_ts")
    return entered.unionByName(fresh, allowMissingColumns=True)


TASK_ROWS = 150_000  # of the window stage, whose rows are wide
FEW_TASKS = 12  # up to here the session's own number does


def _tasks(tape: DataFrame, cadence_ms: int) -> int:
    """How many tasks the window stage needs: ticks of all symbols at most, each bucket in two slices.

    Counted in one pass, since the number of shuffle partitions does not follow the input.
    """
    row = tape.agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("symbol").alias("symbols"), (F.max("ts") - F.min("ts")).alias("span")
    ).first()
    ticks = row["symbols"] * ((row["span"] or 0) // cadence_ms + 2)
    return -(-(ticks + 2 * row["n"]) // TASK_ROWS)


# Rows of one instant, in order: what a tick sees, the tick, what comes after it.
_STEPS = 4
_SEEN, _TICK, _AFTER, _STATE = range(_STEPS)


def _pos(t: Column, step: int | Column) -> Column:
    """Place in time: one number, so range frames can end before or after a tick."""
    return t * _STEPS + step


def _state_rows(spine: DataFrame, slice_ms: int) -> DataFrame:
    """One row right in front of each slice that holds the state coming in."""
    return spine.select(
        "symbol",
        SLICE,
        _pos(F.col(SLICE) * slice_ms - 1, _STATE).alias("pos"),
        "book",
        "book_ts",
        "trade_ts",
    )


def _grid(spine: DataFrame, cadence_ms: int, slice_ms: int, end_ts: Column) -> DataFrame:
    """Ticks on the epoch grid, from a symbol's first event to the end of the tape."""
    lo = F.greatest(_ceil_to(F.col("first_ts"), cadence_ms), _ceil_to(F.col(SLICE) * slice_ms, cadence_ms))
    hi = F.least(end_ts, (F.col(SLICE) + 1) * slice_ms - 1)
    step = F.lit(cadence_ms).cast("long")
    return (
        spine.select("symbol", SLICE, lo.alias("lo"), hi.alias("hi"))
        .filter(F.col("hi") >= F.col("lo"))
        .select("symbol", SLICE, F.explode(F.sequence("lo", "hi", step)).alias("t"))
    )


def rolling_columns(
    tape: DataFrame,
    cfg: FeatureConfig = FeatureConfig(),
    ticks: DataFrame | None = None,
    cut: DataFrame | None = None,
    order: Sequence[str] = ("ts", "seq"),
    windows: dict[str, int] | None = None,
    range_ms: int = RANGE_WINDOW_MS,
) -> DataFrame:
    """Flat rolling values at each (symbol, tick).

    Without ``ticks`` the instants are the epoch grid of ``cfg.cadence_ms`` from a
    symbol's first event to the end of the tape. With ``ticks`` (columns symbol,
    ts) any instants do, at the price of 1 ms buckets; ``cut`` (ts, by) then names
    the last event, in ``order``, that the tick of an instant sees.
    """
    windows = WINDOWS_MS if windows is None else windows
    if max(windows.values()) > range_ms:
        raise ValueError("range_ms must be the longest window")
    on_grid = ticks is None
    bucket_ms = reduce(gcd, [*windows.values(), range_ms, cfg.cadence_ms]) if on_grid else 1
    # One slice is one range window: a frame spans its own slice and the one before.
    slice_ms = range_ms
    step = F.lit(_SEEN) if cut is None else F.when(F.col("late") == 1, _AFTER).otherwise(_SEEN)
    copies = with_slices(
        bucket_tape(tape, bucket_ms, order, cut), "bts", slice_ms, back_ms=range_ms - bucket_ms
    ).select("symbol", SLICE, _pos(F.col("bts"), step).alias("pos"), *_BUCKET_COLS)
    if on_grid:
        end_ts = tape.agg(_ceil_to(F.max("ts"), cfg.cadence_ms)).scalar()
        spine = _carry_in(tape, slice_ms, end_ts, order)
        asked = _grid(spine, cfg.cadence_ms, slice_ms, end_ts)
    else:
        spine = _carry_in(tape, slice_ms, ticks.agg(F.max("ts")).scalar(), order)
        t = F.col("ts")
        asked = ticks.select("symbol", slice_of(t, slice_ms).alias(SLICE), t.alias("t"))
    asked = asked.select("symbol", SLICE, _pos(F.col("t"), _TICK).alias("pos"))
    rows = copies.unionByName(_state_rows(spine, slice_ms), allowMissingColumns=True)
    rows = rows.unionByName(asked, allowMissingColumns=True)
    tasks = _tasks(tape, cfg.cadence_ms) if on_grid else 0
    if tasks > FEW_TASKS:
        conf = tape.sparkSession.conf
        if tasks > int(conf.get("spark.sql.shuffle.partitions")):  # later shuffles have as many rows; small parts coalesce
            conf.set("spark.sql.shuffle.partitions", str(tasks))
        rows = rows.repartition(tasks, "symbol", SLICE)

    part = Window.partitionBy("symbol", SLICE)
    by_pos = part.orderBy("pos")
    so_far = by_pos.rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    has = F.col("n") > 0

    # Prices just before a bucket, for the reversals across bucket borders.
    tail = F.when(has, F.struct("last_px", "before_last_px"))
    rows = rows.withColumn("prev", F.last(tail, ignorenulls=True).over(earlier))
    tail2 = F.when(has, F.struct(F.col("prev.last_px").alias("x")))
    prev2 = F.last(tail2, ignorenulls=True).over(earlier)
    rows = rows.withColumn("before_prev", F.coalesce(F.col("prev.before_last_px"), prev2["x"]))

    def turn(a: Column, b: Column, c: Column) -> Column:
        return F.when((c - b) * (b - a) < 0, 1).otherwise(0)

    f1 = turn(F.col("before_prev"), F.col("prev.last_px"), F.col("first_px"))
    f2 = turn(F.col("prev.last_px"), F.col("first_px"), F.col("second_px"))
    rows = rows.withColumn("edge", F.when(has, F.struct("n", f1.alias("f1"), f2.alias("f2"))))
    rows = rows.withColumn("all_turns", F.col("turns") + F.col("edge.f1") + F.col("edge.f2"))
    # A frame's first two prices carry no reversal: what to take off again when a
    # frame starts right after this bucket.
    ahead = "lead(edge, {}) ignore nulls over (partition by symbol, slice order by pos)"
    zero = F.lit(0)
    rows = rows.withColumn("e1", F.expr(ahead.format(1))).withColumn("e2", F.expr(ahead.format(2)))
    off = F.coalesce(F.col("e1.f1") + F.col("e1.f2"), zero) + F.when(
        F.col("e1.n") == 1, F.coalesce(F.col("e2.f1"), zero)
    ).otherwise(zero)

    # Growing sums; a window's sum is the difference of two of them. Offsets count
    # from a tick's place: the frame of w ends after all rows of the instant t - w.
    home = F.col("pos") >= F.col(SLICE) * (slice_ms * _STEPS)
    sums = ["n", "vol", "buy", "sell", "pv", "psum", "all_turns"]
    rows = rows.select(
        "symbol",
        SLICE,
        "pos",
        F.when(has, off).alias("off"),
        F.struct(*[F.coalesce(F.sum(c).over(so_far), zero).alias(c) for c in sums]).alias("cum"),
        F.last("book", ignorenulls=True).over(so_far).alias("last_book"),
        F.max("book_ts").over(so_far).alias("last_book_ts"),
        F.max("trade_ts").over(so_far).alias("last_trade_ts"),
        F.when(~home, F.col("pmin")).alias("pmin_before"),
        F.when(~home, F.col("pmax")).alias("pmax_before"),
        F.min(F.when(home, F.col("pmin"))).over(so_far).alias("pmin_home"),
        F.max(F.when(home, F.col("pmax"))).over(so_far).alias("pmax_home"),
    )
    frames = {**windows, "range": range_ms}

    def gone_by(w: int) -> WindowSpec:
        return by_pos.rangeBetween(Window.unboundedPreceding, (_STEPS - 1 - _TICK) - w * _STEPS)

    olds = [F.last("cum").over(gone_by(w)).alias(f"old_{k}") for k, w in frames.items()]
    gone = F.last("off", ignorenulls=True).over(gone_by(range_ms))
    # Rows of the slice before that are still in the frame: a growing frame as well,
    # when time runs backwards.
    backwards = part.orderBy(F.col("pos").desc()).rangeBetween(
        Window.unboundedPreceding, (range_ms - 1) * _STEPS + _TICK
    )
    rows = rows.select("*", *olds, F.coalesce(gone, zero).alias("gone")).select(
        "*",
        F.min("pmin_before").over(backwards).alias("pmin_halo"),
        F.max("pmax_before").over(backwards).alias("pmax_halo"),
    )

    def grown(c: str, k: str) -> Column:
        return F.col(f"cum.{c}") - F.coalesce(F.col(f"old_{k}.{c}"), zero)

    return rows.filter(F.col("pos") % _STEPS == _TICK).select(
        "symbol",
        F.floor(F.col("pos") / _STEPS).cast("long").alias("ts"),
        *[grown(c, k).alias(f"{c}_{k}") for k in windows for c in ("n", "vol", "buy", "sell", "pv")],
        grown("n", "range").alias("n_range"),
        grown("psum", "range").alias("psum_range"),
        F.least("pmin_home", "pmin_halo").alias("pmin_range"),
        F.greatest("pmax_home", "pmax_halo").alias("pmax_range"),
        (grown("all_turns", "range") - F.col("gone")).alias("turns_range"),
        "last_book",
        "last_book_ts",
        "last_trade_ts",
    )


def feature_columns(roll: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Flat features from rolling values: symbol, ts, features, window sums, health."""
    b = F.col("last_book")
    bid, ask = b["bid"], b["ask"]
    natr = F.when(
        F.col("n_range") >= 2,
        ratio(
            F.col("pmax_range") - F.col("pmin_range"), F.col("psum_range") / F.col("n_range")
        ),
    ).otherwise(F.lit(0.0))
    spread = spread_bps(bid, ask)
    avg_qty = F.col("vol_w10s") / F.col("n_w10s")
    impact = F.when(
        (F.col("n_w10s") > 0) & (avg_qty > 0),
        spread * (1 + F.lit(cfg.impact_ref_qty) / avg_qty * 0.1),
    ).otherwise(spread)
    trend = (F.col("n_range") >= cfg.trend_min_prices) & (
        F.col("turns_range") / (F.col("n_range") - 1) < cfg.trend_max_reversals
    )
    age = lambda c: F.coalesce(F.col("ts") - F.col(c), F.lit(0)).cast("long")
    rows = roll.select(
        "symbol",
        "ts",
        spread.alias("spread_bps"),
        F.when(mid(bid, ask) > 0, mid(bid, ask)).otherwise(F.lit(1.0)).alias("mid"),
        book_imbalance(b["bid_qty"], b["ask_qty"]).alias("book_imbalance"),
        flow_imbalance(F.col("buy_w10s"), F.col("sell_w10s")).alias("flow_imbalance"),
        natr.alias("natr_14_5m"),
        impact.alias("impact_bps_q"),
        F.when(natr > cfg.high_vol_natr, "high").otherwise("low").alias("regime_vol"),
        F.when(trend, "trend").otherwise("chop").alias("regime_trend"),
        *[
            F.struct(
                F.col(f"n_{w}").alias("trade_count"),
                F.col(f"vol_{w}").cast("double").alias("volume"),
                F.col(f"buy_{w}").cast("double").alias("buy_volume"),
                F.col(f"sell_{w}").cast("double").alias("sell_volume"),
                ratio(F.col(f"pv_{w}"), F.col(f"vol_{w}")).alias("vwap"),
            ).alias(w)
            for w in WINDOWS_MS
        ],
        age("last_book_ts").alias("stale_book_ms"),
        age("last_trade_ts").alias("stale_trades_ms"),
    )
    missing = F.array_compact(
        F.array(
            F.when(F.col("stale_book_ms") > cfg.missing_book_ms, F.lit("book")),
            F.when(F.col("stale_trades_ms") > cfg.missing_trades_ms, F.lit("trades")),
        )
    )
    return rows.withColumn("missing_streams", missing)


FEATURES = [
    "spread_bps", "mid", "book_imbalance", "flow_imbalance", "natr_14_5m", "impact_bps_q",
    "regime_vol", "regime_trend",
]


def feature_snapshots(
    tape: DataFrame,
    cfg: FeatureConfig = FeatureConfig(),
    ticks: DataFrame | None = None,
    cut: DataFrame | None = None,
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """Nested snapshot rows: ts, symbol, features, windows, data_health."""
    flat = feature_columns(rolling_columns(tape, cfg, ticks, cut, order), cfg)
    return flat.select(
        "ts",
        "symbol",
        F.struct(*FEATURES).alias("features"),
        F.struct(*WINDOWS_MS).alias("windows"),
        F.struct("stale_book_ms", "stale_trades_ms", "missing_streams").alias("data_health"),
    )


def limit_symbols(tape: DataFrame, max_symbols: int = 500) -> DataFrame:
    """Keep only the first ``max_symbols`` symbols by first arrival; the rest are ignored."""
    first = tape.groupBy("symbol").agg(F.min(F.struct("ts", "recv_ts", "seq")).alias("first"))
    kept = first.orderBy("first", "symbol").limit(max_symbols).select("symbol")
    # Spark knows the limit's size and broadcasts it when it is small enough.
    return tape.join(kept, "symbol", "left_semi")
