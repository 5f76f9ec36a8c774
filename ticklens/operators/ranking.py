"""Scores, ranks per tick, hysteresis and the confirmed list."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.config import RankConfig, ScoreConfig
from ticklens.functions.predict import score
from ticklens.plans.cells import by_cell_arrays, column
from ticklens.plans.slices import SLICE, Run, home_rows, running, slice_of, with_slices
from ticklens.session import cut_lineage


def with_score(pred: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    return pred.withColumn("score", score(cfg))


def rank_scores(scored: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """1-based position per tick by (score desc, symbol) among scores over the threshold.

    The threshold goes last: as a filter under the window it would push the whole score
    expression down to the scan, which costs the optimizer more than it saves.
    """
    over = F.col("score") >= cfg.score_threshold
    w = Window.partitionBy("ts").orderBy(over.desc(), F.col("score").desc(), "symbol")
    return scored.withColumn("position", F.row_number().over(w)).filter(over)


def top_k(scored: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """Members of the top k per tick (row_number <= k is cut before the shuffle)."""
    return rank_scores(scored, cfg).filter(F.col("position") <= cfg.top_k)


# States of the membership machine.
OUT, ENTERING, IN, LEAVING = "NOT_IN_TOP_K", "PENDING_ENTER", "IN_TOP_K", "PENDING_EXIT"
OLD = -(2**62)  # a state held for longer than any threshold looks back


def _settle(ts, member, state: str, since: int, cfg: RankConfig):
    """Walk the runs of equal membership; yields (index, new state, since)."""
    n = len(ts)
    i = 0
    while i < n:
        j = i + 1
        while j < n and member[j] == member[i]:
            j += 1
        k = i
        while k < j:
            if member[i]:
                if state == OUT:
                    state = ENTERING if cfg.enter_ms else IN
                    since = int(ts[k])
                elif state == LEAVING:
                    state, since = IN, int(ts[k])
                elif state == ENTERING:
                    k = max(k, bisect.bisect_left(ts, since + cfg.enter_ms, k, j))
                    if k == j:
                        break
                    state, since = IN, int(ts[k])
                else:
                    break
            else:
                if state == ENTERING:
                    state, since = OUT, int(ts[k])
                elif state == IN:
                    k = bisect.bisect_left(ts, since + cfg.min_dwell_ms, k, j)
                    if k == j:
                        break
                    state = LEAVING if cfg.exit_ms else OUT
                    since = int(ts[k])
                elif state == LEAVING:
                    k = bisect.bisect_left(ts, since + cfg.exit_ms, k, j)
                    if k == j:
                        break
                    state, since = OUT, int(ts[k])
                else:
                    break
            yield k, state, since
            k += 1
        i = j


def hysteresis(membership: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """State of each (symbol, tick) and the ENTER/EXIT events.

    ``membership``: symbol, ts, member (and any columns to keep). A symbol's ticks
    are cut into slices; each slice is first reduced to "state in -> state out" for
    every state that can come in, the reductions of a symbol are chained, then every
    slice runs with its true entry state.
    """
    back = max(cfg.enter_ms, cfg.exit_ms, cfg.min_dwell_ms)
    cells = ["symbol", SLICE]
    slim = membership.select("symbol", "ts", "member")
    rows = with_slices(slim, "ts", cfg.slice_ms, back_ms=back)

    def reduce_slice(table: pa.Table, starts: np.ndarray) -> dict[str, object]:
        all_ts, inside, home = column(table, "ts"), column(table, "member"), column(table, "ts") // cfg.slice_ms == column(table, SLICE)
        at, out = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(all_ts)], strict=True):
            own = home[a:b]
            if not own.any():
                continue
            before = all_ts[a:b][~own].tolist()
            ts, member = all_ts[a:b][own].tolist(), inside[a:b][own].tolist()
            for s_in, t_in in [(OUT, OLD)] + [(s, t) for s in (ENTERING, IN, LEAVING) for t in [OLD, *before]]:
                s, t = s_in, t_in
                for _, s, t in _settle(ts, member, s_in, t_in, cfg):
                    pass
                at.append(a)
                out.append((s_in, t_in, s, OLD if s == OUT else t))
        return taken(table, at) | dict(zip(("s_in", "t_in", "s_out", "t_out"), zip(*out, strict=True) if out else [[]] * 4, strict=True))

    def taken(table: pa.Table, at: list[int]) -> dict[str, object]:
        some = table.select(cells).take(pa.array(at, pa.int64()))
        return {c: some.column(c).combine_chunks() for c in cells}

    def chain(table: pa.Table, starts: np.ndarray) -> dict[str, object]:
        slices, s_in, t_in, s_out, t_out = (table.column(c).to_pylist() for c in (SLICE, "s_in", "t_in", "s_out", "t_out"))
        fresh, at, out, i, n = set(starts.tolist()), [], [], 0, len(slices)
        while i < n:
            if i in fresh:
                state, since = OUT, OLD
            j, moves = i, {}
            while j < n and slices[j] == slices[i] and (j == i or j not in fresh):
                moves[s_in[j], t_in[j]] = (s_out[j], t_out[j])
                j += 1
            if (state, since) not in moves:
                since = OLD  # older than anything this slice can tell apart
            at.append(i)
            out.append((state, since))
            state, since = moves[state, since]
            i = j
        return taken(table, at) | dict(zip(("s_in", "t_in"), zip(*out, strict=True) if out else [[]] * 2, strict=True))

    keep = [f for f in membership.schema.fields if f.name not in ("symbol", "ts", "member")]
    names = [f.name for f in keep]

    def run_slice(table: pa.Table, starts: np.ndarray) -> dict[str, object]:
        """The first row of a cell has its entry."""
        all_ts, inside, s_in, t_in = (table.column(c).to_pylist() for c in ("ts", "member", "_s_in", "_t_in"))
        states, events, own = [], [], np.ones(len(all_ts), bool)
        own[starts] = False
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(all_ts)], strict=True):
            ts, member, state, at = all_ts[a + 1 : b], inside[a + 1 : b], s_in[a], 0
            said = [None] * len(ts)
            for k, new, _ in _settle(ts, member, state, t_in[a], cfg):
                states += [state] * (k - at)
                if new == IN and state in (OUT, ENTERING):
                    said[k] = "SYMBOL_ENTER"
                elif new == OUT and state in (IN, LEAVING):
                    said[k] = "SYMBOL_EXIT"
                state, at = new, k
            states += [state] * (len(ts) - at)
            events += said
        rows = table.select(["symbol", "ts", "member", *names]).filter(pa.array(own))
        return {c: rows.column(c).combine_chunks() for c in rows.column_names} | {"state": states, "event": events}

    state_in = f"symbol string, {SLICE} long, s_in string, t_in long"
    maps = by_cell_arrays(rows, cells, ["ts"], reduce_slice, f"{state_in}, s_out string, t_out long")
    entries = by_cell_arrays(maps, ["symbol"], [SLICE], chain, state_in)
    schema = slim.select("symbol", "ts", "member").schema
    for f in keep:
        schema = schema.add(f)
    schema = schema.add("state", "string").add("event", "string")
    own = membership.withColumn(SLICE, slice_of(F.col("ts"), cfg.slice_ms)).withColumn("_own", F.lit(True))
    first = entries.select("symbol", SLICE, F.col("s_in").alias("_s_in"), F.col("t_in").alias("_t_in"), F.lit(False).alias("_own"))
    both = own.unionByName(first, allowMissingColumns=True)
    return by_cell_arrays(both, cells, ["_own", "ts"], run_slice, schema)


def membership(scored: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """symbol, ts, score, position (null under the threshold), member of the raw top k."""
    over = F.col("score") >= cfg.score_threshold
    w = Window.partitionBy("ts").orderBy(over.desc(), F.col("score").desc(), "symbol")
    position = F.when(over, F.row_number().over(w))
    rows = scored.select("symbol", "ts", "score", position.alias("position"))
    return rows.withColumn("member", F.coalesce(F.col("position") <= cfg.top_k, F.lit(False)))


def confirmed_top_k(states: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """Add ``rank`` (0-based place in the confirmed list, null outside of it)."""
    listed = F.col("position").isNotNull() & (F.col("state") != OUT)
    w = Window.partitionBy("ts").orderBy(listed.desc(), F.col("score").desc(), "symbol")
    place = F.row_number().over(w) - 1
    return states.withColumn("rank", F.when(listed & (place < cfg.top_k), place))


def ranked_states(scored: DataFrame, cfg: RankConfig = RankConfig(), absent: bool = False) -> DataFrame:
    """Hysteresis states with ``rank``, ``prev_rank`` (last tick's list), ``held_rank`` (last
    one before this tick) and ``last_rank`` (this tick included).

    With ``absent``, symbols that a tick leaves out go on with score 0 (``with_absent``).
    """
    members = cut_lineage(membership(scored, cfg))  # read twice below
    if absent:
        members = cut_lineage(with_absent(members, cfg))
    ranked = cut_lineage(confirmed_top_k(hysteresis(members, cfg), cfg))
    runs = [
        Run("_prev", "last", F.struct("rank"), inclusive=False),
        Run("held_rank", "last", F.col("rank"), inclusive=False),
        Run("last_rank", "last", F.col("rank")),
    ]
    out = running(ranked, ["symbol"], slice_of(F.col("ts"), cfg.slice_ms), ["ts"], runs)
    return out.withColumn("prev_rank", F.col("_prev.rank")).drop("_prev")


def rank_events(states: DataFrame) -> DataFrame:
    """ENTER carries the place in the previous list (0 if absent), EXIT the last held one."""
    entered = F.col("event") == "SYMBOL_ENTER"
    rank = F.when(entered, F.col("prev_rank")).otherwise(F.col("held_rank"))
    return states.filter(F.col("event").isNotNull()).select(
        "ts", "event", "symbol", F.coalesce(rank, F.lit(0)).cast("int").alias("rank"), "score"
    )


def score_deltas(scored: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """Largest score change per tick among listed symbols, against the tick before."""
    was = Run("was", "last", F.col("score"), inclusive=False)
    rows = scored.select("symbol", "ts", "score")
    rows = running(rows, ["symbol"], slice_of(F.col("ts"), cfg.slice_ms), ["ts"], [was])
    delta = F.abs(F.col("score") - F.coalesce("was", F.lit(0.0)))
    return (
        rows.filter(F.col("score") >= cfg.score_threshold)
        .groupBy("ts")
        .agg(F.max(delta).alias("max_delta"))
    )


def ranker_metrics(states: DataFrame, ticks: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """One row: updates, enter and exit events, list changes, throttled updates.

    ``ticks`` is the result of ``throttle``: every update, whether it was ranked or skipped.
    """
    listed = F.when(F.col("rank").isNotNull(), F.struct("rank", "symbol"))
    lists = states.groupBy("ts").agg(
        F.sort_array(F.collect_list(listed)).alias("names"),  # at most k per tick
        F.count_if(F.col("event") == "SYMBOL_ENTER").alias("entered"),
        F.count_if(F.col("event") == "SYMBOL_EXIT").alias("left"),
    )
    was = Run("was", "last", F.col("names"), inclusive=False)
    rows = running(lists, [], slice_of(F.col("ts"), cfg.slice_ms), ["ts"], [was])
    empty = F.size("names") == 0
    changed = F.when(F.col("was").isNull(), ~empty).otherwise(F.col("names") != F.col("was"))
    totals = rows.agg(
        F.sum("entered").alias("enter_events"),
        F.sum("left").alias("exit_events"),
        F.count_if(changed).alias("rank_changes"),
    )
    updates = ticks.agg(
        F.count(F.lit(1)).alias("updates_processed"), F.count_if(~F.col("accepted")).alias("updates_throttled")
    )
    one = F.lit(1).alias("_one")  # a row on either side
    return updates.select("*", one).join(totals.select("*", one), "_one").drop("_one")


def accepted(scored: DataFrame, ticks: DataFrame) -> DataFrame:
    """The rows of the ticks that ``throttle`` lets through."""
    return scored.join(ticks.filter("accepted").select("ts"), "ts", "left_semi")


def _first_after(ticks: DataFrame, at: Column, value: Column, out: str, slice_ms: int) -> DataFrame:
    """Add ``out``: ``value`` of the first tick at or after the time ``at`` of each tick; null beyond the last."""
    asks = ticks.withColumns({"_down": -at, "_kind": F.lit(1), "_mark": F.lit(None).cast("long")})
    marks = ticks.select((-F.col("ts")).alias("_down"), F.lit(0).alias("_kind"), value.cast("long").alias("_mark"))
    both = asks.unionByName(marks, allowMissingColumns=True)
    both = running(both, [], slice_of(F.col("_down"), slice_ms), ["_down", "_kind"], [Run(out, "last", F.col("_mark"))])
    return both.filter("_kind = 1").select(*ticks.columns, out)


def _moves(scored: DataFrame, cfg: RankConfig) -> DataFrame:
    """(ts, moved_at): the first later tick within the interval at which a score has moved enough since ``ts``."""
    span = cfg.update_interval_ms
    rows = with_slices(scored, "ts", cfg.slice_ms, forward_ms=span)
    ahead = Window.partitionBy("symbol", SLICE).orderBy("ts").rangeBetween(1, span - 1)
    later = F.collect_list(F.struct("ts", "score")).over(ahead)  # ticks of one interval
    far = lambda r: (r["score"] >= cfg.score_threshold) & (F.abs(r["score"] - F.col("score")) >= cfg.burst_delta)
    hits = F.transform(F.filter("_later", far), lambda r: r["ts"])
    rows = rows.withColumn("_later", later).withColumn("moved_at", F.array_min(hits))
    return home_rows(rows, "ts", cfg.slice_ms).groupBy("ts").agg(F.min("moved_at").alias("moved_at"))


def _returns(scored: DataFrame, ticks: DataFrame, cfg: RankConfig) -> DataFrame:
    """(symbol, ts, gone, hit): rows after ticks without the symbol, whose last tick before is ``gone``.

    ``hit`` is the symbol's first row from there on with a high score: a move for an update that lacks the symbol.
    """
    cell = slice_of(F.col("ts"), cfg.slice_ms)
    rows = running(scored, ["symbol"], cell, ["ts"], [Run("gone", "last", F.col("ts"), inclusive=False)])
    high = F.when(F.col("score") >= max(cfg.score_threshold, cfg.burst_delta), F.col("ts"))
    rows = rows.withColumns({"_high": high, "_down": -F.col("ts")})
    rows = running(rows, ["symbol"], slice_of(F.col("_down"), cfg.slice_ms), ["_down"], [Run("hit", "last", F.col("_high"))])
    rows = rows.filter("gone IS NOT NULL AND hit IS NOT NULL").join(ticks.select("ts", "was"), "ts")
    return rows.filter((F.col("gone") < F.col("was")) & (F.col("hit") - F.col("was") < cfg.update_interval_ms)).select(
        "symbol", "ts", "gone", "hit"
    )


def _backs(returns: DataFrame, known: DataFrame, ticks: DataFrame, cfg: RankConfig) -> DataFrame:
    """(ts, back): the first move that an update at ``ts`` would see in a symbol which it lacks and which was known by then."""
    span = cfg.update_interval_ms
    near = with_slices(ticks.select("ts"), "ts", cfg.slice_ms, back_ms=span)
    behind = Window.partitionBy(SLICE).orderBy("ts").rangeBetween(1 - span, -1)
    near = home_rows(near.withColumn("_before", F.collect_list("ts").over(behind)), "ts", cfg.slice_ms)
    low = F.greatest(F.col("gone"), F.col("hit") - span, F.col("since") - 1)
    rows = returns.join(known, "symbol").select("ts", "hit", low.alias("_low")).join(near, "ts")
    rows = rows.select("hit", F.explode(F.filter("_before", lambda x: x > F.col("_low"))).alias("ts"))
    return rows.groupBy("ts").agg(F.min("hit").alias("back"))


def _reached(ticks: DataFrame) -> DataFrame:
    """The ticks that pointers ``nxt`` lead to from the free ones, by doubling: pointers of 1, 2, 4, … steps.

    A pointer to a free tick ends there, since it is reached anyway. Rounds grow with the logarithm of the longest
    chain between two free ticks.
    """
    free = ticks.filter("free").select(F.col("ts").alias("nxt"), F.lit(True).alias("_end"))
    jump = ticks.select("ts", "nxt").filter("nxt IS NOT NULL").join(free, "nxt", "left").filter("_end IS NULL")
    jump = cut_lineage(jump.select("ts", "nxt"))
    marked = cut_lineage(ticks.filter("free").select("ts"))
    while not jump.isEmpty():
        found = marked.join(jump, "ts").select(F.col("nxt").alias("ts"))
        marked = cut_lineage(marked.unionByName(found).distinct())
        onward = jump.select(F.col("ts").alias("nxt"), F.col("nxt").alias("_to"))
        jump = cut_lineage(jump.join(onward, "nxt").select("ts", F.col("_to").alias("nxt")))
    return marked


def throttle(scored: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """(ts, accepted) per tick: an update soon after the last accepted one is skipped
    unless a score moved by ``burst_delta`` since the last accepted update.

    Which tick is accepted after another depends on these two alone, but for symbols that the first lacks: such a one counts as 0
    if an accepted update had it before, and not at all if none had. So every tick has a pointer to the
    next one accepted, and the accepted ticks are those that pointers reach from ticks that are always accepted, at least an
    interval after the tick before. When symbols became known is taken from all ticks first, then from those
    accepted, until nothing changes; an error can only be after the first symbol that was known too early, so each time the
    sequence is right for longer.
    """
    scored = cut_lineage(scored.select("symbol", "ts", "score"))
    ticks = scored.select("ts").distinct()
    was = Run("was", "last", F.col("ts"), inclusive=False)
    ticks = running(ticks, [], slice_of(F.col("ts"), cfg.slice_ms), ["ts"], [was])
    free = F.col("was").isNull() | (F.col("ts") - F.col("was") >= cfg.update_interval_ms)
    ticks = ticks.withColumn("free", free)
    ticks = _first_after(ticks, F.col("ts") + cfg.update_interval_ms, F.col("ts"), "after", cfg.slice_ms)
    ticks = cut_lineage(ticks.join(_moves(scored, cfg), "ts", "left"))
    returns = cut_lineage(_returns(scored, ticks, cfg))
    known = scored.groupBy("symbol").agg(F.min("ts").alias("since"))
    while True:
        pointed = ticks.join(_backs(returns, known, ticks, cfg), "ts", "left")
        marked = _reached(pointed.select("ts", "free", F.least("moved_at", "back", "after").alias("nxt")))
        if returns.isEmpty():
            break
        now = cut_lineage(scored.join(marked, "ts", "left_semi").groupBy("symbol").agg(F.min("ts").alias("since")))
        if now.exceptAll(known).isEmpty() and known.select("symbol").exceptAll(now.select("symbol")).isEmpty():
            break
        known = now
    hit = marked.withColumn("accepted", F.lit(True))
    return ticks.select("ts").join(hit, "ts", "left").select("ts", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def with_absent(members: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """``members`` with the ticks at which an absent symbol can still change its state: score 0, no member.

    A symbol that a tick leaves out goes on as one outside the top k. Whatever its state was, it is out for good
    at the first tick that lies ``exit_ms`` after the first that lies ``min_dwell_ms`` after it went; later
    ticks are silent until it comes back. So an absence adds a few rows, however long it lasts.
    """
    ticks = members.select("ts").distinct()
    cell = slice_of(F.col("ts"), cfg.slice_ms)
    ticks = running(ticks, [], cell, ["ts"], [Run("i", "sum", F.lit(1))])
    for at, out in ((F.col("ts") + cfg.min_dwell_ms, "_t1"), (F.col("_t1") + cfg.exit_ms, "_t2")):
        value = F.col("ts") if out == "_t1" else F.col("i")
        ticks = _first_after(ticks, at, value, out, cfg.slice_ms)
    end = ticks.agg(F.max("i")).first()[0]
    ticks = cut_lineage(ticks.select("ts", "i", F.coalesce("_t2", F.lit(end).cast("long")).alias("stop")))
    rows = members.select("symbol", "ts").join(ticks.select("ts", "i"), "ts")
    down = rows.withColumn("_down", -F.col("i"))
    comes = Run("comes", "last", F.col("i"), inclusive=False)
    down = running(down, ["symbol"], slice_of(-F.col("ts"), cfg.slice_ms), ["_down"], [comes])
    gaps = down.filter(F.col("comes").isNull() | (F.col("comes") > F.col("i") + 1))
    gaps = gaps.select("symbol", "comes", (F.col("i") + 1).alias("i")).join(ticks.select("i", "stop"), "i")
    last = F.least("stop", F.col("comes") - 1)
    silent = gaps.select("symbol", F.explode(F.sequence("i", last)).alias("i")).join(ticks.select("i", "ts"), "i").drop("i")
    made = silent.withColumns({"score": F.lit(0.0), "member": F.lit(False)})
    return members.unionByName(made, allowMissingColumns=True)
