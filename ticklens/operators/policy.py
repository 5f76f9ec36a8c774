"""Policy rules and quote intents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.config import PolicyConfig, QuoteConfig


def evaluate_policy(ctx: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Ordered rules on contexts joined with their inputs.

    Needs realized_pnl, unrealized_pnl, position_qty, ts, last_book_ts, p_toxic,
    p_inplay_2m. Adds kill, force_close, patterns, reason_codes, spread_mult.
    """
    kill = F.col("realized_pnl") + F.col("unrealized_pnl") < -cfg.max_session_loss
    hard = F.abs("position_qty") >= cfg.inventory_hard_limit
    stale = F.col("ts") - F.col("last_book_ts") > cfg.stale_quote_ms
    disable = F.col("p_toxic") >= cfg.toxicity_disable
    widen = F.col("p_toxic") >= cfg.toxicity_widen
    quiet = F.col("p_inplay_2m") < cfg.inplay_exit_prob
    stop = hard | stale | disable
    code = lambda c, name: F.when(c, F.lit(name))
    codes = (
        F.when(kill, F.array(F.lit("kill_max_loss")))
        .when(
            stop,
            F.array_compact(
                F.array(
                    code(hard, "hard_limit_block"),
                    code(stale, "stale_book_pause"),
                    code(disable, "toxic_disable"),
                )
            ),
        )
        .otherwise(F.array_compact(F.array(code(widen, "toxic_widen"), code(quiet, "low_inplay_pause"))))
    )
    patterns = (
        F.when(kill, F.array(F.lit("FORCE_CLOSE")))
        .when(stop, F.array(F.lit("SUPPRESS_ALL")))
        .otherwise(
            F.array_compact(F.array(code(widen, "MODIFY_PARAMS"), code(quiet, "SUPPRESS_ENTRY")))
        )
    )
    mult = F.when(~kill & ~stop & widen, F.lit(cfg.toxic_spread_mult)).otherwise(F.lit(1.0))
    return ctx.withColumns(
        {
            "kill": kill,
            "force_close": kill,
            "patterns": patterns,
            "reason_codes": codes,
            "spread_mult": mult,
        }
    )


def _order(side: str, price: Column, qty: Column, reason: Column | str) -> Column:
    return F.struct(
        F.lit(side).alias("side"),
        price.cast("double").alias("price"),
        qty.cast("double").alias("qty"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
    )


def quote_intents(rows: DataFrame, cfg: QuoteConfig = QuoteConfig()) -> DataFrame:
    """Orders per policy row as rows (side, price, qty, reason).

    Needs the columns of ``evaluate_policy`` and bid, ask, mid, pending_order_count;
    rows with ``killed`` set give nothing.
    """
    pos, pending = F.col("position_qty"), F.col("pending_order_count")
    frac = F.lit(cfg.spread_bps / 10000) * F.col("spread_mult")
    bid, ask = F.col("mid") * (1 - frac), F.col("mid") * (1 + frac)
    toxic = F.array_contains("reason_codes", "toxic_widen")
    name = lambda r: F.concat(F.lit(r), F.when(toxic, "_toxic").otherwise(""))
    no_entry = F.array_contains("patterns", "SUPPRESS_ENTRY")
    qty = F.lit(cfg.order_qty)
    close = F.least(qty, F.abs(pos))
    room_up, room_down = pos + qty <= cfg.max_position, pos - qty >= -cfg.max_position
    enter = (pos == 0) & (pending < 2) & ~no_entry
    quotes = F.array_compact(
        F.array(
            F.when((pos > 0) & (pending == 0), _order("SELL", ask, close, name("close_long"))),
            F.when((pos < 0) & (pending == 0), _order("BUY", bid, close, name("close_short"))),
            F.when(enter & room_up, _order("BUY", bid, qty, name("enter_long"))),
            F.when(enter & room_down, _order("SELL", ask, qty, name("enter_short"))),
        )
    )
    first = F.get("reason_codes", F.lit(0))
    flatten = F.array_compact(
        F.array(
            F.when(pos > 0, _order("SELL", F.col("bid"), F.abs(pos), first)),
            F.when(pos < 0, _order("BUY", F.col("ask"), F.abs(pos), first)),
        )
    )
    none = F.filter(quotes, lambda x: F.lit(False))
    quoted = (F.col("bid") > 0) & (F.col("ask") > 0)
    orders = (
        F.when(F.coalesce(F.col("killed"), F.lit(False)), none)
        .when(F.col("force_close"), flatten)
        .when(F.array_contains("patterns", "SUPPRESS_ALL") | ~quoted, none)
        .otherwise(quotes)
    )
    return rows.withColumn("order", F.explode(orders)).select("*", "order.*").drop("order")
