"""Execution costs: fees, clip size, order-book impact, totals per profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticklens.functions.market import spread_bps

# Fees in bps and clip size as a share of the 60 s volume.
FEES_BPS = {"a": 2.0, "b": 4.0}
CLIP_SHARE = {"scalping": 0.01, "intraday": 0.03}


def fees_bps(profile: Column) -> Column:
    return F.when(F.lower(profile) == "a", FEES_BPS["a"]).otherwise(FEES_BPS["b"])


def clip_size_usd(usd_volume_60s: Column, style: str = "scalping") -> Column:
    return CLIP_SHARE.get(style, CLIP_SHARE["intraday"]) * usd_volume_60s


def impact_bps(levels: Column, mid: Column, usd: Column, side: str = "buy", max_bps: float = 100.0) -> Column:
    """Slippage of the average fill price against mid when ``usd`` walks ``levels``.

    ``levels``: array<struct<price, qty>>, best first. What the book cannot fill is
    ignored; an empty side gives ``max_bps``.
    """
    zero = F.lit(0.0)
    start = F.struct(usd.cast("double").alias("left"), zero.alias("qty"), zero.alias("cost"))

    def take(acc: Column, lv: Column) -> Column:
        value = lv["price"] * lv["qty"]
        partial = acc["left"] / lv["price"]
        all_of_it = value < acc["left"]
        got = F.when(all_of_it, lv["qty"]).otherwise(partial)
        step = F.struct(
            F.when(all_of_it, acc["left"] - value).otherwise(zero).alias("left"),
            (acc["qty"] + got).alias("qty"),
            (acc["cost"] + got * lv["price"]).alias("cost"),
        )
        return F.when(acc["left"] > 0, step).otherwise(acc)

    done = F.aggregate(levels, start, take)
    avg = done["cost"] / done["qty"]
    slip = (avg - mid) if side == "buy" else (mid - avg)
    clipped = F.least(F.greatest(slip / mid * 10000, zero), F.lit(max_bps))
    return (
        F.when((usd <= 0) | (mid <= 0), zero)
        .when((F.size(levels) <= 0) | (done["qty"] <= 0), F.lit(max_bps))
        .otherwise(clipped)
    )


def quote_spread_bps(bid: Column, ask: Column) -> Column:
    """Spread in bps; 0 unless both sides are positive."""
    return F.when((bid > 0) & (ask > 0), spread_bps(bid, ask)).otherwise(F.lit(0.0))


def execution_costs(
    bid: Column,
    ask: Column,
    profile: Column,
    asks: Column | None = None,
    usd_volume_60s: Column | None = None,
    style: str = "scalping",
) -> Column:
    """struct<spread_bps, fees_bps, impact_bps, total_bps, clip_size_usd> of one profile."""
    spread, fees = quote_spread_bps(bid, ask), fees_bps(profile)
    clip = impact = F.lit(0.0)
    if asks is not None and usd_volume_60s is not None:
        used = asks.isNotNull() & (usd_volume_60s > 0)
        size = clip_size_usd(usd_volume_60s, style)
        clip = F.when(used, size).otherwise(F.lit(0.0))
        walked = impact_bps(asks, (bid + ask) / 2, size)
        impact = F.when(used, walked).otherwise(F.lit(0.0))
    return F.struct(
        spread.alias("spread_bps"),
        fees.alias("fees_bps"),
        impact.alias("impact_bps"),
        (spread + fees + impact).alias("total_bps"),
        clip.alias("clip_size_usd"),
    )


def costs_both_profiles(*args: Column, **kwargs: object) -> Column:
    """array of (profile, costs) for both profiles, to be exploded in place."""
    bid, ask, *rest = args
    return F.array(
        *[
            F.struct(
                F.lit(p).alias("profile"),
                execution_costs(bid, ask, F.lit(p), *rest, **kwargs).alias("costs"),
            )
            for p in ("a", "b")
        ]
    )


def gate_failures(spread: Column, impact: Column, spread_max: float, impact_max: float) -> Column:
    return F.array_compact(
        F.array(
            F.when(spread > spread_max, F.lit("SPREAD_GATE")),
            F.when(impact > impact_max, F.lit("IMPACT_GATE")),
        )
    )
