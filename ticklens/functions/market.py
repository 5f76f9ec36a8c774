"""Column expressions over quotes: spread, mid, imbalance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticklens.functions.numeric import ratio


def mid(bid: Column, ask: Column) -> Column:
    """Mid price; 0 without a book."""
    return F.coalesce((bid + ask) / 2, F.lit(0.0))


def spread_bps(bid: Column, ask: Column) -> Column:
    """Spread relative to mid in basis points; 0 without a book or a positive mid."""
    m = (bid + ask) / 2
    return F.when(m > 0, (ask - bid) / m * 10000).otherwise(F.lit(0.0))


def book_imbalance(bid_qty: Column, ask_qty: Column) -> Column:
    return ratio(bid_qty - ask_qty, bid_qty + ask_qty)


def microprice(bid: Column, ask: Column, bid_qty: Column, ask_qty: Column) -> Column:
    """Prices weighted by the size on the other side; null without any size."""
    size = bid_qty + ask_qty
    return (ask * bid_qty + bid * ask_qty) / F.nullif(size, F.lit(0.0))


def depth_slope(levels: Column) -> Column:
    """Regression slope of size on price over the levels (price, qty) of one side.

    Prices and sizes are taken around their means, so nothing cancels. Null below two different prices.
    """
    total = lambda f: F.aggregate(levels, F.lit(0.0), lambda acc, x: acc + f(x))
    n = F.size(levels)

    def slope(m: Column) -> Column:
        dx = lambda x: x["price"] - m["price"]
        sums = F.struct(total(lambda x: dx(x) * (x["qty"] - m["qty"])).alias("xy"), total(lambda x: dx(x) * dx(x)).alias("xx"))
        return F.transform(F.array(sums), lambda s: F.when(s["xx"] > 0, s["xy"] / s["xx"]))[0]

    means = F.struct((total(lambda x: x["price"]) / n).alias("price"), (total(lambda x: x["qty"]) / n).alias("qty"))
    return F.when(n >= 2, F.transform(F.array(means), slope)[0])


def trade_intensity(n_trades: Column, window_ms: int) -> Column:
    """Trades per second of a window."""
    return n_trades / F.lit(window_ms / 1000)


def flow_imbalance(buy: Column, sell: Column) -> Column:
    return ratio(buy - sell, buy + sell)


def data_issue(health: Column, stale_book_ms: int, stale_trades_ms: int) -> Column:
    return (
        (health["stale_book_ms"] > stale_book_ms)
        | (health["stale_trades_ms"] > stale_trades_ms)
        | (F.size(health["missing_streams"]) > 0)
    )
