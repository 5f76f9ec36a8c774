"""Labels: sampled books, what trades did afterwards, and tradeability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.config import HORIZONS_MS, PROFILES, LabelConfig
from ticklens.functions.cost import execution_costs, gate_failures
from ticklens.operators.thin import thin_by_gap
from ticklens.plans.slices import SLICE


def sample_books(tape: DataFrame, cfg: LabelConfig = LabelConfig()) -> DataFrame:
    """Books to label: the last one per instant, thinned, with the lookahead inside the data."""
    books = (
        tape.filter((~F.col("is_trade")) & (F.col("bid") > 0) & (F.col("ask") > 0))
        .groupBy("symbol", "ts")
        .agg(F.max_by(F.struct("bid", "ask"), "seq").alias("q"))
    )
    ends = (
        tape.filter((~F.col("is_trade")) & (F.col("bid") > 0) & (F.col("ask") > 0))
        .groupBy("symbol")
        .agg(F.min("ts").alias("first_ts"), (F.max("ts") - cfg.lookahead_ms).alias("end_ts"))
        .filter(F.col("end_ts") > F.col("first_ts"))
    )
    books = books.join(ends, "symbol").filter(F.col("ts") <= F.col("end_ts"))
    books = books.select("symbol", "ts", "q.bid", "q.ask")
    return thin_by_gap(books, ["symbol"], "ts", cfg.sample_interval_ms)


def forward_extremes(samples: DataFrame, trades: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Highest and lowest trade price in ``[t, t + h]`` per sample and horizon.

    Rows: symbol, ts, horizon, hi, lo (null without a trade). Trades are first
    reduced to one row per instant. A slice is as long as its horizon, so a frame is
    the rest of the sample's slice and the start of the next one: two growing
    frames, linear in the rows whatever a symbol's share of them.
    """
    spec = F.array(
        *[F.struct(F.lit(k).alias("horizon"), F.lit(h).cast("long").alias("h")) for k, h in horizons.items()]
    )
    per_ts = (
        trades.filter(F.col("price") > 0)
        .groupBy("symbol", "ts")
        .agg(F.max("price").alias("hi"), F.min("price").alias("lo"))
        .select("*", F.inline(spec))
    )
    at = F.floor(F.col("ts") / F.col("h")).cast("long")
    seen = per_ts.select(
        "symbol", "horizon", "h", "ts", "hi", "lo", F.explode(F.array(at, at - 1)).alias(SLICE)
    )
    asked = samples.select("symbol", "ts", F.inline(spec)).select(
        "symbol", "horizon", "h", "ts", at.alias(SLICE), F.lit(True).alias("asked")
    )
    rows = seen.unionByName(asked, allowMissingColumns=True)
    part = Window.partitionBy("symbol", "horizon", SLICE)
    home = at == F.col(SLICE)
    rest = part.orderBy(F.col("ts").desc()).rangeBetween(Window.unboundedPreceding, 0)
    out = rows.select(
        "*",
        F.max(F.when(home, F.col("hi"))).over(rest).alias("hi_home"),
        F.min(F.when(home, F.col("lo"))).over(rest).alias("lo_home"),
    )
    # Time within the slice of the sample, and within the next slice for what follows:
    # a trade of the next slice is in reach when its place there is not past the sample's.
    place = F.col("ts") % F.col("h")
    ahead = part.orderBy(place).rangeBetween(Window.unboundedPreceding, 0)
    out = out.select(
        "*",
        F.max(F.when(~home, F.col("hi"))).over(ahead).alias("hi_next"),
        F.min(F.when(~home, F.col("lo"))).over(ahead).alias("lo_next"),
    )
    return out.filter("asked").select(
        "symbol",
        "ts",
        "horizon",
        F.greatest("hi_home", "hi_next").alias("hi"),
        F.least("lo_home", "lo_next").alias("lo"),
    )


def mfe_bps(entry: Column, hi: Column) -> Column:
    up = (F.greatest(hi, entry) - entry) / entry * 10000
    return F.when(entry > 0, F.greatest(up, F.lit(0.0))).otherwise(F.lit(0.0))


def mae_bps(entry: Column, lo: Column) -> Column:
    down = (entry - F.least(lo, entry)) / entry * 10000
    return F.when(entry > 0, F.greatest(down, F.lit(0.0))).otherwise(F.lit(0.0))


def build_labels(tape: DataFrame, cfg: LabelConfig = LabelConfig()) -> DataFrame:
    """One row per sample: mid, spread, toxicity, and an array of labels per horizon/profile."""
    horizons = {**HORIZONS_MS, "tox": cfg.toxic_tau_ms, "look": cfg.lookahead_ms}
    samples = sample_books(tape, cfg)
    trades = tape.filter("is_trade").select("symbol", "ts", "price")
    ext = forward_extremes(samples, trades, horizons)
    pick = lambda h, c: F.max(F.when(F.col("horizon") == h, F.col(c)))
    wide = ext.groupBy("symbol", "ts").agg(
        *[pick(h, c).alias(f"{c}_{h}") for h in horizons for c in ("hi", "lo")]
    )
    rows = samples.join(wide.filter(F.col("hi_look").isNotNull()), ["symbol", "ts"])
    bid, ask = F.col("bid"), F.col("ask")
    rows = rows.withColumn("mid_price", (bid + ask) / 2)
    entry = F.col("mid_price")
    severity = mae_bps(entry, F.col("lo_tox"))
    least = {(h, p): x for h, p, x in cfg.min_edge_bps}
    labels = []
    for h in HORIZONS_MS:
        for p in PROFILES:
            cost = execution_costs(bid, ask, F.lit(p))
            mfe = mfe_bps(entry, F.col(f"hi_{h}"))
            edge = mfe - cost["total_bps"]
            failed = gate_failures(
                cost["spread_bps"], cost["impact_bps"], cfg.spread_max_bps, cfg.impact_max_bps
            )
            passed = F.size(failed) == 0
            labels.append(
                F.struct(
                    F.lit(h).alias("horizon"),
                    F.lit(p).alias("profile"),
                    mfe.alias("mfe_bps"),
                    mae_bps(entry, F.col(f"lo_{h}")).alias("mae_bps"),
                    cost["total_bps"].alias("cost_bps"),
                    edge.alias("net_edge_bps"),
                    passed.alias("gates_passed"),
                    failed.alias("gate_failures"),
                    ((edge >= least[h, p]) & passed).cast("int").alias("i_tradeable"),
                )
            )
    return rows.select(
        "ts",
        "symbol",
        "mid_price",
        execution_costs(bid, ask, F.lit("a"))["spread_bps"].alias("spread_bps"),
        (severity > cfg.toxic_bps).cast("int").alias("y_toxic"),
        severity.alias("severity_toxic_bps"),
        F.array(*labels).alias("labels"),
    )


def labels_long(labels: DataFrame) -> DataFrame:
    """One row per (sample, horizon, profile)."""
    return labels.select("ts", "symbol", F.inline("labels"))


def labels_wide(labels: DataFrame) -> DataFrame:
    """Flat columns ``{name}_{horizon}_{profile}``, MAE included."""
    cols = []
    i = 0
    for h in HORIZONS_MS:
        for p in PROFILES:
            lab = F.get("labels", F.lit(i))
            for c in ("i_tradeable", "mfe_bps", "mae_bps", "cost_bps", "net_edge_bps"):
                cols.append(lab[c].alias(f"{c}_{h}_{p}"))
            cols.append(lab["gates_passed"].cast("int").alias(f"gates_passed_{h}_{p}"))
            i += 1
    head = ("ts", "symbol", "mid_price", "spread_bps", "y_toxic", "severity_toxic_bps")
    return labels.select(*head, *cols)


def label_summary(labels: DataFrame) -> DataFrame:
    """Positives per (horizon, profile), and the toxic ones as horizon 'toxic'."""
    trad = labels_long(labels).select("horizon", "profile", F.col("i_tradeable").alias("y"))
    tox = labels.select(F.lit("toxic").alias("horizon"), F.lit("-").alias("profile"), F.col("y_toxic").alias("y"))
    return (
        trad.unionByName(tox)
        .groupBy("horizon", "profile")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("y").alias("positives"),
            (F.sum("y") * 100.0 / F.count(F.lit(1))).alias("percent"),
        )
    )
