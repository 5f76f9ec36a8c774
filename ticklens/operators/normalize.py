"""From raw messages to typed rows; contract checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.schemas import (
    BASE_COLUMNS,
    CONTRACTS,
    LABEL_TEMPLATES,
    TOXICITY_COLUMNS,
    Rule,
)

# Message kind -> event type.
KINDS = {
    "aggTrade": "trade",
    "bookTicker": "book",
    "depthUpdate": "book",
    "kline": "kline",
    "markPriceUpdate": "mark",
    "forceOrder": "funding",
}


def _fields(df: DataFrame, keep: Sequence[str], column: str, names: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The kept columns with the texts of some top-level fields of a JSON column, which is parsed once."""
    at = [f"_json{i}" for i in range(len(names))]
    return df.select(*keep, F.json_tuple(column, *names).alias(*at)), dict(zip(names, map(F.col, at), strict=True))


def normalize_raw(raw: DataFrame, source: str = "exchange") -> DataFrame:
    """Market events from raw JSON messages (columns raw, recv_ts, others kept).

    Unknown kinds and messages without a symbol are dropped. A quote message without
    a time takes its receive time, the other kinds 0.
    """
    rows, at = _fields(raw, raw.columns, "raw", ("e", "E", "s", "o"))
    kind = at["e"]
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    symbol = F.when(kind == "forceOrder", F.get_json_object(at["o"], "$.s")).otherwise(at["s"])
    no_time = F.when(kind == "bookTicker", F.col("recv_ts")).otherwise(F.lit(0))
    keep = [c for c in raw.columns if c not in ("raw", "recv_ts")]
    rows = rows.select(
        *keep,
        F.coalesce(at["E"].try_cast("bigint"), no_time).alias("ts"),
        F.lit(source).alias("source"),
        F.upper(symbol).alias("symbol"),
        kinds[kind].alias("type"),
        F.col("raw").alias("payload"),
        "recv_ts",
    )
    return rows.filter(F.col("type").isNotNull() & F.col("symbol").isNotNull())


def _first(texts: Sequence[Column], cast: str, default: object) -> Column:
    return F.coalesce(*[t.try_cast(cast) for t in texts], F.lit(default))


def parse_trades(ev: DataFrame) -> DataFrame:
    """price, qty and is_buyer_maker of the trades; 0, 0 and false where missing."""
    keep = [c for c in ev.columns if c not in ("payload", "type", "source")]
    names = ("p", "price", "q", "qty", "m", "is_buyer_maker")
    rows, at = _fields(ev.filter(F.col("type") == "trade"), keep, "payload", names)
    return rows.select(
        *keep,
        _first([at["p"], at["price"]], "double", 0.0).alias("price"),
        _first([at["q"], at["qty"]], "double", 0.0).alias("qty"),
        _first([at["m"], at["is_buyer_maker"]], "boolean", False).alias("is_buyer_maker"),
    )


# Names of a quote field by alias mode; level arrays give their best level.
_QUOTE = {
    "bid": ("$.b[0][0]", "$.b", "$.bid_price", "$.bid"),
    "bid_qty": ("$.b[0][1]", "$.B", "$.bid_qty"),
    "ask": ("$.a[0][0]", "$.a", "$.ask_price", "$.ask"),
    "ask_qty": ("$.a[0][1]", "$.A", "$.ask_qty"),
}


def parse_books(ev: DataFrame, alias_mode: str = "all") -> DataFrame:
    """bid, bid_qty, ask, ask_qty of the books.

    ``all`` reads every name; ``feature`` does not know plain bid/ask; ``label`` knows
    only those and keeps rows with both positive.
    """
    keep = [c for c in ev.columns if c not in ("payload", "type", "source")]

    def names(field: str) -> list[str]:
        every = list(_QUOTE[field])
        if alias_mode == "feature":
            return [p for p in every if p not in ("$.bid", "$.ask")]
        if alias_mode == "label" and field in ("bid", "ask"):
            return [f"$.{field}"]
        return every

    paths = {f: names(f) for f in _QUOTE}
    tops = tuple(dict.fromkeys(p[2:].partition("[")[0] for ps in paths.values() for p in ps))
    rows, at = _fields(ev.filter(F.col("type") == "book"), keep, "payload", tops)

    def text(path: str) -> Column:
        top, inner, rest = path[2:].partition("[")
        return F.get_json_object(at[top], "$" + inner + rest) if inner else at[top]

    rows = rows.select(*keep, *[_first([text(p) for p in ps], "double", 0.0).alias(f) for f, ps in paths.items()])
    return rows.filter("bid > 0 AND ask > 0") if alias_mode == "label" else rows


def to_tape(ev: DataFrame, alias_mode: str = "all") -> DataFrame:
    """Trades and books as one typed table; ``seq`` breaks ties of (ts, recv_ts)."""
    base = ["symbol", "ts", "recv_ts", "seq"]
    trades = parse_trades(ev).select(*base, F.lit(True).alias("is_trade"), "price", "qty", "is_buyer_maker")
    books = parse_books(ev, alias_mode).select(
        *base, F.lit(False).alias("is_trade"), "bid", "ask", "bid_qty", "ask_qty"
    )
    return trades.unionByName(books, allowMissingColumns=True)


def _fails(r: Rule, raw: str) -> Column:
    text = F.get_json_object(raw, f"$.{r.path}")
    value = text.try_cast(r.type) if r.type != "string" else text
    bad = F.lit(False)
    if r.type != "string":
        bad = bad | (text.isNotNull() & value.isNull())
    if r.ge is not None:
        bad = bad | (value < r.ge)
    if r.le is not None:
        bad = bad | (value > r.le)
    if r.gt is not None:
        bad = bad | (value <= r.gt)
    if r.one_of:
        bad = bad | (text.isNotNull() & ~text.isin(*r.one_of))
    if r.non_empty:
        bad = bad | (F.trim(text) == "")
    bad = F.coalesce(bad, F.lit(False))
    name = F.when(bad, F.lit(f"{r.path}: invalid"))
    if r.required:
        name = F.when(text.isNull(), F.lit(f"{r.path}: missing")).otherwise(name)
    return name


def _unknown(keys: Column, prefix: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(prefix), k, F.lit(": unknown")))


def validate_contract(df: DataFrame, contract: str, raw: str = "raw") -> DataFrame:
    """Add ``failures`` (array of texts) and ``ok`` for JSON rows of a contract.

    Checks required fields, types, ranges, enums, and keys the contract lacks, at the
    top and inside its nested objects.
    """
    rules = CONTRACTS[contract]
    known = sorted({r.path.split(".")[0] for r in rules})
    keys = F.json_object_keys(raw)
    extra = [_unknown(F.array_except(keys, F.array(*map(F.lit, known))), "")]
    for parent in sorted({r.path.split(".")[0] for r in rules if "." in r.path}):
        inner = sorted(r.path.split(".")[1] for r in rules if r.path.startswith(parent + "."))
        found = F.coalesce(
            F.json_object_keys(F.get_json_object(raw, f"$.{parent}")), F.array().cast("array<string>")
        )
        over = F.array_except(found, F.array(*map(F.lit, inner)))
        extra.append(_unknown(over, f"{parent}."))
    broken = F.when(keys.isNull(), F.array(F.lit("not a JSON object")))
    found = F.concat(F.array_compact(F.array(*[_fails(r, raw) for r in rules])), *extra)
    df = df.withColumn("failures", F.coalesce(broken, found))
    return df.withColumn("ok", F.size("failures") == 0)


def split_valid(df: DataFrame, contract: str, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the quarantine with its reasons."""
    checked = validate_contract(df, contract, raw)
    return checked.filter("ok").drop("ok", "failures"), checked.filter("NOT ok").drop("ok")


def dataset_columns(
    horizons: Sequence[str] = ("30s", "2m", "5m"), profiles: Sequence[str] = ("a", "b")
) -> list[str]:
    labels = [t.format(h=h, p=p) for h in horizons for p in profiles for t in LABEL_TEMPLATES]
    return [*BASE_COLUMNS, *labels, *TOXICITY_COLUMNS]


def feature_columns_of(df: DataFrame, exclude: Sequence[str] | None = None) -> list[str]:
    """Columns that are neither labels nor keys; gate columns count as labels."""
    if exclude is None:
        exclude = [t.split("{")[0] for t in LABEL_TEMPLATES] + [*TOXICITY_COLUMNS, "gates_passed_"]
    return sorted(
        c for c in df.columns if c not in ("ts", "symbol") and not c.startswith(tuple(exclude))
    )


def label_columns_of(df: DataFrame) -> dict[str, list[str]]:
    have = set(df.columns)
    every = dataset_columns()
    pick = lambda p: [c for c in every if c.startswith(p) and c in have]
    return {
        "tradeable": pick("i_tradeable_"),
        "edge": pick("net_edge_bps_"),
        "toxicity": [c for c in TOXICITY_COLUMNS if c in have],
    }


def validate_dataset(df: DataFrame, columns: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """Rows (check, subject, value, ok): columns missing or extra, row count, null counts."""
    want = list(columns or dataset_columns())
    have = set(df.columns)
    static = [("missing", c, 1, False) for c in want if c not in have]
    static += [("extra", c, 1, not strict) for c in df.columns if c not in want]
    present = [c for c in want if c in have]
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    )
    row = lambda check, subject, value, ok: F.struct(
        F.lit(check).alias("check"),
        F.lit(subject).alias("subject"),
        value.cast("bigint").alias("value"),
        ok.alias("ok"),
    )
    rows = [row("rows", "*", F.col("n"), F.col("n") > 0)]
    rows += [row("nulls", c, F.col(f"null_{c}"), F.col(f"null_{c}") == 0) for c in present]
    rows += [row(a, b, F.lit(v), F.lit(ok)) for a, b, v, ok in static]
    return counts.select(F.inline(F.array(*rows)))
