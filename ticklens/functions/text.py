"""Texts: numbers in them, checks of explanations, headlines, messages, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number pattern, status labels, allowed labels, icons and event labels.
NUMBER = r"-?\d+\.?\d*|-?\.\d+"
STATUS_LABELS = {
    "TRADEABLE": "Tradeable",
    "WATCH": "Watch",
    "TRAP": "Trap",
    "DEAD": "Dead",
    "DATA_ISSUE": "Data issue",
}
ALLOWED_LABELS = (
    "Tradeable",
    "Tradeable soon",
    "Watch",
    "Watching",
    "Trap",
    "Avoid",
    "Dead",
    "Data issue",
)
EVENT_ICONS = {
    "SYMBOL_ENTER": "⤴️",
    "SYMBOL_EXIT": "⤵️",
    "ALERT_TRADABLE": "✅",
    "ALERT_TRAP": "⚠️",
    "DATA_ISSUE": "❌",
}
OTHER_ICON = "ℹ️"
EVENT_LABELS = {
    "SYMBOL_ENTER": "Entered Ranking",
    "SYMBOL_EXIT": "Exited Ranking",
    "ALERT_TRADABLE": "Tradeable",
    "ALERT_TRAP": "Trap - Avoid",
    "DATA_ISSUE": "Data Issue",
}
VERSION = r"(?i)^(\d+\.\d+\.\d+)\+([a-f0-9]{7,12})\+(\d{8})\+([a-f0-9]{8})$"
BASELINE_VERSION = r"(?i)^baseline-v(\d+\.\d+\.\d+)\+([a-f0-9]{7,12})$"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def numbers_in_text(text: Column) -> Column:
    """Signed integers and decimals as they are written."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def number_strings(value: Column) -> Column:
    """The spellings a value may appear in: as a float, and as an integer if whole."""
    v = value.cast("double")
    plain = (F.abs(v) >= 1e-4) & (F.abs(v) < 1e7) | (v == 0)
    whole = v == F.floor(v)
    text = F.when(plain, v.cast("string")).when(
        whole & (F.abs(v) < 1e16), F.concat(v.cast("decimal(20,0)").cast("string"), F.lit(".0"))
    ).otherwise(F.lower(v.cast("string")))
    return F.array_compact(F.array(text, F.when(whole, v.cast("decimal(38,0)").cast("string"))))


def status_label(status: Column) -> Column:
    return F.coalesce(_map(STATUS_LABELS)[status], F.lit("Watch"))


def _shorten(text: Column, max_chars: Column) -> Column:
    cut = F.concat(F.substring(text, F.lit(1), max_chars - 3), F.lit("..."))
    return F.when(F.char_length(text) > max_chars, cut).otherwise(text)


def _words(code: Column) -> Column:
    return F.lower(F.replace(F.replace(code, F.lit("RC_"), F.lit("")), F.lit("_"), F.lit(" ")))


def _headline(symbol: Column, status: Column, code: Column, max_chars: Column, tail: str, else_tail: str) -> Column:
    said = F.when(code.isNotNull(), F.concat(_words(code), F.lit(tail))).otherwise(
        F.concat(F.lower(status_label(status)), F.lit(else_tail))
    )
    return _shorten(F.concat(symbol, F.lit(": "), said), max_chars)


def fallback_headline(symbol: Column, status: Column, first_code: Column, max_chars: Column) -> Column:
    """Template text without invented numbers."""
    return _headline(symbol, status, first_code, max_chars, ".", ".")


def rule_headline(symbol: Column, status: Column, first_code: Column, max_chars: Column) -> Column:
    """The text of the rule-based explainer."""
    return _headline(symbol, status, first_code, max_chars, " detected.", " conditions.")


def reason_text_ok(reason: Column) -> Column:
    return ~reason.rlike(r"\d") & (F.char_length(reason) <= 64)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_markdown(text: Column) -> Column:
    for c in ("*", "_", "`", "~"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def utc_text(ts_ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss UTC`` from epoch ms, whatever the session zone."""
    sec = F.floor(ts_ms / 1000).cast("long")
    day = F.date_from_unix_date(F.floor(sec / 86400).cast("int")).cast("string")
    of_day = sec % 86400
    parts = [F.floor(of_day / 3600), F.floor(of_day % 3600 / 60), of_day % 60]
    clock = F.format_string("%02d:%02d:%02d", *[p.cast("int") for p in parts])
    return F.concat(day, F.lit(" "), clock, F.lit(" UTC"))


def _percent(p: Column) -> Column:
    return F.concat(F.format_string("%.2f", p * 100), F.lit("%"))


def format_event(
    kind: str, include_text: bool = True, dashboard_url: str = ""
) -> Column:
    """Message of a rank event. ``kind``: text, html or markdown.

    Columns: ts, event, symbol, rank, score, status, p_inplay_2m, p_toxic, llm_text
    (the last four may be null).
    """
    same = lambda c: c
    esc = {"text": same, "html": escape_html, "markdown": escape_markdown}[kind]
    strong = {"text": ("", ""), "html": ("<b>", "</b>"), "markdown": ("*", "*")}[kind]
    soft = {"text": ("", ""), "html": ("<i>", "</i>"), "markdown": ("_", "_")}[kind]
    tag = lambda name: F.lit(f"{soft[0]}{name}:{soft[1]} ")
    event = F.col("event")
    icon = F.coalesce(_map(EVENT_ICONS)[event], F.lit(OTHER_ICON))
    label = F.coalesce(_map(EVENT_LABELS)[event], event)
    status, text = F.col("status"), F.col("llm_text")
    lines = [
        F.concat(
            icon, F.lit(" " + strong[0]), esc(F.col("symbol")), F.lit(strong[1] + " - "), esc(label)
        ),
        F.concat(tag("Time"), utc_text(F.col("ts"))),
        F.concat(
            tag("Rank"),
            F.lit("#"),
            (F.col("rank") + 1).cast("string"),
            F.lit(" | "),
            tag("Score"),
            F.format_string("%.4f", F.col("score")),
        ),
        F.when(status != "", F.concat(tag("Status"), esc(status))),
        F.when(F.col("p_inplay_2m").isNotNull(), F.concat(tag("p_inplay"), _percent(F.col("p_inplay_2m")))),
        F.when(F.col("p_toxic").isNotNull(), F.concat(tag("p_toxic"), _percent(F.col("p_toxic")))),
    ]
    if include_text:
        lines.append(F.when(text != "", F.concat(F.lit("\n"), esc(text))))
    if dashboard_url:
        url = dashboard_url.rstrip("/")
        link = {
            "text": f"Dashboard: {url}",
            "html": f'<a href="{url}">Dashboard</a>',
            "markdown": f"<{url}|Dashboard>",
        }[kind]
        lines.append(F.lit("\n" + link))
    return F.concat_ws("\n", *lines)


def parse_model_version(version: Column) -> Column:
    """struct<semver, git_sha, data_cutoff, train_hash, major, minor, patch>; null if invalid."""
    full, base = version.rlike(VERSION), version.rlike(BASELINE_VERSION)
    at = lambda i: F.regexp_extract(version, VERSION, i)
    at_base = lambda i: F.regexp_extract(version, BASELINE_VERSION, i)
    semver = F.when(full, at(1)).otherwise(at_base(1))
    nothing = F.lit("00000000")
    number = lambda i: F.get(F.split(semver, r"\."), F.lit(i)).cast("int")
    return F.when(
        full | base,
        F.struct(
            semver.alias("semver"),
            F.when(full, at(2)).otherwise(at_base(2)).alias("git_sha"),
            F.when(full, at(3)).otherwise(nothing).alias("data_cutoff"),
            F.when(full, at(4)).otherwise(nothing).alias("train_hash"),
            number(0).alias("major"),
            number(1).alias("minor"),
            number(2).alias("patch"),
        ),
    )
