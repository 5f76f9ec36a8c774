"""Checks of explanation texts against their input, and the fallback text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.functions.text import (
    ALLOWED_LABELS,
    fallback_headline,
    number_strings,
    numbers_in_text,
    status_label,
)


def allowed_numbers() -> Column:
    """Every spelling of the numbers of the input: score, summary, reason values."""
    fields = [F.col("score"), F.col("spread_bps"), F.col("impact_bps"), F.col("p_toxic")]
    own = F.concat(*[number_strings(c) for c in fields])
    of_reasons = F.flatten(F.transform("reasons", lambda r: number_strings(r["value"])))
    return F.concat(own, of_reasons)


def check_explanations(df: DataFrame) -> DataFrame:
    """Add ``violations``: array of texts, empty if the output is fine.

    Input: symbol, status, score, reasons, spread_bps, impact_bps, p_toxic, max_chars.
    Output: headline, subtext, status_label, tooltips (map).
    """
    df = df.withColumn("_allowed", allowed_numbers())
    foreign = lambda text: F.filter(
        numbers_in_text(F.coalesce(text, F.lit(""))),
        lambda x: ~F.array_contains(F.col("_allowed"), x),
    )
    named = lambda where, text: F.transform(
        foreign(text), lambda x: F.concat(where, F.lit(": number "), x)
    )
    fields = [named(F.lit(c), F.col(c)) for c in ("headline", "subtext", "status_label")]
    tips = F.flatten(
        F.transform(F.map_entries("tooltips"), lambda e: named(F.concat(F.lit("tooltip "), e["key"]), e["value"]))
    )
    label = F.when(
        F.col("status_label").isin(*ALLOWED_LABELS), F.array().cast("array<string>")
    ).otherwise(F.array(F.concat(F.lit("status_label: "), F.col("status_label"))))
    size = F.when(
        F.char_length("headline") > F.col("max_chars"), F.array(F.lit("headline: too long"))
    ).otherwise(F.array().cast("array<string>"))
    return df.withColumn(
        "violations", F.concat(label, *fields, F.coalesce(tips, F.array().cast("array<string>")), size)
    ).drop("_allowed")


def validate_or_fallback(df: DataFrame) -> DataFrame:
    """Replace an output with violations by the template; ``was_valid`` says which."""
    checked = check_explanations(df)
    ok = F.size("violations") == 0
    code = F.get("reasons", F.lit(0))["code"]
    safe = fallback_headline(F.col("symbol"), F.col("status"), code, F.col("max_chars"))
    return checked.withColumns(
        {
            "was_valid": ok,
            "headline": F.when(ok, F.col("headline")).otherwise(safe),
            "subtext": F.when(ok, F.col("subtext")).otherwise(F.lit("")),
            "status_label": F.when(ok, F.col("status_label")).otherwise(status_label(F.col("status"))),
            "tooltips": F.when(ok, F.col("tooltips")).otherwise(
                F.create_map().cast("map<string,string>")
            ),
        }
    )
