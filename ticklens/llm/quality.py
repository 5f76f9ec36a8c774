"""Quality rules: a threshold table compiled into one projection, without user functions.

A document is judged from its own text alone: no join, no shuffle, no state. Null and empty
texts have no words and fail the length rule. Equal rows get equal verdicts; other columns of
the input are carried along untouched, whatever their names (the result overwrites only the
names in ``OWN``, the ratios and the verdict columns).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import SPACES, let, text_of, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Names that the measures take.
OWN = {*MEASURES, "stop_words", "__words", "__lines", "__symbols", "__bare", "__n_lines", "__bullets", "__ellipses"}

#: Words without a letter.
BARE = rf"(?<![^{SPACES}])[^{SPACES}\p{{L}}]++(?![^{SPACES}])"

# Frequent function words of the languages the corpus is expected to hold.
STOP_WORDS = {
    "en": "the be to of and that have with for in is it on was are this as at by or an from",
    "fr": "le la les de des du un une et que qui dans en est pour pas sur au par avec ce il",
    "de": "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es",
    "es": "el la los las de y que en un una por con para del se no es lo al como su más",
}


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` lies below ``least`` or above ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# Ratios are over words, characters or lines as the name says. The limits mark text that is
# mostly not prose; ordinary prose of any of the languages lies well inside.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("stop_words", "stop_words", 1, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
    Rule("words_without_letters", "bare_word_ratio", None, 0.4),
)


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside a window that the text holds at least twice, each counted once.

    Windows are compared by a 64-bit hash of their words. A text whose hashes are all distinct,
    the usual case, is done after one hash set; else equal windows become neighbours by a sort of
    (hash, start), so the work stays n log n for a text of any length.
    """
    starts = F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(
        F.array().cast("array<int>")
    )
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(window))))

    def twice(grams: Column) -> Column:
        same = lambda x, j: F.coalesce(x.h == F.get(grams, j).h, F.lit(False))
        return F.filter(grams, lambda x, j: same(x, j - 1) | same(x, j + 1))

    def covered(starts: Column) -> Column:
        reach = F.transform(
            starts, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(starts, j + 1) - p, F.lit(window)))
        )
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def spread(hashes: Column) -> Column:
        grams = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(grams, twice)
        return let(F.sort_array(F.transform(found, lambda x: x.i)), covered)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(spread(h)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``MEASURES`` and the ratios that ``RULES`` names."""
    t = text_of(text)
    stop = F.array(*(F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()})))
    kept = [c for c in docs.columns if c not in OWN]
    split = docs.select(
        *kept,
        words_of(t).alias("__words"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(rf"[^{SPACES}]")).alias("__lines"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).alias("__symbols"),
        F.size(F.regexp_extract_all(t, F.lit(BARE), F.lit(0))).alias("__bare"),
    )
    w, lines = F.col("__words"), F.col("__lines")
    flat = F.array_join(w, "")
    counted = split.select(
        *kept,
        F.size(w).cast("long").alias("n_words"),
        F.length(flat).cast("long").alias("word_chars"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.array_intersect(w, stop)).alias("stop_words"),
        F.col("__bare"),
        F.size(lines).alias("__n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(rf"^[{SPACES}]*[-*•]"))).alias("__bullets"),
        F.size(F.filter(lines, lambda x: x.rlike(rf"(\.\.\.|…)[{SPACES}]*$"))).alias("__ellipses"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns(
        {
            "mean_word_length": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "dup_line_ratio": ratio("n_dup_lines", "__n_lines"),
            "bullet_line_ratio": ratio("__bullets", "__n_lines"),
            "ellipsis_line_ratio": ratio("__ellipses", "__n_lines"),
            "bare_word_ratio": ratio("__bare", "n_words"),
        }
    ).drop("__bare", "__n_lines", "__bullets", "__ellipses")


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a measured row breaks, as one expression."""
    broken = []
    for r in rules:
        m = F.col(r.measure)
        low = F.lit(False) if r.least is None else m < r.least
        high = F.lit(False) if r.most is None else m > r.most
        broken.append(F.when(low | high, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """Measures, ``base_failed`` (too short or too repetitive), ``failed_rules`` and ``kept``."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        measure(docs, text)
        .withColumn("base_failed", base)
        .withColumn("failed_rules", compiled(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
