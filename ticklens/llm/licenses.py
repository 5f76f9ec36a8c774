"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined with the positions of the same
hash in a table of templates. A hit at text word ``p`` and template word ``q`` votes for the
diagonal ``p - q``. Votes are counted per diagonal; neighbouring diagonals of one template,
which an inserted or a dropped word leaves behind, are merged; and what the merged span covers
of the template is verified. Hits are compared word by word, so a hash collision never counts.

One scan of the texts and one shuffle, of hits only, by row. The template table is broadcast:
it comes from the arguments and is refused above ``MAX_TEMPLATE_WORDS``, whatever the corpus.
A text of any length is one row and streams its k-grams; no group holds more than the hits of
one text. Null texts count as empty and have no words, hence no hits; such rows, repeated rows
and rows with a null id are all returned. Input columns other than the carried ones are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklens.llm.common import text_of

K = 3
MAX_TEMPLATE_WORDS = 20_000

#: Word breaks of a lower-cased text: ASCII characters other than digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose exact occurrence names a licence.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Usual notices of licences, found by the share of them that a text holds.
NOTICES = (
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    ),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

Template = tuple[str, str]


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case, as far as words of ASCII letters can tell.

    ``lower`` also maps other letters; only two of those turn into ASCII, so texts with one of
    them take the slower way.
    """
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BREAKS, -1), "")


def template_rows(phrases: tuple[Template, ...], notices: tuple[Template, ...], k: int = K) -> list[tuple]:
    """(template, label, exact, words, grams, position, word 1 … word k)."""
    rows = []
    for tid, (label, phrase) in enumerate([*phrases, *notices]):
        words = [w for w in re.split(BREAKS, phrase.lower()) if w]
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {phrase!r}")
        grams = len(words) - k + 1
        rows += [(tid, label, tid < len(phrases), len(words), grams, p, *words[p : p + k]) for p in range(grams)]
    if len(rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{len(rows)} template positions; more than {MAX_TEMPLATE_WORDS} are not broadcast")
    return rows


def values(rows: list[tuple]) -> str:
    """The rows as the list of an SQL VALUES clause."""
    cell = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def template_table(spark: SparkSession, rows: list[tuple], k: int = K) -> DataFrame:
    grams = [f"g{j}" for j in range(k)]
    names = ", ".join(["tid", "label", "exact", "t_words", "t_grams", "t_pos", *grams])
    t = spark.sql(f"SELECT * FROM VALUES {values(rows)} AS t({names})")
    # One row more meets every text once, so that texts without a hit stay in the result.
    none = spark.sql(f"SELECT -1 AS tid, '' AS label, false AS exact, 0 AS t_words, 0 AS t_grams, 0 AS t_pos{''.join(f', string(null) AS {g}' for g in grams)}")  # noqa: E501
    return t.withColumn("t_key", F.xxhash64(*grams)).unionByName(none.withColumn("t_key", F.lit(0).cast("long")))


def hits(docs: DataFrame, templates: DataFrame, carry: list[str], text: str = "text", k: int = K) -> DataFrame:
    """One row per text and per gram that a template shares, as (row, template, text position)."""
    rows = docs.select(
        F.struct(*carry).alias("doc"), F.monotonically_increasing_id().alias("rid"), words_of(text_of(text)).alias("w")
    )
    n = F.size("w")
    at = [F.get(F.col("w"), F.col("p") + j) for j in range(k)]
    key = F.when(F.col("p") < 0, F.lit(0).cast("long")).when(F.col("p") + k <= n, F.xxhash64(*at))
    # The texts' rows are made and used once, in one stage: the row numbers need no second reading.
    long = rows.select("doc", "rid", "w", F.explode(F.sequence(F.lit(-1), n - 1)).alias("p")).withColumn("d_key", key)
    same = F.col("tid") < 0
    whole = F.lit(True)
    for j in range(k):
        whole = whole & (at[j] == F.col(f"g{j}"))
    found = long.join(F.broadcast(templates), (F.col("d_key") == F.col("t_key")) & (same | whole))
    return found.select(
        F.when(same, F.col("doc")).alias("doc"),
        F.when(same, n).alias("n_words"),
        "rid", "tid", "label", "exact", "t_words", "t_grams", "t_pos", "p",
    )


def scan(
    docs: DataFrame,
    carry: list[str],
    phrases: tuple[Template, ...] = PHRASES,
    notices: tuple[Template, ...] = NOTICES,
    text: str = "text",
    max_shift: int = 4,
    min_cover: float = 0.75,
) -> DataFrame:
    """Per row of ``docs``: the carried columns, ``n_words`` and ``found``.

    ``found`` lists (label, exact, start, end, cover), in words from 0, ends exclusive: every
    place of a phrase, and every span that holds ``min_cover`` of a notice's k-grams within
    half as many words again as the notice has.
    """
    templates = template_table(docs.sparkSession, template_rows(phrases, notices))
    tid = ["rid", "tid", "label", "exact", "t_words", "t_grams"]
    votes = (
        hits(docs, templates, carry, text)
        .repartition("rid")
        .groupBy(*tid, (F.col("p") - F.col("t_pos")).alias("diagonal"))
        .agg(
            F.collect_set("t_pos").alias("seen"),
            F.min("p").alias("lo"),
            F.max("p").alias("hi"),
            F.first("doc", ignorenulls=True).alias("doc"),
            F.max("n_words").alias("n_words"),
        )
    )
    along = W.partitionBy("rid", "tid").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > max_shift)
    island = F.sum(F.coalesce(apart, F.lit(True)).cast("int"))
    spans = (
        votes.withColumn("island", island.over(along))
        .groupBy(*tid, "island")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"),
            F.min("lo").alias("start"),
            (F.max("hi") + K).alias("end"),
            F.first("doc", ignorenulls=True).alias("doc"),
            F.max("n_words").alias("n_words"),
        )
    )
    cover = F.col("votes").cast("double") / F.col("t_grams")
    fits = F.when(F.col("exact"), F.col("votes") == F.col("t_grams")).otherwise(
        (cover >= min_cover) & (2 * (F.col("end") - F.col("start")) <= 3 * F.col("t_words"))
    )
    place = F.struct("start", "end", "label", "exact", cover.alias("cover"))
    return (
        spans.groupBy("rid")
        .agg(
            F.first("doc", ignorenulls=True).alias("doc"),
            F.max("n_words").cast("long").alias("n_words"),
            F.sort_array(F.collect_list(F.when((F.col("tid") >= 0) & fits, place))).alias("found"),
        )
        .select("doc.*", "n_words", "found")
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place and labels of ``scan``'s lists."""
    exact = F.filter("found", lambda x: x.exact)
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x.label))), ",")
    starts = F.transform(exact, lambda x: x.start)
    return scanned.select(
        *(c for c in scanned.columns if c != "found"),
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.cover)), F.lit(0.0)).alias("score"),
    )
