"""License scans by diagonal voting.

The rolling word k-grams of every text are joined, by hash, to the places of the same
k-grams in license templates. A hit at word ``i`` of a text and word ``j`` of a template
votes for the diagonal ``i - j``: an exact copy puts all votes on one diagonal, inserted or
missing words move the rest to a neighbour. Votes are summed by diagonal, neighbouring
diagonals are merged into spans, and a span counts if it covers enough of its template
without being much longer than it.

Only the hits are exchanged, keyed by document. The template side of the join holds one
row per template word and is limited by ``MAX_TEMPLATE_WORDS``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as their licenses word them: (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy "
               "of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of "
            "the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
            "without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
MAX_TEMPLATE_WORDS = 20_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.lower()) if w]


def template_grams(spark: SparkSession, templates, k: int) -> DataFrame:
    """(gram, template, label, place, n_grams): every k-gram of every template."""
    rows = [(i, label, _template_words(text)) for i, (label, text) in enumerate(templates)]
    if sum(len(w) for _, _, w in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
    schema = "template int, label string, words array<string>"
    grams = spark.createDataFrame(rows, schema).where(F.size("words") >= k)
    return grams.select(
        "template", "label", (F.size("words") - k + 1).alias("n_grams"),
        F.posexplode(_gram_hashes("words", k)).alias("place", "gram"),
    )


def _gram_hashes(words: str, k: int) -> Column:
    """Hash of the k words from each place on; empty for fewer than k words."""
    n = F.size(words)
    return F.when(
        n >= k,
        F.transform(
            F.sequence(F.lit(0), n - k),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def license_spans(
    docs: DataFrame,
    templates=TEMPLATES,
    k: int = 4,
    neighbour: int = 3,
    min_coverage: float = 0.6,
    max_stretch: float = 2.0,
) -> DataFrame:
    """Verified spans: (doc_key, label, template, start_word, end_word, coverage).

    ``coverage`` is the share of the template's k-grams found in the span. ``doc_key`` is
    ``document_key`` of the row; rows equal in ``doc_id`` and text have the same spans.
    """
    fixed = template_grams(docs.sparkSession, templates, k)
    keyed = docs.select(document_key().alias("doc_key"), license_words(F.col("text")).alias("_w"))
    grams = keyed.select("doc_key", F.posexplode(_gram_hashes("_w", k)).alias("at", "gram"))
    hits = grams.join(F.broadcast(fixed), "gram")
    votes = hits.groupBy(
        "doc_key", "template", "label", "n_grams", (F.col("at") - F.col("place")).alias("diagonal")
    ).agg(
        F.collect_set("place").alias("places"),  # no more than the template has words
        F.min("at").alias("first"),
        F.max("at").alias("last"),
    )
    order = Window.partitionBy("doc_key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > neighbour
    spans = (
        votes.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int"))
        .withColumn("_span", F.sum("_new").over(order))
        .select("*", F.explode("places").alias("place"))
        .groupBy("doc_key", "template", "label", "n_grams", "_span")
        .agg(
            F.count_distinct("place").alias("covered"),
            F.min("first").alias("start_word"),
            (F.max("last") + k).alias("end_word"),
        )
    )
    coverage = F.col("covered") / F.col("n_grams")
    longest = max_stretch * (F.col("n_grams") + k - 1)
    return (
        spans.withColumn("coverage", F.round(coverage, 6))
        .where((coverage >= min_coverage) & (F.col("end_word") - F.col("start_word") <= longest))
        .select("doc_key", "label", "template", "start_word", "end_word", "coverage")
    )


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _phrase_at(words: str, i: Column, phrase: str) -> Column:
    parts = [F.get(words, i + j) == w for j, w in enumerate(phrase.split())]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def scanned(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """Phrases and template spans of every document, one row each.

    ``docs`` has ``doc_id`` and ``text``. A null or empty text has no words, no places, empty
    labels and score 0. ``score`` is the best coverage of a template; a document that only
    has a phrase scores 0.5. Repeated rows get the same answer each.
    """
    keyed = docs.select("doc_id", document_key().alias("doc_key"), license_words(F.col("text")).alias("_w"))
    # Two blanks between words, so that neighbouring places don't share one.
    keyed = keyed.withColumn("_all", F.concat(F.lit(" "), F.array_join("_w", "  "), F.lit(" ")))

    def times(phrase: str) -> Column:
        wanted = f" {phrase.replace(' ', '  ')} "
        cut = F.octet_length("_all") - F.octet_length(F.replace("_all", F.lit(wanted), F.lit("")))
        return (cut / F.lit(len(wanted))).cast("long")

    counts = {f"_n{i}": times(p) for i, p in enumerate(phrases)}
    keyed = keyed.withColumns(counts)
    n_base = reduce(lambda a, b: a + b, [F.col(c) for c in counts])
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_w")),
        lambda i: reduce(lambda a, b: a | b, [_phrase_at("_w", i, p) for p in phrases]),
    )
    found = [F.when(F.col(c) > 0, F.lit(label)) for c, label in zip(counts, phrases.values())]
    base = keyed.withColumn("_starts", F.when(n_base > 0, starts)).select(
        "doc_id", "doc_key", F.size("_w").cast("long").alias("n_words"), n_base.alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"),
        F.array_max("_starts").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))).alias("_base"),
    )
    spans = (
        license_spans(docs, templates=templates)
        .groupBy("doc_key")
        .agg(F.collect_set("label").alias("_labels"), F.max("coverage").alias("_best"))
    )
    both = base.join(spans, "doc_key", "left")
    labels = F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))
    phrase_score = F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(F.coalesce("_best", F.lit(0.0)), phrase_score).alias("score"),
    )
