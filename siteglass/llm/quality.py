"""Quality rules by distribution divergence.

Every text gets two histograms: character classes, and common words (the function words
of some languages, everything else as one bin). The histograms of all documents of a
language are summed into that language's reference. A text is compared with each
reference by Jensen-Shannon distance (0: equal, 1: disjoint); its distance is the smallest.
Texts too short for a meaningful histogram are not judged by distance.

Everything is built-in column functions; the histograms of a text are made in its row,
so the only exchange is the sum per language.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import carried, stored
from .words import SPACE, words

# Function words of the languages that have a reference.
COMMON_WORDS = {
    "en": "the of and to in is that for it with as was".split(),
    "de": "der die und in den von zu das mit sich nicht ist".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y a los se del las un".split(),
}
SYMBOLS = "[#*$%&|<>]"
CHARACTER_CLASSES = ("space", "upper", "lower", "digit", "punctuation", "symbol", "other")


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the verdict.

    ``max_class_distance`` and ``max_word_distance`` reject texts farther than this from
    every reference; a text is judged by them only from ``min_chars`` code points and
    ``min_words`` words. A language has a reference from ``min_reference_words`` words.
    """

    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)
    max_class_distance: float = 0.27
    max_word_distance: float = 0.4
    min_chars: int = 200
    min_words: int = 50
    min_reference_words: int = 1000

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for ws in self.common_words.values() for w in ws})


def _count(text: Column, outside: str) -> Column:
    """Code points left when runs of ``outside`` are cut out."""
    return F.length(F.regexp_replace(text, outside, "")).cast("long")


def _times(padded: Column, word: str) -> Column:
    """How often a word stands in a text whose words have a blank on either side."""
    cut = F.octet_length(padded) - F.octet_length(F.replace(padded, F.lit(f" {word} "), F.lit("")))
    return (cut / F.lit(len(word.encode()) + 2)).cast("long")


def text_features(docs: DataFrame, rules: QualityRules, keep: list[str]) -> DataFrame:
    """Counts and histograms of every text, next to the columns ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spread = docs.select(*keep, text.alias("_text"), words(text).alias("_words"))
    n = F.size("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    hits = F.filter("_words", lambda w: F.lower(w).isin(rules.vocabulary))
    # Two blanks between words, so that each keeps its own when another is cut out.
    common = F.concat(F.lit(" "), F.lower(F.array_join("_hits", "  ")), F.lit(" "))
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
        ),
    )
    spread = spread.withColumns(
        {"_lines": lines, "_hits": hits, "_windows": windows}
    ).withColumns({"_common": common, "_hits": F.size("_hits")})
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    ordered = F.when(
        repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    )
    spread = spread.withColumn("_ordered", ordered)
    twice = F.filter(
        "_ordered",
        lambda x, i: F.coalesce(F.get("_ordered", i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("_ordered", i + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    )
    chars, word_chars = F.length("_text"), F.length(F.array_join("_words", ""))
    letters, upper = _count(F.col("_text"), r"[^\p{L}]+"), _count(F.col("_text"), r"[^\p{Lu}]+")
    spread = spread.select(
        *keep,
        chars.cast("long").alias("n_chars_read"),
        n.cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        (chars - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        letters.alias("_letters"),
        upper.alias("_upper"),
        _count(F.col("_text"), r"[^0-9]+").alias("_digits"),
        _count(F.col("_text"), r"[^.,;:!?'\"()\-]+").alias("_punctuation"),
        F.col("_common"),
        F.col("_hits"),
    )
    classes = [
        F.col("n_chars_read") - F.col("word_chars"), F.col("_upper"),
        F.col("_letters") - F.col("_upper"), F.col("_digits"), F.col("_punctuation"),
        F.col("n_symbols"),
    ]
    rest = F.col("n_chars_read") - reduce(lambda a, b: a + b, classes)
    found = [_times(F.col("_common"), w) for w in rules.vocabulary]
    uncommon = F.col("n_words") - F.col("_hits")
    return spread.select(
        *keep, "n_chars_read", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*classes, rest).alias("class_counts"),
        F.array(*found, uncommon).alias("word_counts"),
    )


def language_references(features: DataFrame, rules: QualityRules) -> dict[str, dict[str, list[int]]]:
    """Summed histograms of the languages in ``rules``, over all their documents.

    One row per language of the parameter comes to the driver.
    """
    sums = [
        F.array(*[F.sum(F.col(name)[i]) for i in range(size)]).alias(name)
        for name, size in (("class_counts", len(CHARACTER_CLASSES)), ("word_counts", len(rules.vocabulary) + 1))
    ]
    rows = (
        features.where(F.col("lang").isin(*rules.common_words))
        .groupBy("lang").agg(F.sum("n_words").alias("n"), *sums)
        .where(F.col("n") >= rules.min_reference_words)
    )
    return {
        r["lang"]: {"class_counts": list(r["class_counts"]), "word_counts": list(r["word_counts"])}
        for r in rows.orderBy("lang").collect()
    }


def js_distance(counts: Column, total: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram with a sum to a fixed one; null if empty."""
    whole = float(sum(reference)) or 1.0
    fixed = F.array(*[F.lit(x / whole) for x in reference])

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(
        counts,
        fixed,
        lambda x, q: part(x / total, (x / total + q) / 2) / 2 + part(q, (x / total + q) / 2) / 2,
    )
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0))))


def judged(docs: DataFrame, rules: QualityRules | None = None, keep: list[str] | None = None) -> DataFrame:
    """Counts, distances and verdict of every document.

    ``docs`` has ``doc_id``, ``text`` and ``lang``. Columns named by ``keep`` come back in a
    struct ``row`` in place of ``doc_id``, so that no name can clash. A null or empty text has no words, fails the base rule and is not kept;
    a null or unknown ``lang`` adds to no reference but is judged like any other; without
    any reference the distances are null and reject nothing. Repeated rows are judged
    each for itself. Distances are rounded to six places, so that reruns agree.
    """
    rules = rules or QualityRules()
    name = "row" if keep else "doc_id"
    features = stored(text_features(docs.select(carried(keep), "text", "lang"), rules, [name, "lang"]), "quality")
    references = language_references(features, rules)

    def nearest(name: str, total: str) -> Column:
        found = [F.round(js_distance(F.col(name), F.col(total), r[name]), 6) for r in references.values()]
        return F.least(*found) if len(found) > 1 else (found or [F.lit(None).cast("double")])[0]

    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    base_failed = (n < 50) | (100 * repeated > 50 * n)
    enough = (n >= rules.min_words) & (F.col("n_chars_read") >= rules.min_chars)
    far = F.coalesce(F.col("class_distance") > rules.max_class_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > rules.max_word_distance, F.lit(False)
    )
    return (
        features.withColumns(
            {"class_distance": nearest("class_counts", "n_chars_read"), "word_distance": nearest("word_counts", "n_words")}
        )
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~(enough & far))
        .select(
            name, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "class_distance", "word_distance",
        )
    )
