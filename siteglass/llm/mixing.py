"""Mixing sources to target weights by hash-threshold histograms.

A source's target is first met by whole copies of the source, the rest by those of its
documents whose hash lies below a threshold. The threshold comes from histograms: words
are summed by source and hash bucket, the bucket in which the budget ends is found, and
only that bucket is split further. Copies are nested: a document taken for a smaller
budget is taken for every larger one. No document is sorted or moved; exchanges carry
histograms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import carried, stored
from .words import n_words

# A document's place: three hexadecimal digits per level, refined level by level.
DIGITS_PER_LEVEL = 3
LEVELS = 4
MAX_COPIES = 3


def document_hash(doc_id: Column, text: Column) -> Column:
    """Even hash of a document, as hexadecimal digits; equal rows share it."""
    whole = F.md5(F.coalesce(text, F.lit("")))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), whole))


def sized(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Size and hash digits of every document; its text is left behind."""
    digits = F.substring(document_hash(F.col("doc_id"), F.col("text")), 1, DIGITS_PER_LEVEL * LEVELS)
    return docs.select(
        carried(keep), "source",
        n_words(F.col("text")).alias("size"), digits.alias("_hash"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """Target of every source: (source, source_size, target).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of
    all sizes. A target ends at ``max_copies`` times its source; what is over is shared
    again by weight. Such shares are ``level * weight`` for one common level, found by
    ordering sources by the level at which each is full. One row per source is ordered
    here, never one per document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    full_at = F.col("source_size") * F.lit(max_copies) / F.col("weight")
    filling = Window.orderBy("_full_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy()
    ranked = totals.withColumn("weight", weight).withColumn("_full_at", full_at)
    shares = ranked.withColumns(
        {
            "_rank": F.row_number().over(filling),
            "_words_left": F.sum("source_size").over(rest)
            - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "_weight_left": F.sum("weight").over(rest)
            - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = F.col("_words_left") / F.col("_weight_left")
    # Full sources come first in this order; the first that isn't sets the level.
    first_open = F.min(F.when(F.col("_full_at") > level, F.struct("_rank", level.alias("level"))))
    open_level = first_open.over(rest)["level"]
    cap = (max_copies * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(open_level * F.col("weight"), cap))
    return shares.select("source", "source_size", target.alias("target"))


def _same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join slim rows of documents with at most one row per source."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """The hash up to which each source fills its budget: (source, _below, _last).

    Documents with a hash below ``_below`` are taken, and those whose digits equal
    ``_last`` (the last refined bucket) where that comes nearer to the budget.
    """
    state = budgets.select("source", F.lit("").alias("_prefix"), F.col("_budget").alias("_left"))
    for level in range(1, LEVELS + 1):
        width = level * DIGITS_PER_LEVEL
        inside = F.substring("_hash", 1, width - DIGITS_PER_LEVEL) == F.col("_prefix")
        histogram = (
            _same_source(sizes, state)
            .where(inside)
            .groupBy("source", F.substring("_hash", 1, width).alias("_bucket"))
            .agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"))
        )
        upto = Window.partitionBy("source").orderBy("_bucket")
        summed = histogram.withColumn("_upto", F.sum("_words").over(upto))
        ends = (
            summed.where(F.col("_upto") > F.col("_left"))
            .groupBy("source")
            .agg(F.min(F.struct("_bucket", "_upto", "_words", "_left")).alias("_end"))
        )
        left = F.col("_end._left") - (F.col("_end._upto") - F.col("_end._words"))
        state = stored(
            ends.select(
                "source",
                F.col("_end._bucket").alias("_prefix"),
                left.alias("_left"),
                F.col("_end._words").alias("_words"),
            ),
            "mix-level",
        )
    nearer = F.abs(F.col("_words") - F.col("_left")) < F.abs(F.col("_left"))
    return state.select(
        "source", F.col("_prefix").alias("_below"), F.when(nearer, F.col("_prefix")).alias("_last")
    )


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_copies: int = MAX_COPIES,
    keep: list[str] | None = None,
) -> DataFrame:
    """How many words the mix takes of every document, copies counted.

    ``docs`` has ``doc_id``, ``text`` and ``source``. Columns named by ``keep`` come back in a
    struct ``row`` in place of ``doc_id``, so that no name can clash. A null source is one more source and comes last; a null or empty text
    has size 0 and adds nothing; rows equal in ``doc_id`` and text share a hash and are taken
    together. A source that can't reach its target by whole documents ends at most half
    of one hash bucket's words away from it, which is one document unless rows repeat.
    """
    sizes = stored(sized(docs), "mix-sizes")
    targets = stored(source_targets(sizes, weights, max_copies), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    copies = F.least(copies, F.lit(max_copies)).cast("long")
    plan = targets.withColumn("_copies", copies)
    budgets = plan.withColumn("_budget", F.col("target") - F.col("_copies") * F.col("source_size"))
    ends = thresholds(sizes, budgets.where(F.col("_copies") < max_copies))
    rows = sized(docs, keep) if keep else sizes
    rows = _same_source(_same_source(rows, plan), ends)
    digits = F.col("_hash")
    once_more = F.coalesce((digits < F.col("_below")) | (digits == F.col("_last")), F.lit(False))
    taken = F.col("size") * (F.col("_copies") + once_more.cast("long"))
    return rows.select("row" if keep else "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
