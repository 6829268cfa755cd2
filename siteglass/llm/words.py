"""Words of a text: runs of characters that are no ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
