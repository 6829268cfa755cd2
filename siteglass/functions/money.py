"""Payment amounts. Money is kept in paise as a long; text only at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_trim

# Accepted amounts in paise, and the labelled choices.
MIN_PAISE, MAX_PAISE = 4900, 1_000_000
AMOUNT_LABELS = {4900: "₹49", 9900: "₹99", 14900: "₹149", 19900: "₹199", 29900: "₹299", 49900: "₹499"}
# Messages for rejected amounts.
NOT_AN_AMOUNT = "Enter a valid amount in rupees."
TOO_SMALL = "Minimum amount is ₹49."
TOO_LARGE = "Maximum amount is ₹10,000."
EMPTY = "Enter an amount."
NOT_WHOLE = "Use whole rupees only (no decimals or symbols)."
UNSAFE = "Amount is too large."
_MAX_SAFE = 9007199254740991


def format_inr(paise: Column) -> Column:
    """Whole rupees with Indian digit grouping, halves away from zero."""
    rupees = F.round(paise / F.lit(100), 0).cast("long")
    digits = F.abs(rupees).cast("string")
    grouped = F.regexp_replace(digits, r"(\d)(?=(\d\d)+\d$)", "$1,")
    return F.concat(F.when(rupees < 0, "-").otherwise(""), F.lit("₹"), grouped)


def amount_label(paise: Column) -> Column:
    flat = [x for k, v in AMOUNT_LABELS.items() for x in (F.lit(k).cast("long"), F.lit(v))]
    known = F.try_element_at(F.create_map(*flat), paise.cast("long"))
    return F.coalesce(known, format_inr(paise))


def amount_error(paise: Column) -> Column:
    """Why an amount in paise is not accepted; null when it is."""
    return (
        F.when(paise.isNull() | (paise <= 0), NOT_AN_AMOUNT)
        .when(paise < MIN_PAISE, TOO_SMALL)
        .when(paise > MAX_PAISE, TOO_LARGE)
    )


def valid_amount(paise: Column) -> Column:
    return amount_error(paise).isNull()


def parse_amount(text: Column) -> Column:
    """``struct<amount_paise, error>`` from typed text in rupees."""
    trimmed = js_trim(text)
    # Too many digits for a long also means too large.
    rupees = F.coalesce(trimmed.try_cast("long"), F.lit(_MAX_SAFE + 1))
    paise = F.when(rupees <= _MAX_SAFE // 100, rupees * 100)
    error = (
        F.when(F.coalesce(trimmed, F.lit("")) == "", EMPTY)
        .when(~trimmed.rlike(r"^[0-9]+\z"), NOT_WHOLE)
        .when(rupees > _MAX_SAFE, UNSAFE)
        .when(rupees > MAX_PAISE // 100, TOO_LARGE)
        .otherwise(amount_error(paise))
    )
    return F.struct(F.when(error.isNull(), paise).alias("amount_paise"), error.alias("error"))
