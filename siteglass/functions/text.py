"""Text, number and date column functions (native expressions only)."""

from __future__ import annotations

import html.entities
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space class of ECMAScript regular expressions. The rare
# characters sit behind one range test, which keeps the class fast on plain text.
JS_WS = (
    r"[\t\n\x0B\f\r \x{00A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes.

    Catalyst copies a column into every place that mentions it, also inside
    conditional branches, where it is not shared. A one-element ``transform``
    names the value instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^{JS_WS}+|{JS_WS}+\z", "")


def trim_to_null(c: Column) -> Column:
    return F.nullif(js_trim(c), F.lit(""))


def squash_ws(c: Column) -> Column:
    """Collapse every white-space run to one space and trim."""
    return F.trim(F.regexp_replace(c, rf"{JS_WS}+", " "))


def count_words(squashed: Column) -> Column:
    """Words in text that ``squash_ws`` has already normalised."""
    return F.when(squashed == "", F.lit(0)).otherwise(
        F.length(squashed) - F.length(F.replace(squashed, F.lit(" "), F.lit(""))) + 1
    )


def js_round(c: Column) -> Column:
    """Round half up toward +infinity, as a long."""
    return F.floor(c + F.lit(0.5)).cast("long")


def to_fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value.

    ``format_number`` rounds the exact value but sends ties to even; real ties are
    odd multiples of a power of two and go up.
    """
    x = c.cast("double")
    scaled = x * F.lit(float(2 ** (digits + 1)))
    tie = (scaled == F.floor(scaled)) & (F.pmod(scaled, F.lit(2.0)) == 1.0)
    plain = F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))
    return F.when(tie, F.format_string(f"%.{digits}f", x)).otherwise(plain)


def strip_markdown(c: Column) -> Column:
    """``[text](url)`` becomes ``text``; back-ticks, stars, underscores go."""
    return js_trim(
        F.regexp_replace(F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1"), "[`*_]", "")
    )


def sanitize_text(c: Column) -> Column:
    """Drop tags and ``javascript:`` schemes."""
    return js_trim(
        F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "(?i)javascript:", "")
    )


def truncate_ellipsis(c: Column, limit: int) -> Column:
    clean = squash_ws(F.regexp_replace(c, "<[^>]*>", ""))
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.substring(clean, 1, limit - 1), F.lit("…"))
    )


def strip_json_fence(c: Column) -> Column:
    """Remove a surrounding Markdown code fence."""
    trimmed = js_trim(c)
    fence = r"(?is)^```(?:json)?\s*(.*?)```\z"
    return F.when(
        F.startswith(trimmed, F.lit("```")) & trimmed.rlike(fence),
        js_trim(F.regexp_extract(trimmed, fence, 1)),
    ).otherwise(trimmed)


def json_or(c: Column, default: Column) -> Column:
    """Parsed JSON as VARIANT, or the default where the text is not JSON."""
    return F.coalesce(F.try_parse_json(c), default)


def format_utc(ts: Column) -> Column:
    """``Jan 5, 2024, 3:07 PM UTC``; a dash for a missing time."""
    return F.coalesce(
        F.concat(F.date_format(ts, "MMM d, yyyy, h:mm a"), F.lit(" UTC")), F.lit("—")
    )


def format_utc_short(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy"), F.lit("—"))


def _entity_map(names: Iterable[str]) -> Column:
    """Characters of named references as one literal map."""
    pairs = "\u0001".join(f"{n}\u0002{html.entities.html5[n + ';']}" for n in sorted(names))
    return F.str_to_map(F.lit(pairs), F.lit("\u0001"), F.lit("\u0002"))


def _named(name: Column) -> Column:
    """Character of a named reference; the short list of HTML 4 is searched first."""
    common = set(html.entities.name2codepoint) | {"apos"}
    every = {n.removesuffix(";") for n in html.entities.html5 if n.endswith(";")}
    return F.coalesce(
        F.try_element_at(_entity_map(common), name), F.try_element_at(_entity_map(every - common), name)
    )


def _numbered(name: Column) -> Column:
    """Character of ``#123`` or ``#x7b``; null when out of range or a surrogate."""
    digits = F.when(
        F.lower(F.substring(name, 2, 1)) == "x", F.upper(F.regexp_replace(name, "^#[xX]0*", ""))
    ).otherwise(F.hex(F.regexp_replace(name, "^#", "").try_cast("long")))
    valid = "^00(?!000000)(00(?!D[89A-F])|0[1-9A-F]|10)"
    return bind(
        F.lpad(digits, 8, "0"), lambda p: F.when(p.rlike(valid), F.decode(F.unhex(p), "UTF-32"))
    )


def _decode_piece(p: Column, name: Column) -> Column:
    char = (
        F.when(F.startswith(name, F.lit("#")), _numbered(name))
        .otherwise(_named(name))
    )
    known = F.concat(char, F.substring(p, F.length(name) + 2, F.length(p)))
    return F.coalesce(F.when(name != "", known), F.concat(F.lit("&"), p))


_REFERENCE = r"^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def decode_entities(c: Column) -> Column:
    """Decode character references in one left-to-right pass.

    Handles the named references of HTML 5 that end in a semicolon, and decimal and
    hexadecimal numbers of any length; numbers of no character stay. Texts without ``&`` are returned untouched.
    """

    def piece(p: Column) -> Column:
        return bind(F.regexp_extract(p, _REFERENCE, 1), lambda name: _decode_piece(p, name))

    def all_pieces(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.size(pieces)), piece)
        return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))

    def other_references(v: Column) -> Column:
        return F.when(F.contains(v, F.lit("&")), bind(F.split(v, "&"), all_pieces)).otherwise(v)

    # References never overlap, so the most common one can be cut out first.
    around_amp = F.array_join(F.transform(F.split(c, "&amp;"), other_references), "&")
    return F.when(F.contains(c, F.lit("&")), around_amp).otherwise(c)
