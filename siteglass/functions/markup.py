"""HTML column functions: comments, raw text, start tags, attributes, body text.

HTML is read with regular expressions inside Spark projections, so pages stay in
the JVM. Quoted attribute values may hold ``>``, other quotes mean nothing; script and style content is never
taken for tags; unclosed elements run on to the next anchor or the end of input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, decode_entities

# Inside of a tag after its name. A quote opens a value only after an equals sign.
_INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))*+"""
_TAG = rf"<[a-zA-Z/!?]{_INSIDE}>"
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
_RAW_CUT = "\u0001"


def _skip_attrs(wanted: str) -> str:
    """Attributes before the one that ``wanted`` matches; possessive, so any number is safe."""
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
    return rf"""(?:(?![\s/]+{wanted})[\s/]++[^\s=>/]++(?:\s*+=\s*+{value})?+)*+"""


def strip_comments(h: Column) -> Column:
    cut = F.regexp_replace(h, r"(?s)<!--.*?(?:-->|\z)", "")
    return F.when(F.contains(h, F.lit("<!--")), cut).otherwise(h)


def blank_raw_text(h: Column) -> Column:
    """Empty the content of script and style elements, keeping their tags."""
    out = h
    for name in ("script", "style"):
        out = F.regexp_replace(
            out, rf"(?is)(<{name}(?:[\s/][^>]*)?>).*?(</{name}|\z)", "$1$2"
        )
    return out


def start_tags(markup: Column, names: str) -> Column:
    """All start tags whose name matches ``names`` (a ``|`` list), in order."""
    pattern = rf"(?i)(<(?:{names})(?:[\s/]{_INSIDE})?>)"
    return F.regexp_extract_all(markup, F.lit(pattern), 1)


def is_tag(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)^<{name}[\s/>]")


def attr(tag: Column, name: str, decode: bool = True) -> Column:
    """Attribute value; an empty string when absent or without a value.

    Keyword values hold no character references and need no decoding.
    """
    raw = F.regexp_extract(
        tag, rf"(?is)^<[a-z][^\s/>]*+{_skip_attrs(rf'{name}\s*=')}[\s/]+{name}\s*=\s*{_VALUE}", 1
    )
    value = F.regexp_replace(raw, r"""(?s)\A(["'])(.*)\1\z""", "$2")
    return bind(value, decode_entities) if decode else value


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)^<[a-z][^\s/>]*+{_skip_attrs(rf'{name}[\s=/>]')}[\s/]+{name}[\s=/>]")


def strip_tags(h: Column) -> Column:
    return F.regexp_replace(h, _TAG, "")


def element_text(h: Column) -> Column:
    """Text content of a fragment that holds no script or style element."""
    return bind(strip_tags(h), decode_entities)


def first_element_text(markup: Column, name: str) -> Column:
    """Text of the first ``name`` element; null when the page has none."""
    inner = F.regexp_extract(
        markup, rf"(?is)<{name}(?:[\s/]{_INSIDE})?>(.*?)(?:</{name}[\s>]|\z)", 1
    )
    return element_text(inner)


def body_part(h: Column) -> Column:
    """What an HTML parser puts into the body, up to the end of input."""
    after_body = F.regexp_extract(h, rf"(?is)<body(?:[\s/]{_INSIDE})?>(.*)\z", 1)
    after_head = F.regexp_extract(h, r"(?is)</head\s*>(.*)\z", 1)
    no_title = F.regexp_replace(h, r"(?is)<title(?:[\s/][^>]*)?>.*?(?:</title\s*>|\z)", "")
    return (
        F.when(h.rlike(r"(?i)<body[\s/>]"), after_body)
        .when(h.rlike(r"(?i)</head\s*>"), after_head)
        .otherwise(no_title)
    )


def body_text(body: Column, include_script_text: bool = True) -> Column:
    """Concatenated text of a ``body_part``; tags leave no gap.

    Script and style content is character data of the body, as in the DOM's
    ``textContent``; ``include_script_text=False`` leaves it out.
    """
    opening = r"(?i)<(?:script|style)(?:[\s/][^>]*)?>"

    def piece_text(p: Column) -> Column:
        raw = F.regexp_extract(p, r"(?is)^(.*?)(?:</(?:script|style)[\s>]|\z)", 1)
        rest = F.regexp_extract(p, r"(?is)</(?:script|style)[^>]*>(.*)\z", 1)
        return F.concat(raw, element_text(rest)) if include_script_text else element_text(rest)

    def with_raw_text(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.size(pieces)), piece_text)
        return F.concat(element_text(F.element_at(pieces, 1)), F.array_join(rest, ""))

    return bind(
        body,
        lambda b: F.when(
            b.rlike(opening),
            bind(F.split(F.regexp_replace(b, opening, _RAW_CUT), _RAW_CUT), with_raw_text),
        ).otherwise(element_text(b)),
    )


def anchors(markup: Column) -> Column:
    """``array<struct<tag, href, text>>`` of the ``a`` elements, in order.

    An anchor ends at its end tag, at the next anchor, or at the end of input.
    """
    marked = F.regexp_replace(markup, r"(?i)<a([\s/>])", _RAW_CUT + "$1")

    def parse(p: Column, tag: Column) -> Column:
        body = F.regexp_extract(p, rf"(?is)^{_INSIDE}>(.*?)(?:</a[\s>]|\z)", 1)
        return F.struct(
            tag.alias("tag"),
            attr(tag, "href").alias("href"),
            element_text(body).alias("text"),
        )

    def with_tag(p: Column) -> Column:
        tag = F.concat(F.lit("<a"), F.regexp_extract(p, rf"^({_INSIDE}>)", 1))
        return bind(tag, lambda t: parse(p, t))

    def all_pieces(pieces: Column) -> Column:
        return F.transform(F.slice(pieces, 2, F.size(pieces)), with_tag)

    return bind(F.split(marked, _RAW_CUT), all_pieces)


def json_ld_blocks(no_comments: Column) -> Column:
    """Raw text of every JSON-LD script element."""
    blocks = F.regexp_extract_all(
        no_comments, F.lit(r"(?is)(<script(?:[\s/][^>]*)?>.*?(?:</script|\z))"), 1
    )
    is_ld = F.filter(
        blocks,
        lambda b: F.lower(attr(F.regexp_extract(b, "^(<[^>]*>)", 1), "type", decode=False))
        == "application/ld+json",
    )
    return F.transform(is_ld, lambda b: F.regexp_extract(b, r"(?is)^<[^>]*>(.*?)(?:</script|\z)", 1))
