"""Page signals: one row in, one row out, no shuffle.

The projections are stacked so that each expensive text (comment-free HTML, tag
list, anchor list, body text) is computed once and dropped as soon as it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import urls as U
from ..functions.text import JS_WS, count_words, squash_ws, trim_to_null

# Link texts that say nothing about the target.
GENERIC_ANCHOR = rf"(?i)^{JS_WS}*(click here|read more|learn more|here|more|link){JS_WS}*\z"
# Patterns looked for in page text and markup.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MIXED_CONTENT = (
    r"""(?i)<(?:img|script|link|iframe|source|video|audio)[^>]+(?:src|href)=["']http://"""
)
APP_ROOT = r"""(?i)<div[^>]+id=["'](?:root|__next|app|__nuxt|svelte)["']"""
LINKEDIN = r"(?i)linkedin\.com/(?:in|company|school)"
FACEBOOK = r"""(?i)facebook\.com/(?!sharer|share)[^"'\s<>]+"""
INSTAGRAM = r"""(?i)instagram\.com/[^"'\s<>]+"""
YOUTUBE = r"(?i)youtube\.com/(?:c|channel|user|@)"
SPA_WORDS = 80
SPA_SCRIPTS = 5
# Security headers kept as booleans, with the response header each one needs.
SECURITY_HEADERS = {
    "hsts": "strict-transport-security",
    "csp": "content-security-policy",
    "x_content_type": "x-content-type-options",
    "x_frame_options": "x-frame-options",
    "referrer_policy": "referrer-policy",
    "permissions_policy": "permissions-policy",
}

_TAGS = "meta|link|html|img|iframe|script|h1|h2|h3"


def looks_like_html(html: Column) -> Column:
    """Whether a stored answer has a document start, wherever it stands; false for null."""
    return F.coalesce(html.rlike("(?i)<html|<!doctype html"), F.lit(False))


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _first(items: Column, test, field: str) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(1))[field]


def _found(lowered: Column, needle: str, html: Column, pattern: str) -> Column:
    """A cheap byte search guards the regular expression."""
    return F.contains(lowered, F.lit(needle)) & html.rlike(pattern)


def _schema_type(v: Column, path: str) -> Column:
    """``@type`` as text; array values are joined with commas."""
    many = F.array_join(F.try_variant_get(v, path, "array<string>"), ",")
    return F.coalesce(many, F.try_variant_get(v, path, "string"))


def _block_types(v: Column) -> Column:
    graph = F.coalesce(
        F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")
    )
    own = F.array(_schema_type(v, "$['@type']"))
    items = F.transform(graph, lambda g: _schema_type(g, "$['@type']"))
    return F.filter(F.concat(own, items), lambda t: t.isNotNull() & (t != ""))


def _truthy(v: Column) -> Column:
    """JavaScript truth of a JSON value."""
    return ~F.coalesce(F.to_json(v).isin('""', "null", "0", "false"), F.lit(True))


def _block_valid(v: Column) -> Column:
    own = F.try_variant_get(v, "$['@context']", "variant")
    first = F.try_variant_get(v, "$['@graph'][0]['@context']", "variant")
    return _truthy(own) | _truthy(first)


def _parse_json_ld(df: DataFrame) -> DataFrame:
    blocks = F.transform(F.col("_json_ld"), F.try_parse_json)
    parsed = F.filter(blocks, lambda v: v.isNotNull())
    return (
        df.withColumn("_ld", F.when(F.size("_json_ld") > 0, parsed))
        .withColumn(
            "schema_types",
            F.coalesce(
                F.flatten(F.transform("_ld", _block_types)), F.array().cast("array<string>")
            ),
        )
        .withColumn(
            "schema_valid", F.coalesce(F.exists(F.col("_ld"), _block_valid), F.lit(False))
        )
    )


def header_signals(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Compression, robots header and the six security booleans.

    Without headers every flag is false, as for a page fetched without any.
    """
    lowered = F.coalesce(
        F.map_from_entries(
            F.transform(
                F.map_entries(F.col(headers)),
                lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
            )
        ),
        F.create_map().cast("map<string,string>"),
    )
    df = df.withColumn("response_headers", lowered)
    h = F.col("response_headers")
    encoding = F.lower(F.try_element_at(h, F.lit("content-encoding")))
    flags = [
        (
            F.coalesce(F.lower(F.try_element_at(h, F.lit(name))) == "nosniff", F.lit(False))
            if flag == "x_content_type"
            else F.map_contains_key(h, name)
        ).alias(flag)
        for flag, name in SECURITY_HEADERS.items()
    ]
    return df.withColumns(
        {
            "compression": F.when(F.contains(encoding, F.lit("br")), F.lit("brotli"))
            .when(F.contains(encoding, F.lit("gzip")), F.lit("gzip"))
            .when(F.contains(encoding, F.lit("zstd")), F.lit("zstd")),
            "x_robots_noindex": F.coalesce(
                F.contains(F.lower(F.try_element_at(h, F.lit("x-robots-tag"))), F.lit("noindex")),
                F.lit(False),
            ),
            "security_headers": F.struct(*flags),
        }
    )


def _link_columns(df: DataFrame) -> DataFrame:
    """Internal, external and generic link counts plus link targets per page."""
    df = df.withColumns(
        {
            "_scheme": U.scheme(F.col("url")),
            "_origin": U.origin(F.col("url")),
            "_path": U.raw_path(F.col("url")),
            "_search": U.search(F.col("url")),
            "site_key": U.site_key(F.col("url")),
        }
    )
    followed = F.filter(
        F.col("_anchors"),
        lambda a: (a["href"] != "")
        & ~F.startswith(a["href"], F.lit("#"))
        & ~F.startswith(a["href"], F.lit("mailto:"))
        & ~F.startswith(a["href"], F.lit("tel:")),
    )
    joined = F.transform(
        followed,
        lambda a: U.join_href(
            a["href"], F.col("_scheme"), F.col("_origin"), F.col("_path"), F.col("_search")
        ),
    )
    df = df.withColumns(
        {
            "generic_link_count": _count(
                F.col("_anchors"),
                lambda a: a["text"].rlike(GENERIC_ANCHOR)
                & ((a["href"] != "") | M.has_attr(a["tag"], "href")),
            ),
            "_joined": F.transform(
                joined, lambda j: F.struct(j.alias("u"), U.site_key(j).alias("k"))
            ),
        }
    )
    mine = F.filter(F.col("_joined"), lambda j: j["k"] == F.col("site_key"))
    valid_other = lambda j: F.coalesce(j["k"] != F.col("site_key"), ~U.is_special(j["u"]))
    return df.withColumns(
        {
            "internal_links": F.size(mine),
            "external_links": _count(F.col("_joined"), valid_other),
            "internal_link_targets": F.transform(mine, lambda j: U.drop_trailing_slash(j["u"])),
            "checked_links": F.array_distinct(
                F.transform(mine, lambda j: U.canonical_url(j["u"]))
            ),
        }
    )


SIGNAL_COLUMNS = (
    "page_id", "page_seq", "site_key", "url", "title", "meta_description", "h1", "h1_count",
    "h2_count", "h3_count", "word_count", "canonical", "is_indexable", "has_social_tags",
    "has_schema", "schema_valid", "status_code", "load_time_ms", "html_size_bytes",
    "has_viewport", "has_lang", "has_hreflang", "hreflang_count", "has_favicon", "is_https",
    "image_count", "images_without_alt", "internal_links", "external_links",
    "internal_link_targets", "generic_link_count", "iframe_count", "script_count", "has_flash",
    "has_linkedin_link", "has_facebook_link", "has_instagram_link", "has_youtube_link",
    "has_email_plaintext", "compression", "og_title", "og_description", "og_image",
    "has_twitter_card", "schema_types", "is_homepage", "x_robots_noindex", "mixed_content",
    "looks_like_spa_shell", "security_headers", "response_headers", "checked_links",
)


def extract_signals(pages: DataFrame, include_script_text: bool = True) -> DataFrame:
    """All page signals.

    ``pages`` needs ``page_id``, ``url``, ``html``; ``page_seq`` (crawl order),
    ``status_code``, ``load_time_ms`` and ``headers`` are used when present.
    """
    defaults = {
        "page_seq": F.col("page_id"),
        "status_code": F.lit(200),
        "load_time_ms": F.lit(0).cast("long"),
        "headers": F.create_map().cast("map<string,string>"),
    }
    df = pages.withColumns({k: v for k, v in defaults.items() if k not in pages.columns})
    html = F.col("html")

    df = df.withColumns({"_clean": M.strip_comments(html), "_lower": F.lower(html)})
    df = df.withColumns(
        {
            "_markup": M.blank_raw_text(F.col("_clean")),
            "_body": squash_ws(M.body_text(M.body_part(F.col("_clean")), include_script_text)),
            "_json_ld": F.when(
                F.contains(F.col("_lower"), F.lit("ld+json")), M.json_ld_blocks(F.col("_clean"))
            ).otherwise(F.array().cast("array<string>")),
        }
    )
    df = df.withColumns(
        {
            "_tags": M.start_tags(F.col("_markup"), _TAGS),
            "_anchors": M.anchors(F.col("_markup")),
            "word_count": count_words(F.col("_body")),
            "has_email_plaintext": F.contains(F.col("_body"), F.lit("@"))
            & F.col("_body").rlike(EMAIL),
            "title": trim_to_null(M.first_element_text(F.col("_markup"), "title")),
            "h1": trim_to_null(M.first_element_text(F.col("_markup"), "h1")),
        }
    )
    tags = F.col("_tags")
    df = df.withColumns(
        {
            "_metas": F.transform(
                F.filter(tags, lambda t: M.is_tag(t, "meta")),
                lambda t: F.struct(
                    M.attr(t, "name", decode=False).alias("name"),
                    M.attr(t, "property", decode=False).alias("property"),
                    M.attr(t, "content").alias("content"),
                ),
            ),
            "_links": F.transform(
                F.filter(tags, lambda t: M.is_tag(t, "link")),
                lambda t: F.struct(
                    F.lower(M.attr(t, "rel", decode=False)).alias("rel"),
                    M.attr(t, "href").alias("href"),
                    M.has_attr(t, "hreflang").alias("hreflang"),
                ),
            ),
            "_imgs": F.filter(tags, lambda t: M.is_tag(t, "img")),
            "h1_count": _count(tags, lambda t: M.is_tag(t, "h1")),
            "h2_count": _count(tags, lambda t: M.is_tag(t, "h2")),
            "h3_count": _count(tags, lambda t: M.is_tag(t, "h3")),
            "iframe_count": _count(tags, lambda t: M.is_tag(t, "iframe")),
            "script_count": _count(tags, lambda t: M.is_tag(t, "script")),
            "has_lang": F.coalesce(
                F.try_element_at(
                    F.transform(
                        F.filter(tags, lambda t: M.is_tag(t, "html")), lambda t: M.attr(t, "lang", decode=False)
                    ),
                    F.lit(1),
                )
                != "",
                F.lit(False),
            ),
        }
    )

    def meta(kind: str, value: str) -> Column:
        return trim_to_null(_first(F.col("_metas"), lambda m: m[kind] == value, "content"))

    links = F.col("_links")
    df = df.withColumns(
        {
            "og_title": meta("property", "og:title"),
            "og_description": meta("property", "og:description"),
            "og_image": meta("property", "og:image"),
            "_twitter": F.coalesce(meta("name", "twitter:card"), meta("name", "twitter:title")),
            "_description": meta("name", "description"),
            "_robots": F.lower(meta("name", "robots")),
            "has_viewport": F.exists("_metas", lambda m: m["name"] == "viewport"),
            "canonical": trim_to_null(_first(links, lambda k: k["rel"] == "canonical", "href")),
            "hreflang_count": _count(links, lambda k: (k["rel"] == "alternate") & k["hreflang"]),
            # Link relations that announce an icon.
            "has_favicon": F.exists(
                links, lambda k: k["rel"].isin("icon", "shortcut icon", "apple-touch-icon")
            ),
            "image_count": F.size("_imgs"),
            "images_without_alt": _count(F.col("_imgs"), lambda t: ~M.has_attr(t, "alt")),
        }
    )
    df = _link_columns(header_signals(_parse_json_ld(df)))
    low = F.col("_lower")
    https = U.is_https(F.col("url"))
    df = df.withColumns(
        {
            "meta_description": F.coalesce("_description", "og_description"),
            "has_social_tags": F.col("og_title").isNotNull() & F.col("og_description").isNotNull(),
            "has_twitter_card": F.col("_twitter").isNotNull(),
            "is_indexable": ~F.coalesce(F.contains("_robots", F.lit("noindex")), F.lit(False))
            & ~F.col("x_robots_noindex"),
            "has_hreflang": F.col("hreflang_count") > 0,
            "has_schema": F.size("schema_types") > 0,
            "is_https": https,
            "is_homepage": U.is_homepage_path(F.col("url")),
            "html_size_bytes": F.octet_length(html),
            "has_flash": F.contains(low, F.lit("<object"))
            | F.contains(low, F.lit("application/x-shockwave-flash")),
            "mixed_content": https & _found(low, "http://", html, MIXED_CONTENT),
            "looks_like_spa_shell": (F.col("word_count") < SPA_WORDS)
            & (html.rlike(APP_ROOT) | (F.col("script_count") >= SPA_SCRIPTS)),
            "has_linkedin_link": _found(low, "linkedin.com/", html, LINKEDIN),
            "has_facebook_link": _found(low, "facebook.com/", html, FACEBOOK),
            "has_instagram_link": _found(low, "instagram.com/", html, INSTAGRAM),
            "has_youtube_link": _found(low, "youtube.com/", html, YOUTUBE),
        }
    )
    return df.select(*SIGNAL_COLUMNS)


def with_fetch(signals: DataFrame, meta: DataFrame) -> DataFrame:
    """Signals that were extracted from HTML alone, completed by status, load time and headers.

    ``meta`` is ``(page_id, status_code, load_time_ms, headers, error)``. Only signals meet it,
    so HTML is never moved. Pages without a row keep status 200 and no headers; pages whose
    fetch failed are left out.
    """
    known = meta.select(
        "page_id", "headers", F.col("error").isNotNull().alias("_failed"),
        F.col("status_code").alias("_status"), F.col("load_time_ms").alias("_load"),
    )
    own = ("compression", "x_robots_noindex", "security_headers", "response_headers")
    df = header_signals(signals.drop(*own).join(known, "page_id", "left"))
    df = df.where(~F.coalesce("_failed", F.lit(False))).withColumns(
        {
            "status_code": F.coalesce("_status", "status_code"),
            "load_time_ms": F.coalesce("_load", "load_time_ms"),
            "is_indexable": F.col("is_indexable") & ~F.col("x_robots_noindex"),
        }
    )
    return df.select(*SIGNAL_COLUMNS)
