"""The page rules: findings that one page's signals decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round, to_fixed
from .rule_texts import NOINDEX_BY_HEADER, NOINDEX_BY_META, PAGE_TEXTS
from .rules import STAGE_PAGE, Rule, apply_rules


def _either(test: Column, yes: str, no: str) -> Column:
    return F.when(test, yes).otherwise(no)


def page_rules() -> list[Rule]:
    """Rules in report order. Append your own to extend an audit."""
    c = F.col
    home, spa = c("is_homepage"), c("looks_like_spa_shell")
    title_len = F.length("title")
    meta, meta_len = c("meta_description"), F.length("meta_description")
    words, https = c("word_count"), c("is_https")
    sec = lambda name: c(f"security_headers.{name}")
    on_home = lambda sev, other: _either(home, sev, other)

    def rule(key: str, when: Column, severity, *values: Column, **more) -> Rule:
        return Rule(key, when, severity, PAGE_TEXTS[key], values, **more)

    return [
        rule("ssl-not-enabled", ~https, "critical"),
        rule("missing-title", c("title").isNull(), "critical"),
        rule("title-too-short", title_len < 10, on_home("notice", "warning"), title_len),
        rule("title-too-long", title_len > 70, "notice", title_len),
        rule("meta-description-missing", meta.isNull() & ~spa, on_home("warning", "critical")),
        rule("meta-description-short", meta_len < 70, "warning", meta_len),
        rule("missing-h1", (c("h1_count") == 0) & ~spa, on_home("notice", "critical")),
        rule("multiple-h1", c("h1_count") > 1, "warning", c("h1_count")),
        rule("no-h2", (c("h2_count") == 0) & (words > 300), "warning"),
        rule("low-content", ~home & ~spa & (words > 0) & (words < 300), "warning", words),
        rule(
            "noindex",
            ~c("is_indexable"),
            "critical",
            _either(c("x_robots_noindex"), NOINDEX_BY_HEADER, NOINDEX_BY_META),
        ),
        rule("missing-canonical", c("canonical").isNull(), "warning"),
        rule("no-schema", ~c("has_schema"), "notice"),
        rule("invalid-schema", c("has_schema") & ~c("schema_valid"), "warning"),
        rule("mixed-content", c("mixed_content"), "warning"),
        rule(
            "generic-anchors",
            c("generic_link_count") > 2,
            _either(c("generic_link_count") > 6, "warning", "notice"),
            c("generic_link_count"),
        ),
        rule(
            "low-internal-linking",
            (c("internal_links") < 3) & (words > 200),
            "notice",
            c("internal_links"),
        ),
        rule("no-viewport", ~c("has_viewport"), on_home("warning", "critical")),
        rule("no-lang", ~c("has_lang"), "warning"),
        rule("no-favicon", ~c("has_favicon"), "notice"),
        rule(
            "missing-alt",
            c("images_without_alt") > 0,
            _either(c("images_without_alt") * 2 > c("image_count"), "warning", "notice"),
            c("images_without_alt"),
            c("image_count"),
        ),
        rule("heavy-iframes", c("iframe_count") > 2, "notice", c("iframe_count")),
        rule("flash", c("has_flash"), "critical"),
        rule("plain-email", c("has_email_plaintext"), "notice"),
        rule(
            "slow-load",
            c("load_time_ms") > 2000,
            _either(c("load_time_ms") > 3500, "warning", "notice"),
            to_fixed(c("load_time_ms") / 1000, 1),
        ),
        rule(
            "large-html",
            c("html_size_bytes") > 500_000,
            "warning",
            js_round(c("html_size_bytes") / 1024),
        ),
        rule("no-compression", c("compression").isNull(), "notice"),
        rule("no-og", ~c("has_social_tags"), on_home("warning", "notice")),
        rule("no-og-image", c("has_social_tags") & c("og_image").isNull(), "warning"),
        rule("no-twitter-card", ~c("has_twitter_card"), "notice"),
        rule(
            "http-",
            c("status_code") >= 400,
            "critical",
            c("status_code"),
            title_values=(c("status_code"),),
            key_value=c("status_code"),
        ),
        rule("no-hsts", home & https & ~sec("hsts"), "notice"),
        rule("no-xcto", home & ~sec("x_content_type"), "notice"),
        rule("no-frame-protection", home & ~sec("x_frame_options") & ~sec("csp"), "notice"),
        rule("spa-shell", home & spa, "notice"),
    ]


def page_issues(signals: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of every page; a projection and one explode."""
    return apply_rules(signals, rules or page_rules(), STAGE_PAGE, F.col("url"))
