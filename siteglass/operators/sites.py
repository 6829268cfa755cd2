"""Per-site facts: one row per site out of all its pages, in a single shuffle.

All aggregates are sums, counts, or the value at the smallest order number, so a
site with a third of all pages is reduced where its pages are read. "Other pages"
figures are the site's total minus the home page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_round, js_trim
from ..functions.urls import is_homepage_path, origin
from .rule_texts import SITE_TEXTS
from .rules import STAGE_GRAPH, STAGE_PAGE, STAGE_PROBE, STAGE_SITE, Rule, apply_rules

# Word counts above which a page is a content page.
LINKING_WORDS, SCORING_WORDS = 150, 250
SLOW_PAGE_MS = 3000
_LATER = 1 << 62


def title_score(title: Column) -> Column:
    n = F.length(title)
    return (
        F.when(title.isNull(), 0)
        .when(n.between(10, 70), 100)
        .when(n.between(5, 9), 75)
        .when(n.between(71, 90), 85)
        .otherwise(60)
    )


def meta_score(description: Column, og_title: Column, og_description: Column) -> Column:
    n = F.length(description)
    return (
        F.when(n >= 70, 100)
        .when(n >= 30, 80)
        .when(og_description.isNotNull() | og_title.isNotNull(), 70)
        .otherwise(0)
    )


def h1_score(h1_count: Column, title: Column, is_home: Column) -> Column:
    return (
        F.when(h1_count == 1, 100)
        .when((h1_count == 0) & is_home & title.isNotNull(), 55)
        .when((h1_count == 0) & title.isNotNull(), 40)
        .when(h1_count == 0, 0)
        .when(h1_count == 2, 70)
        .otherwise(50)
    )


def _page_facts(signals: DataFrame) -> DataFrame:
    """The slim numeric row of a page that enters the shuffle."""
    c = F.col
    home = is_homepage_path(c("url"))
    return signals.select(
        "site_key",
        "page_seq",
        "url",
        F.lit(True).alias("ok"),
        home.alias("is_home"),
        "is_https",
        title_score(c("title")).alias("title_score"),
        meta_score(c("meta_description"), c("og_title"), c("og_description")).alias("meta_score"),
        h1_score(c("h1_count"), c("title"), home).alias("h1_score"),
        c("canonical").isNotNull().alias("canonical"),
        c("has_viewport").alias("viewport"),
        c("has_lang").alias("lang"),
        c("has_favicon").alias("favicon"),
        c("has_social_tags").alias("social_tags"),
        c("og_image").isNotNull().alias("og_image"),
        c("has_twitter_card").alias("twitter_card"),
        "is_indexable",
        "has_schema",
        "schema_valid",
        "mixed_content",
        "has_flash",
        "word_count",
        (c("h2_count") > 0).alias("has_h2"),
        "internal_links",
        "status_code",
        "generic_link_count",
        "images_without_alt",
        "iframe_count",
        "load_time_ms",
        c("compression").isNotNull().alias("compressed"),
        "html_size_bytes",
        c("looks_like_spa_shell").alias("spa"),
        (
            c("has_linkedin_link")
            | c("has_facebook_link")
            | c("has_instagram_link")
            | c("has_youtube_link")
        ).alias("profile_link"),
        *[
            c(f"security_headers.{name}").alias(name)
            for name in (
                "hsts", "csp", "x_content_type", "x_frame_options", "referrer_policy",
                "permissions_policy",
            )
        ],
    )


_BLENDED = ("canonical", "viewport", "lang", "favicon", "social_tags", "og_image", "twitter_card")
_SCORED = ("title_score", "meta_score", "h1_score")
_HOME_ONLY = (
    "is_https", "is_indexable", "has_schema", "status_code", "load_time_ms", "compressed",
    "html_size_bytes", "profile_link", "hsts", "csp", "x_content_type", "x_frame_options",
    "referrer_policy", "permissions_policy",
)


def site_facts(
    signals: DataFrame, sites: DataFrame | None = None, failures: DataFrame | None = None
) -> DataFrame:
    """Everything the site rules and the score checks need from the pages.

    ``failures`` (``site_key``, ``url``, ``page_seq``) are pages that could not be
    fetched: they count in coverage and load averages, not in scores. ``sites``
    may give a ``base_url`` per site; otherwise it is the first page's origin.
    """
    c = F.col
    pages = _page_facts(signals)
    if failures is not None:
        lost = failures.select("site_key", "page_seq", "url", F.lit(False).alias("ok"))
        pages = pages.unionByName(lost, allowMissingColumns=True)
    ok = c("ok")
    home_order = F.when(ok, F.when(c("is_home"), c("page_seq")).otherwise(c("page_seq") + F.lit(_LATER)))
    first_order = F.when(ok, c("page_seq"))
    content = ~c("is_home") & (c("word_count") > SCORING_WORDS)
    linking = ~c("is_home") & (c("word_count") > LINKING_WORDS)
    reachable = c("status_code") < 400
    capped = F.least(c("internal_links"), F.lit(15))

    def count(test: Column, name: str) -> Column:
        return F.count_if(F.coalesce(test, F.lit(False))).alias(name)

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value.cast("long")), F.lit(0)).alias(name)

    aggregates = [
        F.count(F.lit(1)).alias("n_crawled"),
        count(ok, "n_pages"),
        F.min_by("url", "page_seq").alias("first_url"),
        F.coalesce(F.min_by("spa", first_order), F.lit(False)).alias("is_spa_shell"),
        F.coalesce(F.min_by("is_https", first_order), F.lit(True)).alias("first_https"),
        *[F.min_by(n, home_order).alias(f"home_{n}") for n in (*_BLENDED, *_SCORED, *_HOME_ONLY)],
        *[count(c(n), f"n_{n}") for n in _BLENDED],
        *[total(c(n), f"sum_{n}") for n in _SCORED],
        count(c("has_schema"), "n_schema"),
        count(c("has_schema") & c("schema_valid"), "n_schema_valid"),
        count(c("mixed_content"), "n_mixed_content"),
        count(c("has_flash"), "n_flash"),
        count(content, "n_content"),
        count(content & c("has_h2"), "n_content_h2"),
        count(content & (c("internal_links") >= 3), "n_content_linked"),
        total(F.when(content, capped), "sum_content_links"),
        count(reachable, "n_reachable"),
        count(reachable & (c("internal_links") >= 3), "n_reachable_linked"),
        total(F.when(reachable, capped), "sum_reachable_links"),
        count((c("status_code") > 0) & reachable, "n_status_ok"),
        count(c("generic_link_count") > 0, "n_generic"),
        count(c("images_without_alt") > 0, "n_missing_alt"),
        total(c("images_without_alt"), "sum_missing_alt"),
        count(c("iframe_count") > 3, "n_heavy_iframes"),
        count(linking, "n_linking"),
        count(linking & (c("internal_links") < 3), "n_low_linking"),
        total(c("load_time_ms"), "sum_load_ms"),
        count(c("load_time_ms") > SLOW_PAGE_MS, "n_slow"),
    ]
    facts = pages.groupBy("site_key").agg(*aggregates)
    own = F.concat(origin(c("first_url")), F.lit("/"))
    if sites is None:
        return facts.withColumn("base_url", own)
    given = sites.select("site_key", F.col("base_url").alias("_base"))
    return (
        facts.join(given, "site_key", "left")
        .withColumn("base_url", F.coalesce("_base", own))
        .drop("_base")
    )


def coverage(facts: DataFrame) -> DataFrame:
    """Social and schema summary, load average and slow pages of each crawl."""
    n = F.col("n_crawled")
    share = lambda hits: js_round(F.col(hits) / n * 100)
    schema_share = share("n_schema")
    return facts.select(
        "site_key",
        F.col("n_crawled").alias("total_pages"),
        F.col("n_social_tags").alias("pages_with_og_tags"),
        share("n_social_tags").alias("social_coverage"),
        F.col("n_schema").alias("pages_with_schema"),
        schema_share.alias("schema_coverage"),
        # Ratings of the schema coverage.
        F.when(schema_share >= 70, "GOOD")
        .when(schema_share >= 30, "NEEDS_IMPROVEMENT")
        .otherwise("POOR")
        .alias("schema_rating"),
        js_round(F.col("sum_load_ms") / n).alias("average_load_ms"),
        F.col("n_slow").alias("slow_pages"),
    )


def low_link_ratio(facts: DataFrame) -> DataFrame:
    """Content pages with fewer than three internal links; sites of one page have none."""
    several = F.col("n_pages") > 1
    zero = F.lit(0).cast("long")
    low = F.when(several, F.col("n_low_linking")).otherwise(zero)
    content = F.when(several, F.col("n_linking")).otherwise(zero)
    return facts.select(
        "site_key",
        "base_url",
        low.alias("low_link_pages"),
        content.alias("content_pages"),
        F.coalesce(low / F.nullif(content, zero), F.lit(0.0)).alias("low_link_ratio"),
    )


def duplicate_values(signals: DataFrame, column: str) -> DataFrame:
    """Equal texts on more than one page of a site, with the first page's URL."""
    value = F.lower(js_trim(F.col(column)))
    return (
        signals.where(F.col(column).isNotNull())
        .groupBy("site_key", value.alias("value"))
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.min_by("url", "page_seq").alias("first_url"),
            F.min("page_seq").alias("page_seq"),
        )
        .where(F.col("pages") > 1)
    )


def duplicate_issues(duplicates: DataFrame, key: str) -> DataFrame:
    severity, stage = {"dup-titles": ("critical", 1), "dup-metas": ("warning", 2)}[key]
    rule = Rule(key, F.lit(True), severity, SITE_TEXTS[key], (F.col("pages"),))
    return apply_rules(duplicates, [rule], STAGE_SITE + stage, F.col("first_url"))


def crawl_failures(failures: DataFrame) -> DataFrame:
    """Findings for pages that could not be fetched, ahead of their page rules."""
    rule = Rule(
        "crawl-failure",
        F.lit(True),
        "critical",
        SITE_TEXTS["crawl-failure"],
        (F.col("url"), F.coalesce("error", F.lit("Unknown error"))),
    )
    return apply_rules(failures, [rule], STAGE_PAGE, F.col("url"), first_seq=0)


def crawl_site_issues(facts: DataFrame) -> DataFrame:
    """Robots, sitemap, coverage and site-wide linking findings.

    ``facts`` is ``site_facts``, with ``robots_txt`` and ``sitemap_found`` joined in where they
    were looked at: without the column a site was not checked, with null it has none.
    """
    n = F.col("n_crawled")
    url = F.col("base_url")
    share = lambda hits: js_round(F.col(hits) / n * 100)

    def rule(key: str, when: Column, severity: str, *values: Column) -> Rule:
        return Rule(key, when, severity, SITE_TEXTS[key], values)

    no_robots, no_sitemap = F.lit(False), F.lit(False)
    if "robots_txt" in facts.columns:
        no_robots = F.coalesce("robots_txt", F.lit("")) == ""
    if "sitemap_found" in facts.columns:
        no_sitemap = ~F.coalesce("sitemap_found", F.lit(False))
    files = [
        rule("no-robots", no_robots, "warning"),
        rule("no-sitemap", no_sitemap, "warning"),
    ]
    shares = [
        rule("low-schema-coverage", F.col("n_schema") * 2 < n, "notice", share("n_schema")),
        rule(
            "low-og-coverage",
            F.col("n_social_tags") / n < 0.8,
            "notice",
            share("n_social_tags"),
        ),
    ]
    low, content = F.col("n_low_linking"), F.col("n_linking")
    graph = [
        rule(
            "site-low-internal-linking",
            (F.col("n_pages") > 1) & (low > 0) & (low * 2 >= content),
            "warning",
            low,
            content,
        )
    ]
    return (
        apply_rules(facts, files, STAGE_SITE, url)
        .unionByName(apply_rules(facts, shares, STAGE_SITE + 3, url))
        .unionByName(apply_rules(facts, graph, STAGE_GRAPH + 1, url))
    )


def probe_issues(probes: DataFrame, sites: DataFrame) -> DataFrame:
    """Findings from redirect probes of the http and www variants."""
    c = F.col
    rules = [
        Rule(
            "no-https-redirect",
            ~c("https_enforced") & F.startswith(c("base_url"), F.lit("https://")),
            "warning",
            SITE_TEXTS["no-https-redirect"],
        ),
        Rule(
            "www-not-canonicalized",
            c("www_resolves") & c("apex_resolves") & ~c("canonicalized"),
            "warning",
            SITE_TEXTS["www-not-canonicalized"],
        ),
    ]
    return apply_rules(probes.join(sites, "site_key"), rules, STAGE_PROBE, c("base_url"))


def probe_facts(probes: DataFrame) -> DataFrame:
    """``https_enforced`` and ``www_canonicalized`` per site for scoring."""
    c = F.col
    return probes.select(
        "site_key",
        "https_enforced",
        (c("canonicalized") | ~c("www_resolves") | ~c("apex_resolves")).alias("www_canonicalized"),
    )
