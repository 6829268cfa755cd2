"""Link tables and the link graph of each site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import is_homepage_path, normalize_page_url
from ..session import discard, saved
from .rule_texts import SITE_TEXTS
from .rules import ISSUE_COLUMNS, STAGE_GRAPH, STAGE_PAGE, Rule, apply_rules

# Links checked per page, and more for the home page.
SAMPLE_LINKS, SAMPLE_HOME_EXTRA = 25, 15


def page_urls(signals: DataFrame) -> DataFrame:
    """Slim page table ``(site_key, page_id, page_seq, url, norm_url)``."""
    return signals.select(
        "site_key", "page_id", "page_seq", "url", normalize_page_url(F.col("url")).alias("norm_url")
    )


def link_edges(signals: DataFrame) -> DataFrame:
    """One slim row per internal link, duplicates kept, in document order."""
    return signals.select(
        "site_key",
        F.col("page_id").alias("src_id"),
        F.col("page_seq").alias("src_seq"),
        normalize_page_url(F.col("url")).alias("src_url"),
        F.posexplode("internal_link_targets").alias("pos", "target_url"),
    )


def page_link_counts(edges: DataFrame) -> DataFrame:
    """Internal links per source page and distinct targets, from the edge table."""
    return (
        edges.groupBy("site_key", "src_id", "target_url")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("site_key", "src_id")
        .agg(F.sum("n").alias("internal_links"), F.count(F.lit(1)).alias("distinct_targets"))
    )


def unique_pages(pages: DataFrame) -> DataFrame:
    """One page per (site, normalised URL); the last one crawled wins."""
    return pages.groupBy("site_key", "norm_url").agg(
        F.max_by("page_id", "page_seq").alias("page_id"),
        F.max_by("url", "page_seq").alias("url"),
        F.max("page_seq").alias("page_seq"),
    )


def edges_to_pages(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose target was crawled, without links from a page to itself.

    Every page of a site tends to link to the same few targets. Adaptive execution splits
    such hot targets where there are any; the page side is not copied for the rest.
    """
    targets = unique_pages(pages).select(
        "site_key", F.col("norm_url").alias("target_url"), F.col("page_id").alias("dst_id")
    )
    others = edges.where(F.col("src_url") != F.col("target_url"))
    joined = others.join(targets, ["site_key", "target_url"])
    return joined.select("site_key", "src_id", "pos", "target_url", "dst_id")


def _inbound(edges: DataFrame) -> DataFrame:
    """Inbound links per target, summed before any join."""
    return (
        edges.where(F.col("src_url") != F.col("target_url"))
        .groupBy("site_key", F.col("target_url").alias("norm_url"))
        .agg(F.count(F.lit(1)).alias("inbound"))
    )


def inbound_counts(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Inbound links per crawled URL, zero included, counted with multiplicity."""
    return (
        unique_pages(pages)
        .join(_inbound(edges), ["site_key", "norm_url"], "left")
        .withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    )


def orphan_pages(edges: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Crawled pages no other page links to, except home pages.

    Sites with a single page have no orphans. ``sites`` is ``(site_key, base_url)``.
    """
    crawled = unique_pages(pages).join(_inbound(edges), ["site_key", "norm_url"], "left_anti")
    many = pages.groupBy("site_key").agg(F.count(F.lit(1)).alias("n_pages"))
    return orphans_among(crawled, sites.join(many, "site_key"))


def orphans_among(unlinked: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages without inbound links that are neither home page nor alone on their site.

    ``sites`` is ``(site_key, base_url, n_pages)``.
    """
    several = sites.where(F.col("n_pages") > 1).select(
        "site_key", normalize_page_url(F.col("base_url")).alias("base_norm")
    )
    return (
        unlinked.join(several, "site_key")
        .where((F.col("norm_url") != F.col("base_norm")) & ~is_homepage_path(F.col("url")))
        .drop("base_norm")
    )


def orphan_issues(orphans: DataFrame) -> DataFrame:
    rule = Rule("orphan-page", F.lit(True), "warning", SITE_TEXTS["orphan-page"], (F.col("url"),))
    return apply_rules(orphans, [rule], STAGE_GRAPH, F.col("url"))


# --- link checks --------------------------------------------------------------


def checkable_links(signals: DataFrame) -> DataFrame:
    """Distinct same-host links of each page with their position."""
    return signals.select(
        "site_key",
        "page_id",
        "page_seq",
        "is_homepage",
        F.posexplode("checked_links").alias("pos", "url"),
    )


def first_seen_links(links: DataFrame) -> DataFrame:
    """Each link of a site once, at the first page that shows it."""
    order = F.struct("page_seq", "pos")
    return links.groupBy("site_key", "url").agg(
        F.min_by("page_id", order).alias("page_id"),
        F.min("page_seq").alias("page_seq"),
        F.min_by("pos", order).alias("pos"),
    )


def exclude_seen(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Links of a later run that no earlier run has checked."""
    return links.join(seen.select("site_key", "url").distinct(), ["site_key", "url"], "left_anti")


def sample_links(
    links: DataFrame, n: int = SAMPLE_LINKS, home_extra: int = SAMPLE_HOME_EXTRA
) -> DataFrame:
    """The sample of a live crawl: per page the first ``n`` links not picked by earlier pages.

    The home page gets a second round. Links that a page leaves out stay open to later
    pages. The choice is found in rounds: every page claims its first links that are still
    open, each link of a site goes to the earliest page that claims it and closes for all
    later ones, and pages that lost a claim go on to their next links. When no claim is
    lost, the claims are the choice. Each round closes at least one link of every page that
    lost, so there are no more rounds than the longest page has links. Order is kept per
    page and per link only; no site passes through one task.
    """
    c = F.col
    open_ = saved(links.select("site_key", "page_id", "page_seq", "is_homepage", "pos", "url"), "open-links")
    while True:
        claims = saved(_claims(open_, n, home_extra), "claims")
        holders = claims.groupBy("site_key", "url").agg(F.min("page_seq").alias("holder"))
        lost = claims.join(holders, ["site_key", "url"]).where(c("page_seq") > c("holder"))
        if lost.isEmpty():
            discard(open_)
            return claims
        # A holder can only be followed by an earlier page: later ones lose the link for good.
        left = open_.join(holders, ["site_key", "url"], "left")
        left = left.where(c("holder").isNull() | (c("page_seq") <= c("holder"))).drop("holder")
        remaining = saved(left, "open-links")
        discard(open_, claims)
        open_ = remaining


def _claims(open_links: DataFrame, n: int, home_extra: int) -> DataFrame:
    """Each page's first ``n`` open links, for a home page further ones in a second round."""
    c = F.col
    page = Window.partitionBy("site_key", "page_seq")
    ranked = open_links.withColumn("_rank", F.row_number().over(page.orderBy("pos")))
    # A link that the first round took is no link for the second.
    first = F.min("_rank").over(Window.partitionBy("site_key", "page_seq", "url")) <= n
    rounds = ranked.where((c("_rank") <= n) | c("is_homepage")).withColumn("_again", first & (c("_rank") > n))
    later = F.row_number().over(page.orderBy(c("_again"), c("_rank")))
    rounds = rounds.withColumn("_later", later).where(~c("_again") & (c("_later") <= n + home_extra))
    took = F.when(c("_rank") <= n, 1).otherwise(2)
    return rounds.select("site_key", "page_id", "page_seq", "pos", "url", took.alias("round"))


def link_status(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Classify checked links: redirect, broken (error or no answer), or ok.

    ``links`` has each link of a site once; ``statuses`` is ``(url, status)`` with
    one row per probed URL, a null status for a failed request.
    """
    status = F.col("status")
    kind = (
        F.when(status.isNull() | (status >= 400), "broken")
        .when(status.between(300, 399), "redirect")
        .otherwise("ok")
    )
    return links.join(statuses, "url", "left").withColumn("kind", kind)


def broken_redirect_totals(checked: DataFrame) -> DataFrame:
    """Distinct broken and redirecting URLs per site."""
    per_url = checked.groupBy("site_key", "url").agg(F.max("kind").alias("kind"))
    return per_url.groupBy("site_key").agg(
        F.count_if(F.col("kind") == "broken").alias("broken_links"),
        F.count_if(F.col("kind") == "redirect").alias("redirect_links"),
    )


def link_issues(checked: DataFrame, page_urls_table: DataFrame, first_seq: int = 100) -> DataFrame:
    """Broken-link and redirect findings of the pages that first show the links."""
    broken, moved = F.col("kind") == "broken", F.col("kind") == "redirect"
    rounds = "round" if "round" in checked.columns else None
    keys = ["site_key", "page_id", "page_seq"] + ([rounds] if rounds else [])
    per_page = (
        checked.where(broken | moved)
        .groupBy(*keys)
        .agg(
            F.count_if(broken).alias("n_broken"),
            F.min_by("url", F.when(broken, F.col("pos"))).alias("broken_url"),
            F.count_if(moved).alias("n_moved"),
            F.min_by("url", F.when(moved, F.col("pos"))).alias("moved_url"),
        )
    )
    urls = page_urls_table.select("site_key", "page_id", F.col("url").alias("page_url"))
    rules = [
        Rule("broken-links", F.col("n_broken") > 0, "critical", SITE_TEXTS["broken-links"],
             (F.col("n_broken"), F.col("broken_url"))),
        Rule("redirect-links", F.col("n_moved") > 0, "warning", SITE_TEXTS["redirect-links"],
             (F.col("n_moved"), F.col("moved_url"))),
    ]
    df = per_page.join(urls, ["site_key", "page_id"])
    issues = apply_rules(df, rules, STAGE_PAGE, F.col("page_url"), first_seq)
    return issues.select(*ISSUE_COLUMNS)
