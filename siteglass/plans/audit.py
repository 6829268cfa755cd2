"""The full audit: every site in the input, from stored pages to scores."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grouping, links, payloads, rules_external, rules_page, scoring, sites
from ..operators.rules import union_issues
from ..operators.signals import extract_signals, looks_like_html, with_fetch
from ..session import saved
from ..sources.tables import fetch_failures


@dataclass(frozen=True)
class AuditResult:
    """Lazy result tables of an audit run."""

    signals: DataFrame
    facts: DataFrame
    issues: DataFrame
    groups: DataFrame
    group_urls: DataFrame
    severity: DataFrame
    checks: DataFrame
    scores: DataFrame
    coverage: DataFrame
    dropped: DataFrame | None = None


@dataclass(frozen=True)
class AuditInputs:
    """Input tables; everything but the pages may be missing."""

    pages: DataFrame
    fetch_meta: DataFrame | None = None
    failures: DataFrame | None = None
    sites: DataFrame | None = None
    robots: DataFrame | None = None
    sitemap_found: DataFrame | None = None
    url_status: DataFrame | None = None
    probes: DataFrame | None = None
    lab_payloads: DataFrame | None = None
    field_payloads: DataFrame | None = None
    header_scans: DataFrame | None = None
    threats: DataFrame | None = None
    dns_answers: DataFrame | None = None
    html_messages: DataFrame | None = None
    authority: DataFrame | None = None


def _maybe(fn, table: DataFrame | None) -> DataFrame | None:
    return None if table is None else fn(table)


def home_headers(facts: DataFrame) -> DataFrame:
    """Header grade of each site's home page, from the facts row."""
    names = (
        "hsts", "csp", "x_content_type", "x_frame_options", "referrer_policy",
        "permissions_policy",
    )
    packed = F.struct(*[F.col(f"home_{n}").alias(n) for n in names])
    return payloads.grade_headers(
        facts.where(F.col("n_pages") > 0).select(
            "site_key", F.col("home_is_https").alias("is_https"), packed.alias("security_headers")
        )
    )


def site_total(rows: DataFrame, name: str) -> DataFrame:
    """Rows per site as ``name``; rows that were counted before bring their counts as ``name``."""
    n = F.sum(name) if name in rows.columns else F.count(F.lit(1))
    return rows.groupBy("site_key").agg(n.alias(name))


def score_facts(
    facts: DataFrame,
    duplicates: DataFrame,
    orphans: DataFrame,
    totals: DataFrame | None = None,
    robots: DataFrame | None = None,
    sitemap_found: DataFrame | None = None,
    probes: DataFrame | None = None,
    **external: DataFrame | None,
) -> DataFrame:
    """Facts with everything the checks read, one row per site."""
    tables = [
        site_total(duplicates, "duplicate_title_sets"),
        site_total(orphans, "orphan_pages"),
        totals,
        robots,
        sitemap_found,
        _maybe(sites.probe_facts, probes),
    ]
    defaults = {
        "duplicate_title_sets": 0,
        "orphan_pages": 0,
        "broken_links": 0,
        "redirect_links": 0,
        "robots_txt": "",
        "sitemap_found": False,
        "https_enforced": False,
        "www_canonicalized": True,
    }
    return scoring.attach_tables(facts, [t for t in tables if t is not None], defaults, **external)


def audit_signals(signals: DataFrame, inputs: AuditInputs) -> AuditResult:
    """Everything after signal extraction.

    Pass signals that were written to a table (or checkpointed): they are read by
    several branches, and extraction is by far the most expensive step.
    """
    facts = sites.site_facts(signals, inputs.sites, inputs.failures)
    site_urls = facts.select("site_key", "base_url")
    titles = sites.duplicate_values(signals, "title")
    metas = sites.duplicate_values(signals, "meta_description")
    pages = links.page_urls(signals)
    edges = links.link_edges(signals)
    orphans = links.orphan_pages(edges, pages, site_urls)

    checked = totals = None
    if inputs.url_status is not None:
        first_links = links.first_seen_links(links.checkable_links(signals))
        checked = links.link_status(first_links, inputs.url_status)
        totals = links.broken_redirect_totals(checked)

    runs = worst = None
    if inputs.lab_payloads is not None:
        runs = payloads.prefer_strategy(payloads.lab_runs(inputs.lab_payloads))
        worst = payloads.worst_lab_audits(
            payloads.dedupe_lab_audits(payloads.lab_audits(inputs.lab_payloads))
        )
    external = {
        "field": _maybe(payloads.field_ratings, inputs.field_payloads),
        "headers": inputs.header_scans
        if inputs.header_scans is not None
        else home_headers(facts),
        "threats": inputs.threats,
        "dns": _maybe(payloads.dns_flags, inputs.dns_answers),
        "markup": _maybe(payloads.html_message_counts, inputs.html_messages),
        "authority": _maybe(payloads.authority_rank, inputs.authority),
    }
    full = score_facts(
        facts,
        titles,
        orphans,
        totals,
        inputs.robots,
        inputs.sitemap_found,
        inputs.probes,
        lab=runs,
        **{k: v for k, v in external.items() if k != "threats"},
    )
    given = {"robots_txt": inputs.robots, "sitemap_found": inputs.sitemap_found}
    unchecked = [name for name, table in given.items() if table is None]
    stages = [
        rules_page.page_issues(signals),
        sites.duplicate_issues(titles, "dup-titles"),
        sites.duplicate_issues(metas, "dup-metas"),
        sites.crawl_site_issues(full.drop(*unchecked)),
        rules_external.external_issues(site_urls, **external),
        links.orphan_issues(orphans),
    ]
    if inputs.failures is not None:
        stages.append(sites.crawl_failures(inputs.failures))
    if checked is not None:
        stages.append(links.link_issues(checked, pages))
    if runs is not None:
        stages.append(rules_external.lab_issues(runs, worst, site_urls))
    if inputs.probes is not None:
        stages.append(sites.probe_issues(inputs.probes, site_urls))
    issues = union_issues(*stages)
    groups = grouping.group_issues(issues)
    return AuditResult(
        signals=signals,
        facts=full,
        issues=issues,
        groups=groups,
        group_urls=grouping.issue_group_urls(issues),
        severity=grouping.severity_counts(groups),
        checks=scoring.check_scores(full),
        scores=scoring.category_scores(full),
        coverage=sites.coverage(facts),
    )


def run_audit(inputs: AuditInputs, signals_path: str) -> AuditResult:
    """Extract signals once into ``signals_path`` and audit from there.

    Answers without a document start are no pages: ``dropped`` lists them with the
    reason. The HTML is read in a single narrow pass and never shuffled; a lost executor
    only repeats its own files. ``fetch_meta`` meets the signals, and failed fetches in it
    are the failures unless those are given.
    """
    spark = inputs.pages.sparkSession
    is_page = looks_like_html(F.col("html"))
    documents = inputs.pages.where(is_page)
    reason = F.when(F.col("html").isNull(), "no_answer").otherwise("not_html")
    dropped = inputs.pages.where(~is_page).select("page_id", "url", reason.alias("reason"))
    extract_signals(documents).write.mode("overwrite").parquet(signals_path)
    signals = spark.read.parquet(signals_path)
    if inputs.fetch_meta is not None:
        signals = saved(with_fetch(signals, inputs.fetch_meta), "fetched")
        if inputs.failures is None:
            inputs = replace(inputs, failures=fetch_failures(inputs.pages, inputs.fetch_meta))
    return replace(audit_signals(signals, inputs), dropped=dropped)
