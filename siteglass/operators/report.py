"""Report tables: saved audits with their pages, findings and grades.

A report reads saved tables keyed by ``audit_id``. Children stay in long form with
an ordinal, because an audit may hold any number of pages and findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import js_trim, to_fixed
from ..session import by_key
from .grouping import first_rows
from .ranking import id_bucket, ranked
from .rules_external import whole


def attach_page_id(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Page id of each finding by (audit, URL); the last page of a URL wins.

    Findings without a page keep a null id.
    """
    by_url = pages.groupBy("audit_id", F.col("url").alias("affected_url")).agg(
        F.max_by("page_id", "page_seq").alias("page_id")
    )
    plain = issues.drop("page_id")
    return plain.join(by_key(by_url), ["audit_id", "affected_url"], "left")


def issues_with_page(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings with the signals of their page, for recommendation requests."""
    signals = pages.select(
        "audit_id",
        "page_id",
        F.col("url").alias("page_url"),
        F.col("title").alias("page_title"),
        F.col("meta_description").alias("page_meta_description"),
        F.col("h1_count").alias("page_h1_count"),
        F.col("word_count").alias("page_word_count"),
    )
    return issues.join(signals, ["audit_id", "page_id"], "left")


def is_serious(severity: Column) -> Column:
    return severity.isin("critical", "warning")


def pages_with_serious_issue(pages: DataFrame, issues: DataFrame, n: int | None = None) -> DataFrame:
    """Pages with at least one critical or warning finding, the first ``n`` per audit."""
    serious = issues.where(is_serious(F.col("severity"))).select("audit_id", "page_id").distinct()
    hit = pages.join(serious, ["audit_id", "page_id"], "left_semi")
    if n is None:
        return hit
    return first_rows(hit, ["audit_id"], [F.col("page_seq")], n).drop("rank")


def resolve_issue_pages(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings that belong to a page: by stored page id, else by URL."""
    by_url = attach_page_id(issues, pages).select(
        "audit_id", "issue_id", F.col("page_id").alias("url_page_id")
    )
    resolved = issues.join(by_url, ["audit_id", "issue_id"]).withColumn(
        "page_id", F.coalesce("page_id", "url_page_id")
    )
    return resolved.where(F.col("page_id").isNotNull()).drop("url_page_id")


def page_issue_lists(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings of each page in stored order, numbered from 1."""
    rows = resolve_issue_pages(pages, issues).select(
        "audit_id", "page_id", "issue_id", "title", "severity", "description", "recommendation"
    )
    return ranked(
        rows, ["audit_id", "page_id"], [id_bucket(F.col("issue_id"))], [F.col("issue_id")], "position"
    )


def issue_count_per_page(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings with a page id per page, zero included."""
    counts = (
        issues.where(F.col("page_id").isNotNull())
        .groupBy("audit_id", "page_id")
        .agg(F.count(F.lit(1)).alias("issue_count"))
    )
    return pages.join(counts, ["audit_id", "page_id"], "left").withColumn(
        "issue_count", F.coalesce("issue_count", F.lit(0))
    )


def audit_children(pages: DataFrame, issues: DataFrame, alphabetical: bool = True) -> DataFrame:
    """Pages and findings of each audit in report order, as one ordered table.

    Findings are ordered by severity name as the report read does it, or by rank
    with ``alphabetical=False``; both orders agree on the three severities.
    """
    sev = F.col("severity") if alphabetical else dims.severity_rank(F.col("severity"))
    page_rows = ranked(
        pages, ["audit_id"], [id_bucket(F.col("page_seq"))], [F.col("page_seq")], "position"
    ).select(
        "audit_id",
        F.lit("page").alias("child"),
        "position",
        F.col("page_id").alias("child_id"),
        F.col("url").alias("label"),
    )
    issue_rows = ranked(
        issues,
        ["audit_id"],
        [sev, id_bucket(F.col("issue_id"))],
        [sev, F.col("issue_id")],
        "position",
    ).select(
        "audit_id",
        F.lit("issue").alias("child"),
        "position",
        F.col("issue_id").alias("child_id"),
        F.col("title").alias("label"),
    )
    return page_rows.unionByName(issue_rows)


def report_summary(audits: DataFrame, severity: DataFrame) -> DataFrame:
    """Grade, verdict, category scores and totals of each audit.

    ``audits`` has ``category_scores`` as ``map<string,int>``; a category it lacks
    reads as 100. ``severity`` is ``severity_counts`` keyed by ``audit_id``.
    """
    grade = dims.report_grade(F.col("overall_score"))
    df = audits.join(severity, "audit_id", "left")
    zero = F.lit(0).cast("long")
    return df.select(
        "audit_id",
        "url",
        "domain",
        "overall_score",
        grade.alias("overall_grade"),
        dims.verdict(grade, 0).alias("verdict_title"),
        dims.verdict(grade, 1).alias("verdict_text"),
        *[
            F.coalesce(F.try_element_at("category_scores", F.lit(cat)), F.lit(100)).alias(
                f"{cat}_score"
            )
            for cat in dims.CATEGORIES
        ],
        *[
            F.coalesce(f"{s}_count", zero).alias(f"{s}_count") for s in dims.SEVERITIES
        ],
        F.coalesce("total_unique", zero).alias("total_unique"),
        "pages_crawled",
    )


def compact_summary(audits: DataFrame, issues: DataFrame, k: int = 8) -> DataFrame:
    """Scores, totals and the first ``k`` serious findings of each audit."""
    serious = issues.where(is_serious(F.col("severity")))
    top = (
        first_rows(serious, ["audit_id"], [F.col("issue_id")], k)
        .groupBy("audit_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "title", "severity", "category"))).alias("p"))
        .select(
            "audit_id",
            F.transform("p", lambda p: F.struct(p["title"].alias("title"), p["severity"].alias("severity"), p["category"].alias("category"))).alias("top_problems"),
        )
    )
    empty = F.array().cast("array<struct<title:string,severity:string,category:string>>")
    return audits.join(top, "audit_id", "left").withColumn(
        "top_problems", F.coalesce("top_problems", empty)
    )


def _rated(text: Column, rating: Column) -> Column:
    label = F.when(rating != "UNKNOWN", F.concat(F.lit(" · "), F.replace(rating, F.lit("_"), F.lit(" "))))
    return F.concat(text, F.coalesce(label, F.lit("")))


def technical_lines(
    field: DataFrame | None = None,
    lab: DataFrame | None = None,
    dns: DataFrame | None = None,
    markup: DataFrame | None = None,
    headers: DataFrame | None = None,
    authority: DataFrame | None = None,
    threats: DataFrame | None = None,
    crawl: DataFrame | None = None,
) -> DataFrame:
    """Technical report lines per site: ``(site_key, block, position, line)``.

    Each argument is the typed table of one check; every line is text as printed.
    ``threats`` needs a ``base_url`` column for the checked URL.
    """
    c, lit, dash = F.col, F.lit, F.lit("—")
    present = lambda flag: F.when(c(flag), "Present").otherwise("Missing")
    blocks: list[DataFrame] = []

    def add(table: DataFrame, title: str, start: int, lines: Column, show: Column | None = None) -> None:
        rows = table.withColumn("_lines", F.array_compact(lines))
        if show is not None:
            rows = rows.where(show)
        # Outer, as else Spark first filters by the size of the lines, which makes them twice,
        # and moves that filter down to the few tasks that scan a small table.
        lined = rows.select("site_key", F.posexplode_outer("_lines").alias("_p", "line")).where(c("line").isNotNull())
        blocks.append(
            lined.select("site_key", lit(title).alias("block"), (c("_p") + lit(start)).alias("position"), "line")
        )

    if authority is not None:
        ranked_line = F.when(c("available") & c("domain_rank").isNotNull(), F.format_string("Domain authority: %d/100", c("domain_rank")))
        add(authority, "Link Authority (Open PageRank)", 1, F.array(ranked_line, c("message")))
    if field is not None:
        seconds = F.coalesce(F.concat(to_fixed(F.nullif(c("lcp_p75"), lit(0.0)) / 1000, 1), lit("s")), dash)
        shift = F.coalesce(to_fixed(c("cls_p75"), 3), dash)
        delay = F.coalesce(F.concat(whole(F.nullif(c("inp_p75"), lit(0.0))), lit("ms")), dash)
        no_data = F.array(lit("No Chrome UX Report data yet — site needs more real-user traffic for field metrics."))
        lines = F.array(
            _rated(F.concat(lit("LCP (field): "), seconds), c("lcp_rating")),
            _rated(F.concat(lit("CLS (field): "), shift), c("cls_rating")),
            _rated(F.concat(lit("INP (field): "), delay), c("inp_rating")),
        )
        add(field, "Core Web Vitals & Lighthouse", 1, F.when(c("available"), lines).otherwise(no_data))
    if lab is not None:
        names = {"performance": "performance", "accessibility": "accessibility", "best practices": "best_practices", "SEO": "seo"}
        add(lab, "Core Web Vitals & Lighthouse", 4, F.array(*[
            F.format_string(f"Lighthouse {label}: %d/100", c(f"{name}_score")) for label, name in names.items()
        ]))
    if headers is not None:
        tests = F.transform(F.slice(c("failed_tests"), 1, 8), lambda t: F.concat(lit("• "), F.coalesce(F.nullif(t["score_description"], lit("")), F.replace(t["name"], lit("-"), lit(" ")))))
        source = F.when(c("source") == "local", "Source: local scan").otherwise("Source: MDN HTTP Observatory")
        full = F.concat(
            F.array(
                F.format_string("Security grade: %s (%d/100)", c("grade"), c("score")),
                F.format_string("%d passed · %d failed", c("tests_passed"), c("tests_failed")),
                source,
            ),
            tests,
            F.array(c("message")),
        )
        add(headers, "Security Headers", 1, F.when(c("available"), full).otherwise(F.array(c("message"))))
    if threats is not None:
        listed = F.coalesce(F.nullif(F.array_join("threats", ", "), lit("")), lit("threat detected"))
        found = F.when(F.size("threats") == 0, "None").otherwise(F.size("threats").cast("string"))
        full = F.array(
            F.when(c("safe"), "Not on Google's threat lists").otherwise(F.concat(lit("Flagged: "), listed)),
            F.concat(lit("URL checked: "), c("base_url")),
            F.concat(lit("Threat types found: "), found),
        )
        add(threats, "Google Safe Browsing", 1, F.when(c("available"), full).otherwise(F.array(c("message"))))
    if dns is not None:
        policy = F.coalesce(F.concat(lit(" (p="), c("dmarc_policy"), lit(")")), lit(""))
        add(dns, "Email & DNS", 1, F.array(
            F.concat(lit("SPF: "), present("has_spf")),
            F.concat(lit("DMARC: "), present("has_dmarc"), policy),
            F.concat(lit("MX: "), present("has_mx")),
            F.concat(lit("IPv6: "), present("has_ipv6")),
            F.format_string("Email auth score: %d/100", c("email_auth_score")),
        ))
    if markup is not None:
        top = F.transform(F.slice(c("top_issues"), 1, 8), lambda t: F.concat(
            F.when(t["line"] != 0, F.format_string("Line %d: ", t["line"])).otherwise(lit("")), t["message"]
        ))
        add(markup, "HTML Validation (W3C)", 1, F.concat(
            F.array(
                F.when(c("valid"), "Valid markup").otherwise(F.format_string("%d error(s)", c("error_count"))),
                F.format_string("%d warning(s)", c("warning_count")),
            ),
            top,
        ))
    if crawl is not None:
        add(crawl, "Crawl Performance", 1, F.array(
            F.format_string("Average load time: %dms", c("average_load_ms")),
            F.format_string("Slow pages: %d", c("slow_pages")),
        ))
    if not blocks:
        raise ValueError("no table given")
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


# Messages of failed audits that come from the network, and those
# that would show internals.
NETWORK_ERRORS = (
    r"(?i)fetch failed|ECONNREFUSED|ETIMEDOUT|ENOTFOUND|EAI_AGAIN|network|timeout|abort|"
    r"socket hang up|connection reset|no internet|failed to fetch|getaddrinfo"
)
TECHNICAL_ERRORS = (
    r"(?i:prisma|invocation)|\.next[/\\]|[A-Z]:\\[^ ]+|/(?:src|node_modules)/|"
    r"(?i:auditIssue|record.*not found|P2025|at async|stack trace)|\n"
)
MAX_SHOWN_ERROR = 160


def error_class(message: Column) -> Column:
    """``empty``, ``network``, ``technical`` or ``showable`` for a stored failure."""
    text = js_trim(message)
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(text.rlike(NETWORK_ERRORS), "network")
        .when(text.rlike(TECHNICAL_ERRORS) | (F.length(text) > MAX_SHOWN_ERROR), "technical")
        .otherwise("showable")
    )


def error_class_counts(audits: DataFrame) -> DataFrame:
    """Failed audits per error class."""
    return (
        audits.where(F.col("status") == "failed")
        .groupBy(error_class(F.col("error_message")).alias("error_class"))
        .agg(F.count(F.lit(1)).alias("audits"))
    )
