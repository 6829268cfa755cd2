"""Findings from lab runs and from outside checks, one row per site in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import squash_ws, strip_markdown, to_fixed
from ..session import by_key
from . import rule_texts as T
from .rules import ISSUE_COLUMNS, STAGE_EXTERNAL, STAGE_LAB, Rule, apply_rules

# Rule positions of each source inside the external stage, in report order.
_FIELD, _HEADERS, _THREATS, _DNS, _MARKUP, _AUTHORITY = 0, 100, 200, 300, 400, 500


def _either(test: Column, yes: str, no: str) -> Column:
    return F.when(test, yes).otherwise(no)


def _rule(key: str, when: Column, severity, *values: Column, **more) -> Rule:
    text = T.EXTERNAL_TEXTS.get(key) or T.LAB_TEXTS[key]
    return Rule(key, when, severity, text, values, **more)


def whole(c: Column) -> Column:
    """A number as JavaScript prints it: no decimals when there are none."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def lab_rules() -> list[Rule]:
    c = F.col
    perf, lcp, cls, inp = c("performance_score"), c("lcp_ms"), c("cls"), c("inp_ms")
    low = lambda col: (col > 0) & (col < 90)
    grade = lambda col: _either(col < 70, "warning", "notice")
    a11y, best, seo = c("accessibility_score"), c("best_practices_score"), c("seo_score")
    return [
        _rule("pagespeed-poor", perf < 50, "critical", perf),
        _rule("pagespeed-improve", (perf >= 50) & (perf < 90), "warning", perf),
        _rule("cwv-lcp", lcp > 2500, _either(lcp > 4000, "critical", "warning"), to_fixed(lcp / 1000, 1)),
        _rule("cwv-cls", cls > 0.1, _either(cls > 0.25, "critical", "warning"), to_fixed(cls, 3)),
        _rule("cwv-inp", inp > 200, _either(inp > 500, "warning", "notice"), inp),
        _rule("lh-a11y", low(a11y), grade(a11y), a11y),
        _rule("lh-best-practices", low(best), grade(best), best),
        _rule("lh-seo", low(seo), grade(seo), seo),
    ]


def lab_issues(runs: DataFrame, audits: DataFrame, sites: DataFrame) -> DataFrame:
    """Lab findings: metrics of the preferred run, then the worst audits.

    ``runs`` is ``prefer_strategy``, ``audits`` is ``worst_lab_audits`` and
    ``sites`` is ``(site_key, base_url)``.
    """
    rules = lab_rules()
    sites = by_key(sites)
    metric = apply_rules(runs.join(sites, "site_key"), rules, STAGE_LAB, F.col("base_url"))
    text = strip_markdown(F.col("description"))
    current = F.concat(
        F.substring(text, 1, 260), F.lit(" (Current: "), F.col("display_value"), F.lit(")")
    )
    severity = (
        F.when((F.col("score") == 0) & F.col("audit_id").isin(*dims.LAB_HIGH_IMPACT), "critical")
        .when(F.col("score") < 0.5, "warning")
        .otherwise("notice")
    )
    audit = audits.join(sites, "site_key").select(
        "site_key",
        F.lit(None).cast("long").alias("page_id"),
        F.lit(STAGE_LAB).alias("stage"),
        F.lit(0).cast("long").alias("page_seq"),
        (F.lit(len(rules)) + F.col("rank")).alias("rule_seq"),
        F.concat(F.lit("lh-"), F.col("audit_id")).alias("issue_key"),
        F.coalesce("mapped_category", F.lit("performance")).alias("category"),
        severity.alias("severity"),
        squash_ws(strip_markdown(F.col("title"))).alias("title"),
        F.when(F.col("display_value") != "", current).otherwise(F.substring(text, 1, 300)).alias("description"),
        dims.lookup(F.col("audit_id"), dims.LAB_HINTS, T.LAB_DEFAULT_HINT).alias("recommendation"),
        F.col("base_url").alias("affected_url"),
    )
    return metric.unionByName(audit.select(*ISSUE_COLUMNS))


def field_rules() -> list[Rule]:
    c, ok = F.col, F.col("available")
    bad = ("POOR", "NEEDS_IMPROVEMENT")
    poor = lambda m: c(f"{m}_rating") == "POOR"
    words = F.lower(F.replace(c("cls_rating"), F.lit("_"), F.lit(" ")))
    seconds = to_fixed(F.coalesce(c("lcp_p75"), F.lit(0.0)) / 1000, 1)
    return [
        _rule("crux-no-data", ~ok, "notice"),
        _rule("crux-lcp-poor", ok & poor("lcp"), "critical", seconds),
        _rule(
            "crux-lcp-needs-improvement",
            ok & (c("lcp_rating") == "NEEDS_IMPROVEMENT"),
            "warning",
            seconds,
        ),
        _rule(
            "crux-cls",
            ok & c("cls_rating").isin(*bad),
            _either(poor("cls"), "critical", "warning"),
            to_fixed(c("cls_p75"), 3),
            words,
        ),
        _rule(
            "crux-inp",
            ok & c("inp_rating").isin(*bad),
            _either(poor("inp"), "warning", "notice"),
            whole(c("inp_p75")),
        ),
    ]


def header_rules() -> list[Rule]:
    ok = F.col("available")
    grade_score = dims.header_grade_to_score(F.col("grade"))
    rules = [
        _rule(
            "observatory-unavailable",
            ~ok,
            "notice",
            F.coalesce("message", F.lit(T.SCAN_MESSAGE)),
        ),
        _rule(
            "observatory-grade-low",
            ok & (grade_score < 70),
            _either(grade_score < 50, "warning", "notice"),
            F.col("score"),
            F.col("tests_failed"),
            title_values=(F.col("grade"),),
        ),
    ]
    for i in range(1, 5):
        test = F.try_element_at(F.col("failed_tests"), F.lit(i))
        name = test["name"]
        text = F.nullif(test["score_description"], F.lit(""))
        rules.append(
            _rule(
                "observatory-",
                ok & test.isNotNull(),
                "notice",
                F.coalesce(text, F.concat(F.lit("Failed Observatory check: "), name, F.lit("."))),
                title_values=(F.replace(name, F.lit("-"), F.lit(" ")),),
                key_value=name,
            )
        )
    return rules


def threat_rules() -> list[Rule]:
    ok = F.col("available")
    listed = F.coalesce(F.nullif(F.array_join("threats", ", "), F.lit("")), F.lit("unknown"))
    return [
        _rule("safe-browsing-unavailable", ~ok, "notice", F.coalesce("message", F.lit(T.THREAT_MESSAGE))),
        _rule("safe-browsing-threat", ok & ~F.col("safe"), "critical", listed),
    ]


def dns_rules() -> list[Rule]:
    c = F.col
    return [
        _rule("dns-no-spf", ~c("has_spf"), "notice", c("site_key")),
        _rule("dns-no-dmarc", ~c("has_dmarc"), "notice", c("site_key")),
        _rule("dns-dmarc-none", c("has_dmarc") & (c("dmarc_policy") == "none"), "notice"),
        _rule("dns-no-mx", ~c("has_mx"), "notice", c("site_key")),
        _rule("dns-no-ipv6", ~c("has_ipv6"), "notice"),
    ]


def markup_rules() -> list[Rule]:
    errors, warnings = F.col("error_count"), F.col("warning_count")
    top = F.try_element_at(F.col("top_issues"), F.lit(1))["message"]
    return [
        _rule(
            "w3c-html-errors",
            (errors > 0) | (warnings > 0),
            _either(errors > 5, "warning", "notice"),
            errors,
            warnings,
            F.coalesce(top, F.lit(T.HTML_MESSAGE)),
            title_values=(_either(errors > 0, T.HTML_ERRORS_TITLE, T.HTML_WARNINGS_TITLE),),
        )
    ]


def authority_rules() -> list[Rule]:
    ok, rank = F.col("available"), F.col("domain_rank")
    return [
        _rule("backlinks-not-configured", ~ok, "notice", F.coalesce("message", F.lit(T.AUTHORITY_MESSAGE))),
        _rule("weak-link-profile", ok & (rank < 15), "critical", rank),
        _rule("low-domain-authority", ok & (rank >= 15) & (rank < 35), "warning", rank),
    ]


# Payload name -> (rules, position). A new check is one more entry here.
EXTERNAL_CHECKS = {
    "field": (field_rules, _FIELD),
    "headers": (header_rules, _HEADERS),
    "threats": (threat_rules, _THREATS),
    "dns": (dns_rules, _DNS),
    "markup": (markup_rules, _MARKUP),
    "authority": (authority_rules, _AUTHORITY),
}


def external_issues(sites: DataFrame, **payloads: DataFrame | None) -> DataFrame:
    """Findings of every payload given; a site without a payload row has none.

    Payload names are the keys of ``EXTERNAL_CHECKS``; ``sites`` is
    ``(site_key, base_url)``.
    """
    out = None
    for name, (rules, position) in EXTERNAL_CHECKS.items():
        table = payloads.get(name)
        if table is None:
            continue
        found = apply_rules(
            table.join(by_key(sites), "site_key"), rules(), STAGE_EXTERNAL, F.col("base_url"), position + 1
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no payload given")
    return out
