"""Replace one slice of an audit, or an audit as a whole, without re-reading pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..session import by_key
from .grouping import group_issues, severity_counts
from .scoring import category_scores


def matches_integration(integration: str) -> Column:
    """Whether a finding came from an integration: by key prefix, else by title."""
    key, title = F.col("issue_key"), F.lower(F.col("title"))
    by_key, by_title = F.lit(False), F.lit(False)
    for prefix in dims.INTEGRATION_PREFIXES[integration]:
        by_key = by_key | F.startswith(key, F.lit(prefix))
    for hint in dims.INTEGRATION_TITLE_HINTS[integration]:
        by_title = by_title | F.contains(title, F.lit(hint.lower()))
    has_key = F.coalesce(key, F.lit("")) != ""
    return F.coalesce(F.when(has_key, by_key).otherwise(by_title), F.lit(False))


def replace_slice(
    issues: DataFrame, integration: str, new_issues: DataFrame, within: Column | None = None
) -> DataFrame:
    """Findings without the integration's old ones, plus its new ones.

    ``within`` says which findings may be replaced; all unless given.
    """
    old = matches_integration(integration)
    if within is not None:
        old = old & F.coalesce(within, F.lit(False))
    return issues.where(~old).unionByName(new_issues, allowMissingColumns=True)


def sync_headers(facts: DataFrame, headers: DataFrame) -> DataFrame:
    """Write a local header result back onto the stored home page facts.

    Only results graded from the crawl's own headers are written back; HTTPS is
    then taken from the first crawled page.
    """
    names = {
        "hsts": "strict-transport-security",
        "csp": "content-security-policy",
        "x_content_type": "x-content-type-options",
        "x_frame_options": "x-frame-options",
        "referrer_policy": "referrer-policy",
        "permissions_policy": "permissions-policy",
    }
    new = headers.select(
        "site_key",
        (F.col("available") & (F.col("source") == "local")).alias("_local"),
        F.transform("failed_tests", lambda t: t["name"]).alias("_failed"),
    )
    joined = facts.join(new, "site_key", "left")
    local = F.coalesce("_local", F.lit(False))
    passed = {
        f"home_{flag}": F.when(local, ~F.array_contains("_failed", test)).otherwise(
            F.col(f"home_{flag}")
        )
        for flag, test in names.items()
    }
    https = F.when(local, F.col("first_https")).otherwise(F.col("home_is_https"))
    return joined.withColumns({**passed, "home_is_https": https}).drop("_local", "_failed")


def set_external(facts: DataFrame, name: str, table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Replace the stored payload columns of one check with a new payload's."""
    old = [f"{name}_{c}" for c in columns]
    new = table.select("site_key", *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return facts.drop(*old).join(new, "site_key", "left")


def refresh_integration(
    issues: DataFrame,
    facts: DataFrame | None,
    integration: str,
    new_issues: DataFrame,
    sites: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Findings after the refresh, and one summary row per site as ``refreshed_summary`` makes it.

    ``facts`` holds the refreshed payload columns.
    """
    kept = replace_slice(issues, integration, new_issues)
    return kept, refreshed_summary(kept, facts, sites)


def refreshed_summary(
    kept: DataFrame, facts: DataFrame | None, sites: DataFrame | None = None
) -> DataFrame:
    """Raw finding count, number of groups per severity and new scores of each site.

    Without ``facts`` there are no scores, and ``sites`` (``site_key``) says which sites to
    sum up.
    """
    keyed = kept.withColumn("issue_key", F.coalesce("issue_key", "title"))
    counts = severity_counts(group_issues(keyed))
    totals = kept.groupBy("site_key").agg(F.count(F.lit(1)).alias("total_issues"))
    zero = F.lit(0).cast("long")
    scored = sites if facts is None else category_scores(facts)
    summary = scored.join(by_key(totals), "site_key", "left").join(by_key(counts), "site_key", "left")
    filled = {c: F.coalesce(c, zero) for c in ("total_issues", *[f"{s}_count" for s in dims.SEVERITIES])}
    return summary.withColumns(filled).drop("total_unique")


def delete_audits(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given audits and their children.

    ``ids`` is ``(audit_id)``. The caller writes the results to new partitions.
    """
    gone = ids.select("audit_id").distinct()
    return {name: df.join(gone, "audit_id", "left_anti") for name, df in tables.items()}


# Audit summary columns and what a reset sets them to.
RESET_VALUES = {
    "status": "running",
    "overall_score": 0,
    "pages_crawled": 0,
    "total_issues": 0,
    "critical_count": 0,
    "warning_count": 0,
    "notice_count": 0,
    "error_message": None,
    "completed_at": None,
}


def reset_audits(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Children of the given audits removed and their summary fields blanked.

    ``tables`` has the audits under ``audits``; every other table is a child.
    """
    gone = ids.select("audit_id").distinct()
    audits = tables["audits"].join(gone.withColumn("_reset", F.lit(True)), "audit_id", "left")
    types = dict(tables["audits"].dtypes)
    blank = {
        c: F.when(F.col("_reset"), F.lit(v).cast(types[c])).otherwise(F.col(c))
        for c, v in RESET_VALUES.items()
        if c in types
    }
    children = {n: df for n, df in tables.items() if n != "audits"}
    return {"audits": audits.withColumns(blank).drop("_reset"), **delete_audits(children, gone)}
