"""Rule engine: many predicates, one pass, no shuffle.

A rule list becomes one array of nullable structs that is exploded once. Users
extend an audit by appending their own ``Rule`` to a list.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rule_texts import RuleText

# Order of finding sources within one audit. The gaps leave room for sources whose
# findings follow each other rule by rule instead of page by page.
STAGE_PAGE, STAGE_SITE, STAGE_EXTERNAL, STAGE_LAB, STAGE_PROBE, STAGE_GRAPH = range(10, 70, 10)

ISSUE_COLUMNS = (
    "site_key", "page_id", "stage", "page_seq", "rule_seq", "issue_key", "category",
    "severity", "title", "description", "recommendation", "affected_url",
)


@dataclass(frozen=True)
class Rule:
    """A finding that is emitted for each row where ``when`` is true."""

    key: str
    when: Column
    severity: str | Column
    text: RuleText
    values: tuple[Column, ...] = ()
    title_values: tuple[Column, ...] = ()
    key_value: Column | None = None


def _filled(template: str, values: tuple[Column, ...]) -> Column:
    if values:
        return F.format_string(template, *[v.cast("string") for v in values])
    return F.lit(template)


def _finding(position: int, rule: Rule, url: Column) -> Column:
    key = F.lit(rule.key)
    if rule.key_value is not None:
        key = F.concat(key, rule.key_value.cast("string"))
    severity = F.lit(rule.severity) if isinstance(rule.severity, str) else rule.severity
    return F.when(
        rule.when,
        F.struct(
            F.lit(position).alias("rule_seq"),
            key.alias("issue_key"),
            F.lit(rule.text.category).alias("category"),
            severity.alias("severity"),
            _filled(rule.text.title, rule.title_values).alias("title"),
            _filled(rule.text.description, rule.values).alias("description"),
            F.lit(rule.text.recommendation).alias("recommendation"),
            url.alias("affected_url"),
        ),
    )


def apply_rules(
    df: DataFrame, rules: Iterable[Rule], stage: int, url: Column, first_seq: int = 1
) -> DataFrame:
    """Findings of all rules in ``ISSUE_COLUMNS`` form.

    ``df`` needs ``site_key``; ``page_id`` and ``page_seq`` are taken when present.
    """
    found = F.array_compact(
        F.array(*[_finding(i, r, url) for i, r in enumerate(rules, start=first_seq)])
    )
    page_id = F.col("page_id") if "page_id" in df.columns else F.lit(None).cast("long")
    page_seq = F.col("page_seq") if "page_seq" in df.columns else F.lit(0).cast("long")
    return df.select(
        "site_key",
        page_id.alias("page_id"),
        F.lit(stage).alias("stage"),
        page_seq.alias("page_seq"),
        F.inline(found),
    ).select(*ISSUE_COLUMNS)


def union_issues(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All findings of all stages; duplicates stay."""
    out = first
    for df in others:
        out = out.unionByName(df)
    return out
