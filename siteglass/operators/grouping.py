"""Group findings, with and without the list of pages they affect.

Every aggregate first shrinks to one row per (group, URL) before it meets the
group key, so a finding that a third of all pages share is summed in parallel.
URL lists stay in long form, ordered by ``first_seen``; only the first few URLs
of a group are ever put into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import js_trim

_SEQ = ("stage", "page_seq", "rule_seq")


def seen_order(*cols: str) -> Column:
    return F.struct(*(cols or _SEQ))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key.

    A ranking filter this simple is cut down before the shuffle by Spark's window
    group limit, so no task ever holds more than ``k`` rows per key and partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _per_url(issues: DataFrame, keys: list[str], url: Column, texts: list[str], extra=()) -> DataFrame:
    order = seen_order()
    return issues.groupBy(*keys, url.alias("affected_url")).agg(
        F.count(F.lit(1)).alias("count"),
        F.min(order).alias("first_seen"),
        F.min(dims.severity_rank(F.col("severity"))).alias("rank"),
        F.min_by(F.struct(*texts), order).alias("texts"),
        *extra,
    )


def issue_group_urls(issues: DataFrame) -> DataFrame:
    """One row per (site, issue key, affected URL), in first-seen order."""
    return issues.groupBy("site_key", "issue_key", "affected_url").agg(
        F.count(F.lit(1)).alias("count"), F.min(seen_order()).alias("first_seen")
    )


def group_issues(issues: DataFrame) -> DataFrame:
    """Findings by (site, issue key).

    Worst severity, first-seen texts, raw count, and the number of distinct URLs;
    ``issue_group_urls`` lists the URLs themselves.
    """
    texts = ["category", "title", "description", "recommendation", "affected_url"]
    per_url = _per_url(issues, ["site_key", "issue_key"], F.col("affected_url"), texts)
    return (
        per_url.groupBy("site_key", "issue_key")
        .agg(
            F.min("rank").alias("rank"),
            F.min_by("texts", "first_seen").alias("t"),
            F.min("first_seen").alias("first_seen"),
            F.sum("count").alias("count"),
            F.count(F.lit(1)).alias("url_count"),
        )
        .select(
            "site_key",
            "issue_key",
            F.col("t.category").alias("category"),
            dims.severity_name(F.col("rank")).alias("severity"),
            F.col("t.title").alias("title"),
            F.col("t.description").alias("description"),
            F.col("t.recommendation").alias("recommendation"),
            F.col("t.affected_url").alias("first_url"),
            "url_count",
            "count",
            "first_seen",
        )
    )


def group_report_issues(issues: DataFrame) -> DataFrame:
    """Findings by (site, category, title) as a report shows them.

    Older category names are mapped, empty URLs are not counted, and the first
    generated recommendation that exists is kept.
    """
    title = F.lower(js_trim(F.col("title")))
    reco = (
        F.col("ai_recommendation")
        if "ai_recommendation" in issues.columns
        else F.lit(None).cast("string")
    )
    reco = F.nullif(reco, F.lit(""))
    df = issues.withColumns(
        {
            "report_category": dims.normalize_category(F.col("category")),
            "title_key": title,
            "_reco": reco,
        }
    )
    keys = ["site_key", "report_category", "title_key"]
    url = F.coalesce(F.col("affected_url"), F.lit(""))
    order = seen_order()
    reco_order = F.when(F.col("_reco").isNotNull(), order)
    per_url = _per_url(
        df,
        keys,
        url,
        ["title", "description", "recommendation"],
        extra=(
            F.min_by("_reco", reco_order).alias("reco"),
            F.min(reco_order).alias("reco_seen"),
        ),
    )
    return (
        per_url.groupBy(*keys)
        .agg(
            F.min("rank").alias("rank"),
            F.min_by("texts", "first_seen").alias("t"),
            F.min_by("reco", "reco_seen").alias("ai_recommendation"),
            F.min("first_seen").alias("first_seen"),
            F.sum("count").alias("count"),
            F.count_if(F.col("affected_url") != "").alias("url_count"),
        )
        .select(
            "site_key",
            F.col("report_category").alias("category"),
            "title_key",
            dims.severity_name(F.col("rank")).alias("severity"),
            F.col("t.title").alias("title"),
            F.col("t.description").alias("description"),
            F.col("t.recommendation").alias("recommendation"),
            "ai_recommendation",
            "url_count",
            "count",
            "first_seen",
        )
    )


def order_groups(groups: DataFrame) -> DataFrame:
    """Severity, then most affected URLs, then first seen; site by site."""
    return groups.orderBy(
        "site_key",
        dims.severity_rank(F.col("severity")),
        F.col("url_count").desc(),
        "first_seen",
    )


def severity_counts(groups: DataFrame) -> DataFrame:
    """Groups, not raw findings, per severity and site."""
    return groups.groupBy("site_key").agg(
        *[
            F.count_if(F.col("severity") == s).alias(f"{s}_count")
            for s in dims.SEVERITIES
        ],
        F.count(F.lit(1)).alias("total_unique"),
    )


def category_counts(groups: DataFrame) -> DataFrame:
    """Groups per site and category; the category ``all`` counts every group."""
    return (
        groups.select("site_key", F.explode(F.array("category", F.lit("all"))).alias("category"))
        .groupBy("site_key", "category")
        .count()
        .withColumnRenamed("count", "groups")
    )


def visible_urls(urls: DataFrame, groups: DataFrame, k: int = 4) -> DataFrame:
    """First ``k`` URLs per group, and how many more there are."""
    keys = ["site_key", "issue_key"]
    shown = (
        first_rows(urls, keys, [F.col("first_seen"), F.col("affected_url")], k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "affected_url"))).alias("u"))
        .select(*keys, F.col("u.affected_url").alias("shown_urls"))
    )
    return groups.join(shown, keys, "left").select(
        *keys,
        F.coalesce("shown_urls", F.array().cast("array<string>")).alias("shown_urls"),
        F.greatest(F.col("url_count") - k, F.lit(0)).alias("more_urls"),
    )
