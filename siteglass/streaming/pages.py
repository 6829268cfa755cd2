"""Audits over pages as they arrive.

Page findings are stateless. For site findings a stream of signals, written once per page,
feeds three streams whose state Spark keeps and merges: partial facts per site (sums, counts,
values at the smallest order number), equal texts per site, and links per URL. A batch reads
its own pages only and updates the rows of the sites, texts and URLs it touches; late pages
merge like any others. Findings are read off the latest rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalize_page_url
from ..operators.links import orphan_issues, orphans_among
from ..operators.rules import union_issues
from ..operators.rules_page import page_issues
from ..operators.signals import extract_signals, looks_like_html
from ..operators.sites import crawl_site_issues, duplicate_issues, duplicate_values, site_facts
from .runs import latest, run_append, run_updates, work_folder


def signal_stream(pages: DataFrame) -> DataFrame:
    """Signals of each new page (output mode ``append``)."""
    return extract_signals(pages.where(looks_like_html(F.col("html"))))


def page_issue_stream(pages: DataFrame) -> DataFrame:
    """Findings of each new page (output mode ``append``)."""
    return page_issues(signal_stream(pages))


def run_page_issues(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return run_append(page_issue_stream(pages), work_folder(spark, "pages"))


def facts_stream(signals: DataFrame) -> DataFrame:
    """``site_facts`` of the sites of each batch over all their pages so far (``update``)."""
    return site_facts(signals)


def duplicate_stream(signals: DataFrame, column: str) -> DataFrame:
    """Texts of each batch that several pages of a site have so far (``update``)."""
    return duplicate_values(signals, column)


def link_state_stream(signals: DataFrame) -> DataFrame:
    """URLs that a batch shows as a page or as a link's target, with all known so far (``update``).

    ``(site_key, norm_url, page_id, url, page_seq, inbound)``; the last page crawled under a
    URL wins, and links of a page to itself don't count.
    """
    own = normalize_page_url(F.col("url"))
    seq, number = F.col("page_seq"), F.col("page_id")
    page = F.struct(
        own.alias("norm_url"), number.alias("page_id"), F.col("url").alias("url"),
        seq.alias("page_seq"), F.lit(0).cast("long").alias("n"),
    )
    none = {"page_id": number, "url": F.col("url"), "page_seq": seq}
    nulls = [F.lit(None).cast(signals.schema[name].dataType).alias(name) for name in none]
    targets = F.filter("internal_link_targets", lambda t: t != F.col("_own"))
    links = F.transform(targets, lambda t: F.struct(t.alias("norm_url"), *nulls, F.lit(1).cast("long").alias("n")))
    rows = signals.withColumn("_own", own).select(
        "site_key", F.inline(F.concat(F.array(page), F.coalesce(links, F.array())))
    )
    return rows.groupBy("site_key", "norm_url").agg(
        F.max_by("page_id", "page_seq").alias("page_id"),
        F.max_by("url", "page_seq").alias("url"),
        F.max("page_seq").alias("page_seq"),
        F.sum("n").alias("inbound"),
    )


def site_issues_of(facts: DataFrame) -> DataFrame:
    """Site findings of facts alone: robots and sitemaps were not looked at."""
    return crawl_site_issues(facts)


class SiteState:
    """Latest rows of a drained page stream, and the findings that follow from them."""

    def __init__(self, spark: SparkSession, pages: DataFrame, files_per_batch: int | None = None):
        signals = signal_stream(pages)
        stored = run_append(signals, work_folder(spark, "signals"))
        self.batches: dict[str, DataFrame] = {}

        def drained(name: str, keys: list[str], make) -> DataFrame:
            reader = spark.readStream.schema(signals.schema)
            if files_per_batch:
                reader = reader.option("maxFilesPerTrigger", files_per_batch)
            folder = work_folder(spark, name)
            updates = run_updates(make(reader.parquet(stored.stored_in)), folder)
            self.batches[name] = updates
            return latest(updates, keys)

        self.facts = drained("facts", ["site_key"], facts_stream)
        self.titles = drained("titles", ["site_key", "value"], lambda s: duplicate_stream(s, "title"))
        self.metas = drained("metas", ["site_key", "value"], lambda s: duplicate_stream(s, "meta_description"))
        self.links = drained("links", ["site_key", "norm_url"], link_state_stream)

    def orphans(self) -> DataFrame:
        crawled = self.links.where(F.col("page_seq").isNotNull() & (F.col("inbound") == 0)).drop("inbound")
        return orphans_among(crawled, self.facts.select("site_key", "base_url", "n_pages"))

    def issues(self) -> DataFrame:
        return union_issues(
            duplicate_issues(self.titles, "dup-titles"),
            duplicate_issues(self.metas, "dup-metas"),
            site_issues_of(self.facts),
            orphan_issues(self.orphans()),
        )


def run_site_issues(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Drain a page stream and return the findings of the facts of its sites."""
    signals = run_append(signal_stream(pages), work_folder(spark, "signals"))
    stream = spark.readStream.schema(signals.schema).parquet(signals.stored_in)
    updates = run_updates(facts_stream(stream), work_folder(spark, "facts"))
    return site_issues_of(latest(updates, ["site_key"]))
