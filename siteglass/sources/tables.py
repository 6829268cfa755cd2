"""Readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import site_key
from ..operators.refresh import delete_audits, refreshed_summary, replace_slice
from ..operators.report import attach_page_id
from ..operators.signals import extract_signals, looks_like_html, with_fetch
from ..session import by_key, discard, saved
from . import schemas


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages ``(page_id, url, html)``."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_fetch_meta(spark: SparkSession, path: str) -> DataFrame:
    """Status, load time, headers and error of each fetch, where they were kept."""
    return spark.read.schema(schemas.FETCH_META).parquet(path)


def read_page_signals(spark: SparkSession, path: str, fetch_meta: str | None = None) -> DataFrame:
    """Signals of stored pages. HTML is read where it lies; only signals meet the fetch data."""
    pages = read_pages(spark, path)
    signals = extract_signals(pages.where(looks_like_html(F.col("html"))))
    return signals if fetch_meta is None else with_fetch(signals, read_fetch_meta(spark, fetch_meta))


def fetch_failures(pages: DataFrame, meta: DataFrame) -> DataFrame:
    """Failed fetches as ``(site_key, page_id, page_seq, url, error)``."""
    seq = F.col("page_seq") if "page_seq" in pages.columns else F.col("page_id")
    named = pages.select(site_key(F.col("url")).alias("site_key"), "page_id", seq.alias("page_seq"), "url")
    return named.join(meta.where(F.col("error").isNotNull()).select("page_id", "error"), "page_id")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")
    )


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """robots.txt files stored as ``<site_key>.txt``; an empty file reads as none."""
    name = F.regexp_extract("file", r"([^/]+)\.txt$", 1)
    return _texts(spark, path).select(
        F.url_decode(name).alias("site_key"), F.nullif("body", F.lit("")).alias("robots_txt")
    )


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Sitemap documents stored as ``site=<key>/<percent-encoded URL>.xml``."""
    site = F.url_decode(F.regexp_extract("file", "/site=([^/]+)/", 1))
    # The path in file metadata is itself encoded once more.
    url = F.url_decode(F.url_decode(F.regexp_extract("file", r"/([^/]+)\.xml$", 1)))
    return _texts(spark, path).select(site.alias("site_key"), url.alias("sitemap_url"), "body")


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines payload tables with one of the payload schemas."""
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Back-office tables in Parquet; unneeded columns are never read."""
    return spark.read.schema(schema).parquet(path)


def write_audit(audits: DataFrame, pages: DataFrame, issues: DataFrame, root: str, run: str = "first") -> None:
    """Write one run: pages, then findings with their page id, then the summaries.

    Tables are partitioned by ``run`` and ``audit_date`` so refresh and delete touch few files.
    A run replaces what an earlier attempt of the same run left.
    """
    if not re.fullmatch(r"[A-Za-z][\w-]*", run):
        raise ValueError("a run's name begins with a letter and has letters, digits, _ and - only")
    day = F.coalesce(F.to_date("created_at"), F.lit("1970-01-01").cast("date"))
    dates = audits.select("audit_id", day.alias("audit_date"))

    def save(df: DataFrame, name: str) -> None:
        dated = df.join(by_key(dates), "audit_id")
        dated.write.mode("overwrite").partitionBy("audit_date").parquet(f"{root}/{name}/run={run}")

    save(pages, "pages")
    save(attach_page_id(issues, pages), "issues")
    save(audits, "audits")


PARTITION = ["run", "audit_date"]


def _overwrite(rows: DataFrame, partitions: DataFrame, path: str) -> None:
    """Replace the given partitions by ``rows``, which must be stored elsewhere; others stay."""
    options = {"partitionOverwriteMode": "dynamic"}
    rows.write.mode("overwrite").options(**options).partitionBy(*PARTITION).parquet(path)
    # A partition that lost all its rows is not in what was written. One row per day and run.
    emptied = partitions.join(rows.select(*PARTITION).distinct(), PARTITION, "left_anti").collect()
    context = rows.sparkSession.sparkContext
    for part in emptied:
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/run={part['run']}/audit_date={part['audit_date']}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def refresh_audits(
    spark: SparkSession,
    root: str,
    integration: str,
    touched: DataFrame,
    new_issues: DataFrame,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Replace an integration's findings in the saved audits ``touched`` (``audit_id``).

    ``new_issues`` are its findings now, with ``audit_id``; audits without any lose the old ones.
    Only partitions with a touched audit are read and rewritten, and only touched audits are
    grouped and, with ``facts`` (by ``audit_id``, refreshed payloads included), scored again.
    Returns the new summary rows. An attempt that broke off may be repeated.
    """
    audits, issues, pages = (spark.read.parquet(f"{root}/{n}") for n in ("audits", "issues", "pages"))
    ids = touched.select("audit_id").distinct()
    place = saved(
        audits.join(by_key(ids), "audit_id", "left_semi").select("audit_id", *PARTITION), "touched"
    )
    # A row per day and run, stored, so that Spark knows it for the small table that it is.
    partitions = saved(place.select(*PARTITION).distinct(), "partitions")
    inside = lambda df: df.join(partitions, PARTITION, "left_semi")
    ids = by_key(place.select("audit_id").distinct())
    fresh = attach_page_id(new_issues.join(by_key(place), "audit_id"), inside(pages))
    marked = inside(issues).join(ids.withColumn("_touched", F.lit(True)), "audit_id", "left")
    mixed = replace_slice(marked, integration, fresh, F.col("_touched")).drop("_touched")
    untyped = {c: F.col(c).cast("string") for c, t in mixed.dtypes if t == "void"}
    rows = saved(mixed.withColumns(untyped), "refreshed")

    # Audits take the place of sites: a site may have several.
    own = F.col("audit_id").cast("string")
    keyed = lambda df: df.join(ids, "audit_id", "left_semi").withColumn("site_key", own)
    base = place.select(own.alias("site_key"))
    summary = refreshed_summary(keyed(rows), None if facts is None else keyed(facts), base)

    results = saved(summary, "summaries")
    replaced = [c for c in results.columns if c != "site_key" and c in audits.columns]
    named = results.select(F.col("site_key").alias("_audit"), F.struct(*replaced).alias("_new"))
    joined = inside(audits).join(by_key(named), own == F.col("_audit"), "left")
    values = {c: F.when(F.col("_audit").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in replaced}
    summaries = saved(joined.withColumns(values).select(audits.columns), "refreshed")

    _overwrite(rows.select(issues.columns), partitions, f"{root}/issues")
    _overwrite(summaries, partitions, f"{root}/audits")
    discard(place, partitions, rows, summaries)
    return results.withColumnRenamed("site_key", "audit_id")


def rewrite_without(
    spark: SparkSession, root: str, ids: DataFrame, target: str, names=("audits", "pages", "issues")
) -> None:
    """Copy saved tables without the given audits into ``target``."""
    tables = {n: spark.read.parquet(f"{root}/{n}") for n in names}
    for name, df in delete_audits(tables, ids).items():
        df.write.mode("overwrite").partitionBy(*PARTITION).parquet(f"{target}/{name}")
