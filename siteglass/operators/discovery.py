"""Which pages of a site to audit: sitemap discovery and crawl order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim
from ..functions.urls import is_crawlable, origin, path_depth, raw_path, site_key
from ..session import saved
from .grouping import first_rows
from .ranking import id_bucket, ranked

# Limits of a live crawl. They save HTTP calls, so the functions
# below apply them only when asked to.
CRAWL_PAGES = 15
CRAWL_CAPS = {"per_sitemap": 45, "children": 8, "enough": 30}
INDEX_DEPTH = 2


def sitemap_roots(robots: DataFrame, sites: DataFrame) -> DataFrame:
    """Sitemaps named in robots.txt, then the default one unless already named."""
    lines = F.transform(
        F.regexp_extract_all("robots_txt", F.lit(r"(?im)^Sitemap:\s*(.+)$"), 1), js_trim
    )
    default = F.concat(origin(F.col("base_url")), F.lit("/sitemap.xml"))
    named = F.coalesce(lines, F.array().cast("array<string>"))
    all_roots = F.when(F.array_contains(named, default), named).otherwise(
        F.concat(named, F.array(default))
    )
    joined = sites.join(robots, "site_key", "left")
    return joined.select("site_key", "base_url", F.posexplode(all_roots).alias("root", "sitemap_url"))


def _locations(docs: DataFrame) -> DataFrame:
    """Entries of every sitemap: pages of URL sets, further sitemaps of indexes."""
    locs = F.regexp_extract_all("body", F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), 1)
    entries = docs.select(
        "site_key",
        "sitemap_url",
        F.col("body").rlike("(?i)<sitemapindex").alias("is_index"),
        F.posexplode(locs).alias("pos", "loc"),
    )
    return entries.where(~F.col("is_index") | F.col("loc").rlike(r"(?i)\.xml|sitemap"))


def _visits(roots: DataFrame, nested: DataFrame, max_depth: int | None, once: bool) -> list[DataFrame]:
    """Sitemaps to read, level by level, with the positions ``path`` that lead to them.

    Each level is stored and leads to the next. With ``once`` a sitemap that its root already
    reaches at an earlier place is not read again: all it lists is there, and earlier.
    """
    place = ["site_key", "base_url", "root", "sitemap_url"]
    level = saved(roots.select(*place, F.array().cast("array<int>").alias("path")), "sitemaps")
    met = [level]
    while (max_depth is None or len(met) <= max_depth) and not level.isEmpty():
        inner = level.join(nested, ["site_key", "sitemap_url"]).select(
            "site_key", "base_url", "root", F.col("loc").alias("sitemap_url"),
            F.concat("path", F.array("pos")).alias("path"),
        )
        if once:
            inner = inner.groupBy(*place).agg(F.min("path").alias("path"))
            seen = reduce(DataFrame.union, met).groupBy(*place).agg(F.min("path").alias("seen"))
            later = F.coalesce(F.col("path") >= F.col("seen"), F.lit(False))
            inner = inner.join(seen, place, "left").where(~later).drop("seen")
        level = saved(inner, "sitemaps")
        met.append(level)
    return met


def sitemap_urls(
    roots: DataFrame,
    docs: DataFrame,
    per_sitemap: int | None = None,
    children: int | None = None,
    max_depth: int | None = INDEX_DEPTH,
) -> DataFrame:
    """Crawlable page URLs of all sitemaps, following indexes ``max_depth`` levels down.

    The order is depth-first: root, position in each index (``p0`` on), entry. Every document
    is parsed once. Without ``max_depth`` all levels are followed; indexes that list each other
    come to an end, as no sitemap is read again at a later place. ``per_sitemap`` counts pages
    of a sitemap listed twice twice, so repeats stay then, and a depth is needed.
    """
    if per_sitemap is not None and max_depth is None:
        raise ValueError("per_sitemap needs a max_depth")
    locs = saved(_locations(docs), "locations")
    nested = locs.where("is_index")
    if children is not None:
        nested = first_rows(nested, ["site_key", "sitemap_url"], [F.col("pos")], children).drop("rank")
    met = _visits(roots, nested, max_depth, once=per_sitemap is None)
    path = [f"p{i}" for i in range(len(met) - 1 if max_depth is None else max_depth)]
    steps = [F.coalesce(F.get("path", F.lit(i)), F.lit(0)).alias(p) for i, p in enumerate(path)]
    visits = reduce(DataFrame.union, met).select("site_key", "base_url", "root", "sitemap_url", *steps)
    entries = visits.join(locs.where("not is_index"), ["site_key", "sitemap_url"])
    pages = entries.where(is_crawlable(F.col("loc"), F.col("base_url"))).select(
        "site_key", "base_url", "root", *path, "pos", F.col("loc").alias("url")
    )
    if per_sitemap is not None:
        order = [F.col(c) for c in (*path, "pos")]
        pages = first_rows(pages, ["site_key", "root"], order, per_sitemap).drop("rank")
    return pages


def discover_urls(
    robots: DataFrame,
    docs: DataFrame,
    sites: DataFrame,
    per_sitemap: int | None = None,
    children: int | None = None,
    enough: int | None = None,
    max_depth: int | None = INDEX_DEPTH,
) -> DataFrame:
    """Candidate pages ``(site_key, base_url, url, pos)`` of each site, once each.

    ``pos`` is a struct that sorts like the crawl: root, position in each index, entry.

    The base URL and the root page come first, then sitemap pages. With
    ``enough`` set, sitemaps after the one that reaches it are not read.
    """
    found = sitemap_urls(sitemap_roots(robots, sites), docs, per_sitemap, children, max_depth)
    path = [c for c in found.columns if c not in ("site_key", "base_url", "root", "pos", "url")]

    def placed(df: DataFrame) -> DataFrame:
        position = F.struct(*[F.col(c).cast("long").alias(c) for c in ("root", *path, "pos")])
        return df.select("site_key", "base_url", "url", position.alias("pos"))

    own = sites.select(
        "site_key",
        "base_url",
        F.posexplode(
            F.array("base_url", F.concat(origin(F.col("base_url")), F.lit("/")))
        ).alias("pos", "url"),
    ).withColumns({c: F.lit(-1) for c in ("root", *path)})
    distinct = (
        placed(own)
        .unionByName(placed(found))
        .groupBy("site_key", "base_url", "url")
        .agg(F.min("pos").alias("pos"))
        .withColumn("root", F.col("pos.root"))
    )
    if enough is None:
        return distinct.drop("root")
    # Few rows per site: one per sitemap named in robots.txt.
    before = Window.partitionBy("site_key").orderBy("root").rowsBetween(
        Window.unboundedPreceding, -1
    )
    per_root = (
        distinct.groupBy("site_key", "root")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where((F.col("root") < 0) | (F.col("before") < enough))
        .select("site_key", "root")
    )
    return distinct.join(per_root, ["site_key", "root"], "left_semi").drop("root")


def sitemap_found(robots: DataFrame, docs: DataFrame, sites: DataFrame) -> DataFrame:
    """Whether any sitemap of a site lists a crawlable page."""
    found = sitemap_urls(sitemap_roots(robots, sites), docs).select("site_key").distinct()
    return sites.select("site_key").join(
        found.withColumn("sitemap_found", F.lit(True)), "site_key", "left"
    ).select("site_key", F.coalesce("sitemap_found", F.lit(False)).alias("sitemap_found"))


def distinct_keep_order(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Each key once, at its first position."""
    return df.groupBy(*keys).agg(F.min(pos).alias(pos))


def _crawl_order() -> list[Column]:
    return [F.col("exact"), F.col("depth"), F.col("path_length")]


def _with_order(candidates: DataFrame) -> DataFrame:
    path = raw_path(F.col("url"))
    return candidates.withColumns(
        {
            "exact": F.when(site_key(F.col("url")) == F.col("site_key"), 0).otherwise(1),
            "depth": path_depth(F.col("url")),
            "path_length": F.length(path),
        }
    )


def crawl_rank(candidates: DataFrame) -> DataFrame:
    """Crawl order of every candidate: own host, depth, path length, position.

    The rank is the audit's ``page_seq``. ``candidates`` holds each URL of a site
    once, with its position ``pos`` as ``discover_urls`` gives it.
    """
    df = _with_order(candidates)
    *sitemap, entry = [F.col(f"pos.{c}") for c in df.select("pos.*").columns]
    buckets = [*_crawl_order(), *sitemap, id_bucket(entry)]
    return ranked(df, ["site_key"], buckets, [*_crawl_order(), F.col("pos")], "page_seq")


def cap_pages(candidates: DataFrame, k: int = CRAWL_PAGES) -> DataFrame:
    """The first ``k`` candidates of each site in crawl order."""
    order = [*_crawl_order(), F.col("pos")]
    top = first_rows(_with_order(candidates), ["site_key"], order, k)
    return top.withColumnRenamed("rank", "page_seq")
