"""Registered queries: one per operator, each over whole supplied tables.

Arrays are joined to text so that results compare by value.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import money
from ..functions import text as T
from ..functions import urls as U
from ..operators import (
    discovery,
    grouping,
    links,
    payloads,
    payments,
    recommend,
    refresh,
    report,
    rules_external,
    rules_page,
    scoring,
    sites,
    usage,
)
from ..operators.signals import extract_signals
from ..session import by_key, saved, spread_small, work_folder
from ..sources import tables
from ..sources.derived import crawl_pages, derived, supplied
from ..streaming import ledger, pages as page_stream
from .audit import home_headers, score_facts, site_total

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TODAY = "2024-01-20 00:00:00"
PAID_TODAY = "1998-01-01 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _join(c: str | Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _plain_pages(spark: SparkSession, d: str) -> DataFrame:
    return spread_small(supplied(spark, d, "pages"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return extract_signals(crawl_pages(spark, d))


def _signal_table(spark: SparkSession, d: str) -> DataFrame:
    """Signals for queries that read them more than once: extracted once, stored."""
    return saved(_signals(spark, d), "signals")


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return rules_page.page_issues(_signals(spark, d))


# --- functions ----------------------------------------------------------------


@query
def url_functions(spark, d):
    url = F.col("url")
    base = F.concat(U.origin(url), F.lit("/base/index.html"))
    primary, apex = U.host(url), F.regexp_replace(U.host(url), "^(www|blog)[.]", "")
    www = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("www."), apex)).when(
        F.col("page_id") % 3 == 1, apex
    )
    return supplied(spark, d, "pages").select(
        "page_id",
        U.format_url(F.regexp_replace(url, "^https?://", " ")).alias("formatted"),
        U.host(url).alias("host"),
        U.site_key(url).alias("site_key"),
        U.is_same_site(url, F.lit("https://example.com/")).alias("same_site"),
        U.same_site_host(url, F.concat(F.lit("https://www."), U.site_key(url))).alias("same_host"),
        U.resolve_href(F.lit("../a/./b c?x=ü#f"), url).alias("resolved"),
        U.normalize_internal_url(F.concat(url, F.lit("/")), url).alias("normalized"),
        U.url_path(url).alias("path"),
        U.is_homepage_path(url).alias("home_path"),
        U.is_homepage(F.concat(U.origin(url), F.lit("/?q=1")), url).alias("home"),
        U.is_crawlable(url, base).alias("crawlable"),
        U.path_depth(url).cast("long").alias("depth"),
        U.canonical_host(primary, apex, www).alias("canonical_host"),
        U.is_https(url).alias("https"),
    )


@query
def text_functions(spark, d):
    t = F.col("text")
    marked = F.concat(F.lit("  [Doc]("), F.col("source"), F.lit(") `"), t, F.lit("` * "))
    squashed = T.squash_ws(t)
    return supplied(spark, d, "documents").select(
        "doc_id",
        squashed.alias("squashed"),
        T.count_words(squashed).cast("long").alias("words"),
        T.truncate_ellipsis(F.concat(F.lit("<b>"), t, F.lit("</b>")), 40).alias("short"),
        T.strip_markdown(marked).alias("plain"),
        T.sanitize_text(F.concat(F.lit("<i>JavaScript:"), t, F.lit("</i>  "))).alias("clean"),
        T.strip_json_fence(F.concat(F.lit("```json\n"), F.col("lang"), F.lit("\n```"))).alias("unfenced"),
        T.to_fixed(F.col("n_chars") / 8, 2).alias("fixed"),
        T.js_round(F.col("n_chars") / 2 - 40).alias("rounded"),
    )


@query
def date_labels(spark, d):
    return supplied(spark, d, "events").select(
        "event_id",
        T.format_utc(F.when(F.col("event_id") % 7 != 0, F.col("ts"))).alias("long_label"),
        T.format_utc_short(F.when(F.col("event_id") % 7 != 0, F.col("ts"))).alias("short_label"),
    )


@query
def json_or(spark, d):
    body = F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props"))
    value = T.json_or(body, F.parse_json(F.lit('{"k": -1}')))
    return supplied(spark, d, "events").select(
        "event_id", F.try_variant_get(value, "$.k", "long").alias("k")
    )


@query
def amounts(spark, d):
    paise = F.round(F.col("o_totalprice") * F.col("o_orderkey") % 300000).cast("long")
    typed = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" "), (paise % 12000).cast("string")))
        .when(F.col("o_orderkey") % 5 == 1, F.lit("  "))
        .when(F.col("o_orderkey") % 5 == 2, F.lit("12.50"))
        .when(F.col("o_orderkey") % 5 == 3, F.lit("99999999999999999999"))
        .otherwise(F.lit("49"))
    )
    df = supplied(spark, d, "orders").select("o_orderkey", paise.alias("paise"), typed.alias("typed"))
    parsed = money.parse_amount(F.col("typed"))
    return df.withColumn("p", parsed).select(
        "o_orderkey",
        money.format_inr(F.col("paise") * 1000).alias("inr"),
        money.amount_label(F.when(F.col("o_orderkey") % 3 == 0, F.lit(9900)).otherwise(F.col("paise"))).alias("label"),
        money.valid_amount(F.col("paise")).alias("valid"),
        money.amount_error(F.col("paise")).alias("error"),
        F.col("p.amount_paise").alias("parsed_paise"),
        F.col("p.error").alias("parsed_error"),
    )


@query
def client_ips(spark, d):
    n = F.col("event_id")
    ip = F.concat(F.lit("10.0.0."), n % 256)
    headers = F.create_map(
        F.lit("cf-connecting-ip"), F.when(n % 4 == 0, F.lit("unknown")).when(n % 4 == 1, ip),
        F.lit("x-real-ip"), F.when(n % 3 == 0, F.lit("127.0.0.1")),
        F.lit("x-forwarded-for"), F.when(n % 5 == 0, F.concat(F.lit(" 192.168.1."), n % 100, F.lit(", 8.8.8.8"))),
    )
    reported = F.when(n % 7 < 5, F.lit(" 2001:db8::1 ")).otherwise(F.lit("not an ip"))
    return supplied(spark, d, "events").select(
        "event_id", U.first_valid_ip(headers, reported).alias("ip")
    )


# --- signals ------------------------------------------------------------------


@query
def page_signals_text(spark, d):
    s = extract_signals(_plain_pages(spark, d))
    cols = ("h1_count", "h2_count", "h3_count", "word_count", "html_size_bytes")
    return _longs(s, *cols).select("page_id", "title", "h1", "has_email_plaintext", *cols)


@query
def page_links(spark, d):
    s = _longs(_signals(spark, d), "internal_links", "external_links", "generic_link_count")
    return s.select(
        "page_id",
        "internal_links",
        "external_links",
        "generic_link_count",
        _join("internal_link_targets").alias("targets"),
        _join("checked_links").alias("checked"),
    )


@query
def meta_signals(spark, d):
    s = _longs(_signals(spark, d), "hreflang_count")
    return s.select(
        "page_id", "title", "meta_description", "canonical", "is_indexable", "has_viewport",
        "has_lang", "has_favicon", "has_hreflang", "hreflang_count", "og_title",
        "og_description", "og_image", "has_social_tags", "has_twitter_card",
    )


@query
def schema_signals(spark, d):
    return _signals(spark, d).select(
        "page_id", _join("schema_types").alias("schema_types"), "schema_valid", "has_schema"
    )


@query
def flag_signals(spark, d):
    counts = (
        "h1_count", "h2_count", "word_count", "image_count", "images_without_alt",
        "iframe_count", "script_count", "html_size_bytes",
    )
    return _longs(_signals(spark, d), *counts).select(
        "page_id", *counts, "is_https", "is_homepage", "has_flash", "mixed_content",
        "looks_like_spa_shell", "has_linkedin_link", "has_facebook_link", "has_instagram_link",
        "has_youtube_link", "has_email_plaintext",
    )


@query
def header_signals(spark, d):
    flags = (
        "hsts", "csp", "x_content_type", "x_frame_options", "referrer_policy",
        "permissions_policy",
    )
    return _signals(spark, d).select(
        "page_id",
        "compression",
        "x_robots_noindex",
        *[F.col(f"security_headers.{f}").alias(f) for f in flags],
        F.size("response_headers").cast("long").alias("headers"),
    )


@query
def stored_page_signals(spark, d):
    """Stored pages and fetch data, read and joined as signals."""
    fetched = crawl_pages(spark, d)
    root = work_folder(spark, "stored")
    fetched.select("page_id", "url", "html").write.parquet(f"{root}/pages")
    kept = fetched.withColumn("error", F.when(F.col("page_id") % 31 == 30, "timeout"))
    status, load = F.col("status_code").cast("int"), F.col("load_time_ms").cast("long")
    meta = kept.where("page_id % 17 <> 16").select("page_id", status, load, "headers", "error")
    meta.write.parquet(f"{root}/fetch_meta")
    signals = tables.read_page_signals(spark, f"{root}/pages", f"{root}/fetch_meta")
    return _longs(signals, "status_code", "word_count").select(
        "page_id", "title", "word_count", "status_code", "load_time_ms", "compression", "x_robots_noindex",
        "is_indexable", F.size("response_headers").cast("long").alias("headers"),
    )


@query
def header_grade(spark, d):
    graded = payloads.grade_headers(
        _signals(spark, d).withColumn("site_key", F.col("page_id").cast("string"))
    )
    return _longs(graded, "score", "tests_passed", "tests_failed").select(
        F.col("site_key").cast("long").alias("page_id"),
        "grade",
        "score",
        "tests_passed",
        "tests_failed",
        _join(F.transform("failed_tests", lambda t: t["name"])).alias("failed"),
    )


# --- page rules and groups ----------------------------------------------------


@query
def page_rules(spark, d):
    return _longs(_issues(spark, d), "rule_seq").select(
        "site_key", "page_id", "rule_seq", "issue_key", "category", "severity", "title",
        "description", "recommendation", "affected_url",
    )


@query
def page_rules_plain(spark, d):
    """The page rules over the supplied pages as they are."""
    issues = rules_page.page_issues(extract_signals(_plain_pages(spark, d)))
    return issues.select("page_id", "issue_key", "severity", "description")


@query
def issue_groups(spark, d):
    groups = grouping.group_issues(_issues(spark, d))
    return groups.drop("first_seen", "recommendation")


@query
def issue_group_urls(spark, d):
    urls = grouping.issue_group_urls(_issues(spark, d))
    return urls.select(
        "site_key", "issue_key", "affected_url", "count", F.col("first_seen.page_seq").alias("first_page")
    )


@query
def visible_urls(spark, d):
    issues = rules_page.page_issues(_signal_table(spark, d))
    shown = grouping.visible_urls(grouping.issue_group_urls(issues), grouping.group_issues(issues))
    return shown.select("site_key", "issue_key", _join("shown_urls").alias("shown"), "more_urls")


@query
def worst_sites(spark, d):
    """Which sites have the worst on-page problems: ordered groups of the plain pages."""
    issues = rules_page.page_issues(extract_signals(_plain_pages(spark, d)))
    groups = grouping.order_groups(grouping.group_issues(issues))
    return groups.where(F.col("category") == "onpage").select(
        "site_key", "issue_key", "severity", "title", "first_url", "url_count", "count"
    )


@query
def severity_counts(spark, d):
    return grouping.severity_counts(grouping.group_issues(_issues(spark, d)))


@query
def category_counts(spark, d):
    return grouping.category_counts(grouping.group_issues(_issues(spark, d)))


# --- links --------------------------------------------------------------------


@query
def page_link_counts(spark, d):
    return links.page_link_counts(links.link_edges(_signals(spark, d)))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = derived(spark, d, "graph_pages").withColumn(
        "norm_url", U.normalize_page_url(F.col("url"))
    )
    return derived(spark, d, "graph_edges"), pages


@query
def edges_to_pages(spark, d):
    return _longs(links.edges_to_pages(*_graph(spark, d)), "pos")


@query
def inbound_counts(spark, d):
    return links.inbound_counts(*_graph(spark, d)).select("site_key", "page_id", "url", "inbound")


@query
def orphan_pages(spark, d):
    orphans = links.orphan_pages(*_graph(spark, d), derived(spark, d, "graph_sites"))
    return links.orphan_issues(orphans).select("site_key", "page_id", "description", "affected_url")


@query
def first_seen_links(spark, d):
    return _longs(links.first_seen_links(derived(spark, d, "graph_links")), "pos")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    first = links.first_seen_links(derived(spark, d, "graph_links"))
    return links.link_status(first, derived(spark, d, "url_status"))


@query
def link_status(spark, d):
    return _checked(spark, d).select("site_key", "page_id", "url", "kind")


@query
def broken_totals(spark, d):
    return links.broken_redirect_totals(_checked(spark, d))


@query
def link_issues(spark, d):
    pages = derived(spark, d, "graph_links").select("site_key", "page_id").distinct()
    pages = pages.withColumn("url", F.concat(F.lit("https://"), "site_key", F.lit("/n/"), "page_id"))
    issues = links.link_issues(_checked(spark, d), pages)
    return issues.select("site_key", "page_id", "issue_key", "severity", "description", "affected_url")


@query
def exclude_seen(spark, d):
    """Links of odd pages that no even page of the site has."""
    all_links = derived(spark, d, "graph_links")
    even = F.col("page_id") % 2 == 0
    fresh = links.exclude_seen(all_links.where(~even), all_links.where(even))
    return _longs(fresh, "pos").select("site_key", "url", "page_id", "pos")


@query
def sample_links(spark, d):
    sample = links.sample_links(derived(spark, d, "graph_links"), n=3, home_extra=2)
    return _longs(sample, "pos", "round")


# --- site rules ---------------------------------------------------------------


@query
def dup_titles(spark, d):
    dups = sites.duplicate_values(extract_signals(_plain_pages(spark, d)), "title")
    return dups.select("site_key", "value", "pages", "first_url")


@query
def dup_metas(spark, d):
    dups = sites.duplicate_values(_signals(spark, d), "meta_description")
    issues = sites.duplicate_issues(dups, "dup-metas")
    return issues.select("site_key", "severity", "description", "affected_url")


@query
def coverage(spark, d):
    cov = sites.coverage(sites.site_facts(_signals(spark, d)))
    return cov


@query
def low_link_ratio(spark, d):
    ratio = sites.low_link_ratio(sites.site_facts(_signals(spark, d)))
    return ratio.withColumn("low_link_ratio", F.round("low_link_ratio", 6))


def _failures(spark: SparkSession, d: str) -> DataFrame:
    """A failed fetch per supplied page: its URL with another path."""
    url = F.concat(F.col("url"), F.lit("&failed"))
    return supplied(spark, d, "pages").select(
        U.site_key(F.col("url")).alias("site_key"),
        "page_id",
        (F.col("page_id") + 1_000_000_000).alias("page_seq"),
        url.alias("url"),
        F.when(F.col("page_id") % 2 == 0, F.lit("timeout")).alias("error"),
    )


@query
def crawl_failures(spark, d):
    return sites.crawl_failures(_failures(spark, d)).select(
        "site_key", "page_id", "issue_key", "severity", "description", "affected_url"
    )


@query
def site_rules(spark, d):
    """Coverage counts failed pages too; robots and sitemaps vary by site name."""
    facts = sites.site_facts(_signals(spark, d), failures=_failures(spark, d))
    n = F.length("site_key")
    files = facts.withColumns(
        {
            "robots_txt": F.when(n % 3 == 0, F.lit("")).when(n % 3 == 1, F.lit("User-agent: *")),
            "sitemap_found": n % 2 == 0,
        }
    )
    issues = sites.crawl_site_issues(files)
    return issues.select("site_key", "issue_key", "category", "severity", "description", "affected_url")


@query
def probe_rules(spark, d):
    probes, urls = derived(spark, d, "probes"), derived(spark, d, "sites")
    return sites.probe_issues(probes, urls).select("site_key", "issue_key", "severity", "affected_url")


# --- discovery ----------------------------------------------------------------


def _discovery(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(derived(spark, d, n) for n in ("robots", "sitemap_docs", "sites"))


@query
def discover_urls(spark, d):
    return discovery.discover_urls(*_discovery(spark, d)).select("site_key", "url", "pos.*")


@query
def discover_urls_capped(spark, d):
    """The crawl's own limits, lowered so that they take effect on small sitemaps."""
    found = discovery.discover_urls(*_discovery(spark, d), per_sitemap=3, children=1, enough=5)
    return found.select("site_key", "url", "pos.*")


@query
def sitemap_found(spark, d):
    return discovery.sitemap_found(*_discovery(spark, d))


@query
def crawl_rank(spark, d):
    return discovery.crawl_rank(discovery.discover_urls(*_discovery(spark, d))).select(
        "site_key", "url", "page_seq"
    )


@query
def cap_pages(spark, d):
    capped = discovery.cap_pages(discovery.discover_urls(*_discovery(spark, d)), 3)
    return _longs(capped, "page_seq").select("site_key", "url", "page_seq")


@query
def distinct_keep_order(spark, d):
    rows = derived(spark, d, "graph_edges")
    return discovery.distinct_keep_order(rows, ["site_key", "target_url"], "src_seq")


# --- outside checks -----------------------------------------------------------


@query
def lab_runs(spark, d):
    runs = payloads.lab_runs(derived(spark, d, "lab_payloads"))
    return runs.withColumn("cls", F.round("cls", 6)).select(
        "site_key", "strategy", "performance_score", "accessibility_score",
        "best_practices_score", "seo_score", "lcp_ms", "cls", "inp_ms",
    )


def _best_runs(spark: SparkSession, d: str) -> DataFrame:
    return payloads.prefer_strategy(payloads.lab_runs(derived(spark, d, "lab_payloads")))


@query
def prefer_strategy(spark, d):
    return _best_runs(spark, d).select("site_key", "strategy", "performance_score")


def _lab_audits(spark: SparkSession, d: str) -> DataFrame:
    return payloads.dedupe_lab_audits(payloads.lab_audits(derived(spark, d, "lab_payloads")))


@query
def lab_audits(spark, d):
    return _lab_audits(spark, d).select(
        "site_key", "audit_id", "strategy", F.round("score", 6).alias("score"), "mode", "title",
        "display_value", "mapped_category",
    )


@query
def worst_lab_audits(spark, d):
    worst = payloads.worst_lab_audits(_lab_audits(spark, d), k=4, findings=3)
    return _longs(worst, "rank").select("site_key", "audit_id", "rank")


@query
def lab_findings(spark, d):
    worst = payloads.worst_lab_audits(_lab_audits(spark, d))
    issues = rules_external.lab_issues(_best_runs(spark, d), worst, derived(spark, d, "sites"))
    return issues.select(
        "site_key", "issue_key", "category", "severity", "title", "description",
        "recommendation", "affected_url",
    )


@query
def field_ratings(spark, d):
    ratings = payloads.field_ratings(derived(spark, d, "field_payloads"))
    p75 = [c for c in ratings.columns if c.endswith("_p75")]
    return ratings.withColumns({c: F.round(c, 6) for c in p75})


@query
def dns_flags(spark, d):
    flags = payloads.dns_flags(derived(spark, d, "dns_answers"))
    return _longs(flags, "email_auth_score").withColumn("mx_records", _join("mx_records"))


@query
def threats(spark, d):
    scans, matches = derived(spark, d, "threat_scans"), derived(spark, d, "threat_matches")
    return payloads.distinct_threats(scans, matches).withColumn("threats", _join("threats"))


@query
def html_messages(spark, d):
    counts = payloads.html_message_counts(derived(spark, d, "html_messages"))
    top = F.transform(
        "top_issues", lambda t: F.concat_ws(":", t["type"], t["message"], t["line"])
    )
    return counts.withColumn("top_issues", _join(top))


@query
def authority(spark, d):
    ranks = payloads.authority_rank(derived(spark, d, "authority"))
    score = payloads.authority_score(F.when(F.col("available"), F.col("domain_rank")))
    return _longs(ranks.withColumn("score", score), "score")


def _external(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    scans, matches = derived(spark, d, "threat_scans"), derived(spark, d, "threat_matches")
    return {
        "field": payloads.field_ratings(derived(spark, d, "field_payloads")),
        "headers": payloads.grade_headers(_customer_headers(spark, d)),
        "threats": payloads.distinct_threats(scans, matches),
        "dns": payloads.dns_flags(derived(spark, d, "dns_answers")),
        "markup": payloads.html_message_counts(derived(spark, d, "html_messages")),
        "authority": payloads.authority_rank(derived(spark, d, "authority")),
    }


def _customer_headers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    flags = {
        "hsts": 2, "csp": 3, "x_content_type": 4, "x_frame_options": 5, "referrer_policy": 6,
        "permissions_policy": 7,
    }
    return supplied(spark, d, "customer").select(
        F.concat(F.lit("c"), k, F.lit(".example.com")).alias("site_key"),
        (k % 5 != 0).alias("is_https"),
        F.struct(*[(k % m == 0).alias(n) for n, m in flags.items()]).alias("security_headers"),
    )


@query
def external_findings(spark, d):
    issues = rules_external.external_issues(derived(spark, d, "sites"), **_external(spark, d))
    return issues.select(
        "site_key", "issue_key", "category", "severity", "title", "description", "affected_url"
    )


@query
def technical_lines(spark, d):
    urls = derived(spark, d, "sites")
    ext = _external(spark, d)
    ext["threats"] = ext["threats"].join(urls, "site_key")
    lines = report.technical_lines(lab=_best_runs(spark, d), **ext)
    return _longs(lines, "position")


# --- scores -------------------------------------------------------------------


def _score_inputs(spark: SparkSession, d: str) -> DataFrame:
    """One scored site per customer: its own outside answers and the facts of a page site.

    That is the site of the page with the customer's number, counted round the pages.
    """
    signals = _signal_table(spark, d)
    urls = derived(spark, d, "sites")
    number = F.regexp_extract("site_key", r"^c(\d+)\.", 1).cast("long")
    owners = saved(
        urls.select(F.col("site_key").alias("customer_key"), (number % signals.count()).alias("page_id"))
        .join(signals.select("page_id", "site_key"), "page_id")
        .drop("page_id"),
        "owners",
    )

    def of_customers(table: DataFrame) -> DataFrame:
        named = table.join(owners, "site_key").withColumn("site_key", F.col("customer_key"))
        return named.drop("customer_key")

    page_facts = saved(sites.site_facts(signals), "facts")
    facts = of_customers(page_facts)
    ext = _external(spark, d)
    pages, edges = links.page_urls(signals), links.link_edges(signals)
    orphans = links.orphan_pages(edges, pages, page_facts.select("site_key", "base_url"))
    titles = sites.duplicate_values(signals, "title")
    n = F.col("n_pages")
    totals = facts.select(
        "site_key",
        (n % 5).alias("broken_links"),
        (n % 8).alias("redirect_links"),
        F.when(n % 2 == 0, F.lit("User-agent: *")).alias("robots_txt"),
        (n % 3 == 0).alias("sitemap_found"),
    )
    return score_facts(
        facts,
        # Counted per page site: every customer of a site would repeat all its rows.
        of_customers(site_total(titles, "duplicate_title_sets")),
        of_customers(site_total(orphans, "orphan_pages")),
        totals,
        probes=derived(spark, d, "probes"),
        lab=_best_runs(spark, d),
        headers=ext["headers"].where(F.col("tests_failed") < 5),
        **{k: ext[k] for k in ("field", "dns", "markup", "authority")},
    )


@query
def check_scores(spark, d):
    return _longs(scoring.check_scores(_score_inputs(spark, d)), "weight")


@query
def category_scores(spark, d):
    return scoring.category_scores(_score_inputs(spark, d))


@query
def weighted_scores(spark, d):
    scores = scoring.check_scores(_score_inputs(spark, d))
    weighted = scoring.weighted_category_scores(scores)
    return weighted.withColumn("weighted", F.round("weighted", 6))


@query
def home_header_grade(spark, d):
    graded = home_headers(sites.site_facts(_signals(spark, d)))
    return _longs(graded, "score").select("site_key", "grade", "score")


# --- reports ------------------------------------------------------------------


def _as_audits(signals: DataFrame) -> DataFrame:
    return signals.withColumn("audit_id", F.length("site_key"))


def _stored_issues(signals: DataFrame) -> DataFrame:
    """Page findings as a stored table; some lack their page or an up-to-date category."""
    return rules_page.page_issues(signals).withColumns(
        {
            "audit_id": F.length("site_key"),
            "issue_id": F.col("page_id") * 100 + F.col("rule_seq"),
            "category": F.when(F.col("rule_seq") == 13, F.lit("schema"))
            .when(F.col("rule_seq") == 19, F.lit("accessibility"))
            .when(F.col("rule_seq") == 12, F.lit("made-up"))
            .otherwise(F.col("category")),
            "page_id": F.when(F.col("rule_seq") % 5 != 0, F.col("page_id")),
            "affected_url": F.when(F.col("rule_seq") % 15 != 0, F.col("affected_url")),
            "ai_recommendation": F.when(
                F.col("page_id") % 3 == 1, F.concat(F.lit("advice "), F.col("page_id"))
            ),
        }
    )


def _saved_issues(spark: SparkSession, d: str) -> DataFrame:
    return _stored_issues(_signals(spark, d))


def _saved_audits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages and findings of the same stored signals."""
    signals = _signal_table(spark, d)
    return _as_audits(signals), saved(_stored_issues(signals), "issues")


@query
def report_groups(spark, d):
    groups = grouping.group_report_issues(
        _saved_issues(spark, d).withColumn("site_key", F.col("audit_id").cast("string"))
    )
    return groups.drop("first_seen", "recommendation")


@query
def attach_page_id(spark, d):
    issues = report.attach_page_id(*reversed(_saved_audits(spark, d)))
    return issues.select("issue_id", "page_id")


@query
def issues_with_page(spark, d):
    joined = report.issues_with_page(*reversed(_saved_audits(spark, d)))
    return _longs(joined, "page_word_count").select("issue_id", "page_url", "page_title", "page_word_count")


@query
def pages_with_serious_issue(spark, d):
    pages, issues = _saved_audits(spark, d)
    return _longs(report.pages_with_serious_issue(pages, issues, 5), "audit_id").select("audit_id", "page_id")


@query
def page_issue_lists(spark, d):
    lists = report.page_issue_lists(*_saved_audits(spark, d))
    return lists.select("page_id", "position", "title", "severity")


@query
def issue_count_per_page(spark, d):
    counts = report.issue_count_per_page(*_saved_audits(spark, d))
    return counts.select("page_id", "issue_count")


@query
def audit_children(spark, d):
    children = report.audit_children(*_saved_audits(spark, d))
    return _longs(children, "audit_id")


@query
def compact_summary(spark, d):
    pages, issues = _saved_audits(spark, d)
    summary = report.compact_summary(pages.select("audit_id").distinct(), issues)
    top = F.transform("top_problems", lambda p: F.concat_ws(":", p["title"], p["severity"], p["category"]))
    return _longs(summary, "audit_id").select("audit_id", _join(top).alias("top_problems"))


@query
def report_summary(spark, d):
    audits = derived(spark, d, "customer_audits").withColumn(
        "category_scores",
        F.create_map(F.lit("onpage"), F.col("overall_score"), F.lit("links"), F.col("pages_crawled")),
    )
    severity = derived(spark, d, "payments").groupBy("audit_id").agg(
        F.count_if(F.col("status") == "captured").alias("critical_count"),
        F.count_if(F.col("status") == "failed").alias("warning_count"),
        F.count_if(F.col("status") == "pending").alias("notice_count"),
        F.count(F.lit(1)).alias("total_unique"),
    )
    summary = report.report_summary(audits, severity)
    return _longs(summary, "overall_score", "pages_crawled", *[f"{c}_score" for c in dims.CATEGORIES])


@query
def error_classes(spark, d):
    return report.error_class_counts(derived(spark, d, "audit_history"))


# --- refresh, delete ----------------------------------------------------------


def _customer_issues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored findings of every customer site, some without a key, and its sites."""
    urls = derived(spark, d, "sites")
    ext = _external(spark, d)
    found = rules_external.external_issues(urls, **ext)
    old = rules_external.lab_issues(
        _best_runs(spark, d), payloads.worst_lab_audits(_lab_audits(spark, d)), urls
    )
    keyless = F.when(F.col("site_key").endswith("7.example.com"), None).otherwise(F.col("issue_key"))
    return found.unionByName(old).withColumn("issue_key", keyless), urls


def _new_dns_issues(spark: SparkSession, d: str) -> DataFrame:
    flags = payloads.dns_flags(derived(spark, d, "dns_answers")).withColumns(
        {"has_spf": ~F.col("has_spf"), "has_mx": F.lit(False)}
    )
    return rules_external.external_issues(derived(spark, d, "sites"), dns=flags)


@query
def refresh_slice(spark, d):
    issues, _ = _customer_issues(spark, d)
    kept = refresh.replace_slice(issues, "dns", _new_dns_issues(spark, d))
    return kept.select("site_key", "issue_key", "severity", "title", "affected_url")


@query
def refresh_vitals(spark, d):
    """Refresh with an empty answer: lab and field findings go, the rest stays."""
    issues, _ = _customer_issues(spark, d)
    kept = issues.where(~refresh.matches_integration("google-vitals"))
    return kept.select("site_key", "issue_key", "severity", "title")


@query
def refresh_scores(spark, d):
    """Scores after the home page's header result was written back to the facts."""
    facts = _score_inputs(spark, d)
    scans = home_headers(facts).withColumn(
        "failed_tests", F.slice("failed_tests", 2, 6)
    )
    synced = refresh.sync_headers(facts, scans)
    columns = scoring.EXTERNAL_COLUMNS["headers"]
    fresh = refresh.set_external(synced, "headers", scans.withColumn("available", F.lit(False)), columns)
    return scoring.category_scores(fresh)


@query
def refresh_stored_audits(spark, d):
    """Saved audits of all customers, a quarter of them refreshed in place, with their totals."""
    number = F.regexp_extract("site_key", r"^c(\d+)\.", 1).cast("long")
    issues, urls = _customer_issues(spark, d)
    zero = F.lit(None).cast("long")
    counts = [zero.alias(c) for c in ("total_issues", "critical_count", "warning_count", "notice_count")]
    day = F.date_add(F.lit("2024-01-01").cast("date"), (number % 12).cast("int"))
    audits = urls.select("site_key", number.alias("audit_id"), day.cast("timestamp").alias("created_at"), *counts)
    pages = urls.select(
        number.alias("audit_id"), (number * 10).alias("page_id"), number.alias("page_seq"), F.col("base_url").alias("url")
    )
    root = work_folder(spark, "audits")
    tables.write_audit(audits, pages, issues.withColumn("audit_id", number), root, run="march")
    touched = audits.where(F.col("audit_id") % 4 == 0)
    found = _new_dns_issues(spark, d).withColumn("audit_id", number)
    tables.refresh_audits(spark, root, "dns", touched, found)
    stored, summaries = (spark.read.parquet(f"{root}/{n}") for n in ("issues", "audits"))
    totals = summaries.select("audit_id", "total_issues", "critical_count", "warning_count", "notice_count")
    return stored.join(by_key(totals), "audit_id").select(
        "audit_id", "site_key", "issue_key", "severity", "title", "page_id", *totals.columns[1:]
    )


@query
def delete_audits(spark, d):
    history = derived(spark, d, "audit_history")
    ids = history.where(F.col("status") == "failed").select("audit_id")
    left = refresh.delete_audits({"audits": history, "pages": history.select("audit_id", "domain")}, ids)
    return left["pages"].groupBy("domain").agg(F.count(F.lit(1)).alias("audits"))


@query
def reset_audits(spark, d):
    audits = derived(spark, d, "customer_audits").withColumn("status", F.lit("completed"))
    ids = audits.where(F.col("overall_score") < 50).select("audit_id")
    out = refresh.reset_audits({"audits": audits}, ids)["audits"]
    return _longs(out, "overall_score", "pages_crawled").select(
        "audit_id", "status", "overall_score", "pages_crawled"
    )


# --- recommendations ----------------------------------------------------------


@query
def fallback_recommendations(spark, d):
    rows = recommend.fallback_recommendation(_saved_issues(spark, d))
    return rows.select("issue_id", "title", "summary", "how_to_fix", "priority", "effort", "example_fix")


@query
def request_batches(spark, d):
    batches = recommend.batch_issues(
        recommend.recommendation_candidates(_saved_issues(spark, d), 20), 8
    )
    return _longs(batches, "batch_no", "idx", "audit_id").select("audit_id", "batch_no", "idx", "issue_id")


def _batches(issues: DataFrame) -> DataFrame:
    batches = recommend.batch_issues(recommend.recommendation_candidates(issues))
    return batches.withColumn("domain", F.lit("the site"))


@query
def enrichment_requests(spark, d):
    pages, issues = _saved_audits(spark, d)
    with_page = report.issues_with_page(_batches(issues), pages)
    return _longs(recommend.enrichment_requests(with_page), "audit_id", "batch_no", "issues")


def _answers(batches: DataFrame) -> DataFrame:
    """Stored answers: fenced, wrapped, older names, too short, or no JSON."""
    a = F.col("audit_id")
    item = lambda i: (
        '{"title":" T%d ","why_it_matters":"W","howToFix":7,"priority":"high","impact":"huge",'
        '"recommended_tool":"tool","effort":"quick"}' % i
    )
    items = "[" + ",".join([item(0), '{"recommendation":' + item(1) + "}", "{}"]) + "]"
    body = (
        F.when(a % 4 == 0, F.lit('```json\n{"recommendations":' + items + "}\n```"))
        .when(a % 4 == 1, F.lit(items))
        .when(a % 4 == 2, F.lit('{"data":{"data":{"recommendations":' + items + "}}}"))
        .otherwise(F.lit("no answer"))
    )
    return batches.select("audit_id", "batch_no").distinct().withColumn("body", body)


@query
def apply_enrichment(spark, d):
    batches = saved(_batches(_saved_issues(spark, d)), "batches")
    rows = recommend.apply_enrichment(batches, _answers(batches))
    return rows.select(
        "issue_id", "title", "why_it_matters", "how_to_fix", "priority", "impact", "effort",
        "recommended_tool",
    )


@query
def answered_requests(spark, d):
    """Recommendations through a function that fails on long batches and on some findings."""
    pages, issues = _saved_audits(spark, d)
    batches = saved(report.issues_with_page(_batches(issues), pages), "batches")

    def answer(request: str) -> str:
        found = request.count("  what was found: ")
        if found > 3 or (found == 1 and "(critical, " in request):
            raise TimeoutError
        return json.dumps([{"title": f"{i + 1} of {found}"} for i in range(found)])

    rows = recommend.apply_enrichment(batches, recommend.request_answers(batches, answer))
    return rows.select("issue_id", "title")


def _category_rows(spark: SparkSession, d: str) -> DataFrame:
    cats = F.array(*[F.lit(c) for c in dims.CATEGORIES])
    pages, issues = _saved_audits(spark, d)
    audits = pages.select("audit_id").distinct()
    scores = audits.select("audit_id", F.posexplode(cats).alias("i", "category")).select(
        "audit_id", "category", ((F.col("audit_id") * 7 + F.col("i") * 31) % 101).alias("score")
    )
    return recommend.category_recommendations(scores, issues)


@query
def category_recommendations(spark, d):
    items = F.transform(
        "recommendations", lambda r: F.concat_ws(":", r["title"], r["description"], r["impact"], r["effort"])
    )
    rows = _longs(_category_rows(spark, d), "audit_id", "score")
    return rows.withColumn("recommendations", _join(items))


@query
def page_summaries(spark, d):
    rows = recommend.page_summary(*_saved_audits(spark, d))
    return rows.select(
        "page_id", "page_url", "summary", _join("main_problems").alias("problems"),
        _join("recommended_fixes").alias("fixes"), "priority",
    )


@query
def overview_answers(spark, d):
    """Overview answers of every event: wrapped, renamed, incomplete, or broken."""
    n = F.col("event_id")
    body = (
        F.when(n % 4 == 0, F.concat(F.lit('{"overview":{"summary":{"title":"H'), n, F.lit('","top_strengths":["a","",3]},"plan":{"quick_wins":["q"]}}}')))
        .when(n % 4 == 1, F.lit('{"executiveSummary":{"data":{"headline":"  ","overview":"O"}},"actionPlan":[1]}'))
        .when(n % 4 == 2, F.lit("```\n{}\n```"))
        .otherwise(F.lit("sorry"))
    )
    df = supplied(spark, d, "events").select("event_id", recommend.normalize_overview(body).alias("o"))
    return df.select(
        "event_id",
        F.col("o.executive_summary.headline").alias("headline"),
        F.col("o.executive_summary.summary").alias("summary"),
        _join("o.executive_summary.topStrengths").alias("strengths"),
        _join("o.action_plan.quickWins").alias("quick_wins"),
        _join("o.action_plan.sevenDayPlan").alias("seven_days"),
    )


# --- usage and payments -------------------------------------------------------


@query
def usage_overview(spark, d):
    return usage.overview(derived(spark, d, "audit_history"), F.lit(TODAY).cast("timestamp"))


@query
def ip_usage(spark, d):
    rows = usage.ip_usage(derived(spark, d, "audit_history"))
    return rows.select(
        "ip", "audit_count", "unique_domains", _join("domains").alias("domains"),
        _stamp("first_seen"), _stamp("last_seen"),
    )


@query
def top_ips(spark, d):
    rows = usage.top_ips(usage.ip_usage(derived(spark, d, "audit_history")))
    return rows.select("ip", "audit_count", "unique_domains")


@query
def recent_audits(spark, d):
    rows = usage.recent_audits(derived(spark, d, "audit_history"))
    return rows.select("audit_id", "domain", "client_ip", _stamp("created_at"))


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("audit_id").desc()]


@query
def audits_page(spark, d):
    page, size = usage.parse_pagination("3", "40")
    rows = usage.page_of(derived(spark, d, "audit_history"), _newest_first(), page, size)
    return rows.select("audit_id", "domain", _stamp("created_at"))


@query
def audits_page_info(spark, d):
    page, size = usage.parse_pagination("3", "40")
    return usage.page_info(derived(spark, d, "audit_history"), page, size)


@query
def numbered_pages(spark, d):
    rows = derived(spark, d, "audit_history")
    numbered = usage.number_pages(rows, _newest_first(), usage.DEFAULT_PAGE_SIZE)
    return _longs(numbered, "place").select("audit_id", "position", "page", "place")


@query
def payment_stats(spark, d):
    return payments.payment_stats(
        derived(spark, d, "payments"), F.lit(PAID_TODAY).cast("timestamp")
    )


@query
def recent_payments(spark, d):
    rows = payments.recent_payments(derived(spark, d, "payments"), status="captured")
    return rows.select("payment_id", "status", "amount_paise", _stamp("created_at"))


@query
def payments_with_audit_url(spark, d):
    joined = payments.payments_with_audit_url(
        derived(spark, d, "payments"), derived(spark, d, "customer_audits")
    )
    return joined.select("payment_id", "audit_id", "audit_url")


@query
def payment_ledger(spark, d):
    return payments.payment_ledger(
        derived(spark, d, "payment_events"), derived(spark, d, "payment_orders")
    )


@query
def checkout_confirm(spark, d):
    return payments.checkout_confirm(derived(spark, d, "confirmations"))


# --- streams ------------------------------------------------------------------


@query
def payment_status_stream(spark, d):
    return ledger.run_status(
        spark, derived(spark, d, "payment_events", stream=True), derived(spark, d, "payment_orders")
    )


@query
def payment_ledger_stream(spark, d):
    return ledger.run_ledger(
        spark, derived(spark, d, "payment_events", stream=True), derived(spark, d, "payment_orders")
    )


@query
def checkout_stream(spark, d):
    return ledger.run_confirmations(spark, derived(spark, d, "confirmations", stream=True)).select(
        "payment_id", "order_id"
    )


@query
def checkout_outcome_stream(spark, d):
    return ledger.run_outcomes(spark, derived(spark, d, "confirmations", stream=True))


@query
def audit_stream(spark, d):
    issues = page_stream.run_page_issues(spark, crawl_pages(spark, d, stream=True))
    return issues.select("page_id", "issue_key", "severity", "description")


@query
def site_rules_stream(spark, d):
    return page_stream.run_site_issues(spark, crawl_pages(spark, d, stream=True)).select(
        "site_key", "issue_key", "severity", "description"
    )


@query
def site_state_stream(spark, d):
    """All site findings off the merged state of the streams: facts, equal texts, links."""
    state = page_stream.SiteState(spark, crawl_pages(spark, d, stream=True))
    return state.issues().select("site_key", "issue_key", "severity", "description", "affected_url")
