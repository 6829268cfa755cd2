"""Oracles of links, site rules, discovery, outside checks and scores."""

from __future__ import annotations

from siteglass import dims
from siteglass.operators.rule_texts import (
    AUTHORITY_MESSAGE, EXTERNAL_TEXTS, HTML_ERRORS_TITLE, HTML_MESSAGE, HTML_WARNINGS_TITLE,
    LAB_DEFAULT_HINT, LAB_TEXTS, SCAN_MESSAGE, SITE_TEXTS, THREAT_MESSAGE,
)

from .base import (
    build, cte, either, fill, fixed, jsround, q, rule_select, rx, rx_replace, site_key, squashed,
    trimmed,
)
from .page_queries import HEADER_GRADE, HEADER_NAMES, header_tests

ORACLES: dict[str, str] = {}

# --- link graph -------------------------------------------------------------------

cte("unique_pages", "select site_key, url, page_id from graph_pages", "graph_pages")
cte("inbound", """select p.site_key, p.page_id, p.url, count(e.src_id) as inbound from unique_pages p
    left join graph_edges e on e.site_key = p.site_key and e.target_url = p.url and e.src_url <> e.target_url group by 1, 2, 3""", "unique_pages", "graph_edges")  # fmt: skip
ORACLES["edges_to_pages"] = build(
    """select e.site_key, e.src_id, cast(e.pos as bigint) as pos, e.target_url, p.page_id as dst_id from graph_edges e
    join unique_pages p on p.site_key = e.site_key and p.url = e.target_url where e.src_url <> e.target_url""", "unique_pages", "graph_edges")  # fmt: skip
ORACLES["inbound_counts"] = build("select * from inbound", "inbound")
ORACLES["orphan_pages"] = build(
    f"""select i.site_key, i.page_id, {fill(SITE_TEXTS['orphan-page'].description, 'i.url')} as description, i.url as affected_url from inbound i
    join graph_sites s on s.site_key = i.site_key where inbound = 0 and i.url <> s.base_url
    and (select count(*) from unique_pages u where u.site_key = i.site_key) > 1""", "inbound", "graph_sites", "unique_pages")  # fmt: skip
ORACLES["page_link_counts"] = build(
    """select site_key, page_id as src_id, cast(len(targets) as bigint) as internal_links, cast(len(list_distinct(targets)) as bigint) as distinct_targets
    from s_sig where len(targets) > 0""", "s_sig")  # fmt: skip
cte("link_pages", """select site_key, page_id, page_seq, bool_or(is_homepage) as home, list({'pos': pos, 'url': url} order by pos) as links,
    row_number() over (partition by site_key order by page_seq) as k from graph_links group by 1, 2, 3""", "graph_links")  # fmt: skip
# Page after page of a site: the first three links not picked before, then two more for the home page.
cte("link_walk", """with recursive walk as (
      select distinct site_key, cast(0 as bigint) as k, cast(null as bigint) as page_id, cast(null as bigint) as page_seq, cast([] as varchar[]) as seen,
        cast([] as struct(pos integer, url varchar)[]) as r1, cast([] as struct(pos integer, url varchar)[]) as r2 from link_pages
      union all
      select site_key, k, page_id, page_seq, list_concat(seen, list_transform(list_concat(r1, r2), lambda y: y.url)), r1, r2 from (
        select *, case when home then list_filter(fresh, lambda x: not list_contains(list_transform(r1, lambda y: y.url), x.url))[1:2] else fresh[1:0] end as r2 from (
          select *, fresh[1:3] as r1 from (
            select p.*, w.seen, list_filter(p.links, lambda x: not list_contains(w.seen, x.url)) as fresh
            from walk w join link_pages p on p.site_key = w.site_key and p.k = w.k + 1))))
    select * from walk where k > 0""", "link_pages")  # fmt: skip
ORACLES["sample_links"] = build(
    """select site_key, page_id, page_seq, cast(r.pos as bigint) as pos, r.url as url, round from (
      select site_key, page_id, page_seq, cast(1 as bigint) as round, unnest(r1) as r from link_walk
      union all select site_key, page_id, page_seq, cast(2 as bigint), unnest(r2) from link_walk)""", "link_walk")  # fmt: skip
cte("first_links", """select site_key, url, page_id, page_seq, cast(pos as bigint) as pos from graph_links
    qualify row_number() over (partition by site_key, url order by page_seq, pos) = 1""", "graph_links")  # fmt: skip
cte("checked", """select f.*, case when s.status is null or s.status >= 400 then 'broken' when s.status >= 300 then 'redirect' else 'ok' end as kind
    from first_links f left join url_status s using (url)""", "first_links", "url_status")  # fmt: skip
ORACLES["first_seen_links"] = build("select * from first_links", "first_links")
ORACLES["link_status"] = build("select site_key, page_id, url, kind from checked", "checked")
ORACLES["broken_totals"] = build(
    "select site_key, count(*) filter (kind = 'broken') as broken_links, count(*) filter (kind = 'redirect') as redirect_links from checked group by 1", "checked")
_page_url = "concat('https://', site_key, '/n/', page_id)"
ORACLES["link_issues"] = build(
    " union all ".join(
        f"""select site_key, page_id, '{key}' as issue_key, '{sev}' as severity,
        {fill(SITE_TEXTS[key].description, 'count(*)', 'arg_min(url, pos)')} as description, {_page_url} as affected_url
        from checked where kind = '{kind}' group by site_key, page_id"""
        for key, sev, kind in (("broken-links", "critical", "broken"), ("redirect-links", "warning", "redirect"))
    ),
    "checked",
)
ORACLES["exclude_seen"] = build(
    """select site_key, url, page_id, cast(pos as bigint) as pos from graph_links l where page_id % 2 = 1
    and not exists (select 1 from graph_links e where e.page_id % 2 = 0 and e.site_key = l.site_key and e.url = l.url)""", "graph_links")  # fmt: skip
ORACLES["distinct_keep_order"] = build(
    "select site_key, target_url, min(src_seq) as src_seq from graph_edges group by 1, 2", "graph_edges")

# --- site rules -------------------------------------------------------------------

_og = jsround("count(*) filter (has_social_tags) / count(*) * 100")
_schema = jsround("count(*) filter (has_schema) / count(*) * 100")
ORACLES["coverage"] = build(
    f"""select *, case when schema_coverage >= 70 then 'GOOD' when schema_coverage >= 30 then 'NEEDS_IMPROVEMENT' else 'POOR' end as schema_rating from
    (select site_key, count(*) as total_pages, count(*) filter (has_social_tags) as pages_with_og_tags, {_og} as social_coverage,
    count(*) filter (has_schema) as pages_with_schema, {_schema} as schema_coverage, {jsround('sum(load_time_ms) / count(*)')} as average_load_ms,
    count(*) filter (load_time_ms > 3000) as slow_pages from s_sig group by 1)""", "s_sig")  # fmt: skip
_base = f"concat({rx('arg_min(url, page_id)', '^(https?://[^/?#]+)')}, '/')"
cte("linking", f"""select site_key, {_base} as base_url, count(*) as n,
    count(*) filter (not is_homepage and word_count > 150 and internal_links < 3) as low, count(*) filter (not is_homepage and word_count > 150) as content,
    count(*) filter (has_schema) as n_schema, count(*) filter (has_social_tags) as n_og from s_sig group by 1""", "s_sig")  # fmt: skip
ORACLES["low_link_ratio"] = build(
    """select site_key, base_url, case when n > 1 then low else 0 end as low_link_pages, case when n > 1 then content else 0 end as content_pages,
    case when n > 1 and content > 0 then round(low / content, 6) else 0.0 end as low_link_ratio from linking""", "linking")  # fmt: skip
ORACLES["crawl_failures"] = f"""select {site_key('url')} as site_key, page_id, 'crawl-failure' as issue_key, 'critical' as severity,
  {fill(SITE_TEXTS['crawl-failure'].description, "concat(url, '&failed')", "case when page_id % 2 = 0 then 'timeout' else 'Unknown error' end")} as description,
  concat(url, '&failed') as affected_url from pages"""


def site_rules(extra: str) -> str:
    """Robots, sitemap, coverage and linking rules over ``linking`` as ``f``."""
    cols = "site_key"
    parts = [
        rule_select("f", 1, "no-robots", "coalesce(robots, '') = ''", "warning", SITE_TEXTS["no-robots"], url="base_url", columns=cols),
        rule_select("f", 2, "no-sitemap", "not sitemap", "warning", SITE_TEXTS["no-sitemap"], url="base_url", columns=cols),
        rule_select("f", 1, "low-schema-coverage", "n_schema / crawled < 0.5", "notice", SITE_TEXTS["low-schema-coverage"], (jsround("n_schema / crawled * 100"),), url="base_url", columns=cols),
        rule_select("f", 2, "low-og-coverage", "n_og / crawled < 0.8::double", "notice", SITE_TEXTS["low-og-coverage"], (jsround("n_og / crawled * 100"),), url="base_url", columns=cols),
        rule_select("f", 1, "site-low-internal-linking", "n > 1 and low > 0 and low / content >= 0.5", "warning", SITE_TEXTS["site-low-internal-linking"], ("low", "content"), url="base_url", columns=cols),
    ]
    body = " union all ".join(parts)
    return f"with f as (select *, {extra} from linking) {body}"


# Every supplied page also failed once under another URL, so crawls count double.
ORACLES["site_rules"] = build(
    "select site_key, issue_key, category, severity, description, affected_url from ("
    + site_rules("2 * n as crawled, case length(site_key) % 3 when 1 then 'User-agent: *' end as robots, length(site_key) % 2 = 0 as sitemap")
    + ")", "linking")
ORACLES["site_rules_stream"] = build(
    "select site_key, issue_key, severity, description from (" + site_rules("n as crawled, 'any' as robots, true as sitemap") + ")", "linking")
ORACLES["probe_rules"] = build(
    """select p.site_key, 'no-https-redirect' as issue_key, 'warning' as severity, base_url as affected_url from probes p join sites s using (site_key)
    where not https_enforced and starts_with(base_url, 'https://') union all
    select p.site_key, 'www-not-canonicalized', 'warning', base_url from probes p join sites s using (site_key)
    where www_resolves and apex_resolves and not canonicalized""", "probes", "sites")  # fmt: skip

# --- discovery --------------------------------------------------------------------

cte("roots", f"""select site_key, base_url, root - 1 as root, sitemap_url from (
    select site_key, base_url, list_concat(named, case when list_contains(named, std) then [] else [std] end) as all_roots from (
      select s.site_key, s.base_url, list_transform(coalesce(regexp_extract_all(r.robots_txt, '(?im)^Sitemap:\\s*(.+)$', 1), []), lambda x: {trimmed('x')}) as named,
        concat({rx('s.base_url', '^(https?://[^/]+)')}, '/sitemap.xml') as std from sites s left join robots r using (site_key))),
    unnest(all_roots) with ordinality as t(sitemap_url, root)""", "sites", "robots")  # fmt: skip
cte("locs", """select site_key, sitemap_url, regexp_matches(body, '(?i)<sitemapindex') as is_index, loc, pos - 1 as pos
    from (select *, regexp_extract_all(body, '(?i)<loc>\\s*([^<]+?)\\s*</loc>', 1) as l from sitemap_docs), unnest(l) with ordinality as t(loc, pos)""", "sitemap_docs")  # fmt: skip
_host_of = lambda u: rx(f"lower({u})", r"^[a-z]+://(?:www\.)?([^/?#:]+)")
_ok = f"""(regexp_matches(loc, '(?i)^https?://') and not regexp_matches(loc, '(?i)\\.(xml|pdf|jpg|png|css|js)\\z') and not regexp_matches({rx('loc', '^[a-z]+://[^/]*(.*)')}, '(?i)/sitemap')
  and ({_host_of('loc')} = {_host_of('base_url')} or ends_with({_host_of('loc')}, concat('.', {_host_of('base_url')}))))"""


def _found(children: int | None, per_sitemap: int | None) -> str:
    """Pages of all sitemaps, at most two indexes deep."""
    cap = "" if children is None else f" qualify row_number() over (partition by r.site_key, r.root, p0, p1, r.sitemap_url order by l.pos) <= {children}"
    base = "select r.site_key, r.base_url, r.root, {0} as p0, {1} as p1, l.loc as sitemap_url from {2} r join locs l using (site_key, sitemap_url) where l.is_index and regexp_matches(l.loc, '(?i)\\.xml|sitemap')" + cap
    pages = " union all ".join(
        f"select r.site_key, r.base_url, r.root, p0, p1, l.pos, l.loc as url from {t} r join locs l using (site_key, sitemap_url) where not l.is_index and {_ok}"
        for t in ("l0", "l1", "l2")
    )
    limit = "" if per_sitemap is None else f" qualify row_number() over (partition by site_key, root order by p0, p1, pos) <= {per_sitemap}"
    return f"""with l0 as (select *, 0 as p0, 0 as p1 from roots), l1 as ({base.format('l.pos', 'p1', 'l0')}), l2 as ({base.format('p0', 'l.pos', 'l1')})
      select * from ({pages}){limit}"""


def _candidates(found: str) -> str:
    return f"""select site_key, base_url, url, root::bigint as root, p0::bigint as p0, p1::bigint as p1, pos::bigint as pos from (
      select site_key, base_url, url, root, p0, p1, pos from {found}
      union all select site_key, base_url, base_url, -1, -1, -1, 0 from sites
      union all select site_key, base_url, concat({rx('base_url', '^(https?://[^/]+)')}, '/'), -1, -1, -1, 1 from sites)
      qualify row_number() over (partition by site_key, url order by root, p0, p1, pos) = 1"""  # fmt: skip


cte("found", _found(None, None), "roots", "locs")
cte("found_capped", _found(1, 3), "roots", "locs")
cte("candidates", _candidates("found"), "found", "sites")
cte("candidates_capped", _candidates("found_capped"), "found_capped", "sites")
ORACLES["discover_urls"] = build("select site_key, url, root, p0, p1, pos from candidates", "candidates")
ORACLES["discover_urls_capped"] = build(
    """select site_key, url, root, p0, p1, pos from candidates_capped c where root < 0 or
    (select count(*) from candidates_capped b where b.site_key = c.site_key and b.root < c.root) < 5""", "candidates_capped")  # fmt: skip
ORACLES["sitemap_found"] = build(
    "select site_key, site_key in (select site_key from found) as sitemap_found from sites", "found", "sites")
_upath = rx("url", "^[a-z]+://[^/?#]*([^?#]*)")
cte("crawl_ranked", f"""select site_key, url, row_number() over (partition by site_key order by case when {_host_of('url')} = site_key then 0 else 1 end,
    len(list_filter(string_split({_upath}, '/'), lambda s: s <> '')), greatest(length({_upath}), 1), root, p0, p1, pos) as page_seq from candidates""", "candidates")  # fmt: skip
ORACLES["crawl_rank"] = build("select * from crawl_ranked", "crawl_ranked")
ORACLES["cap_pages"] = build("select * from crawl_ranked where page_seq <= 3", "crawl_ranked")

# --- outside checks ---------------------------------------------------------------

_lh = "$.lighthouseResult"


def _num(path: str) -> str:
    """JSON number at a path, null for anything else."""
    return f"case when json_type(body, {q(path)}) in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast(json_extract_string(body, {q(path)}) as double) end"


def _audit_num(audit: str) -> str:
    return _num(f'{_lh}.audits."{audit}".numericValue')


def _score(cat: str) -> str:
    path = f'{_lh}.categories."{cat}".score'
    return jsround(f"coalesce({_num(path)}, 0) * 100")


cte("lab_ok", "select *, case strategy when 'mobile' then 0 else 1 end as sr from lab_payloads where json_valid(body)", "lab_payloads")
cte("runs", f"""select site_key, strategy, sr, {_score('performance')} as performance_score, {_score('accessibility')} as accessibility_score,
    {_score('best-practices')} as best_practices_score, {_score('seo')} as seo_score, {jsround(_audit_num('largest-contentful-paint'))} as lcp_ms,
    {_audit_num('cumulative-layout-shift')} as cls,
    coalesce({jsround(_audit_num('interaction-to-next-paint'))}, {jsround(_audit_num('experimental-interaction-to-next-paint'))}) as inp_ms from lab_ok""", "lab_ok")  # fmt: skip
cte("best_run", "select * from runs qualify row_number() over (partition by site_key order by sr) = 1", "runs")
ORACLES["lab_runs"] = build(
    "select site_key, strategy, performance_score, accessibility_score, best_practices_score, seo_score, lcp_ms, round(cls, 6) as cls, inp_ms from runs", "runs")
ORACLES["prefer_strategy"] = build("select site_key, strategy, performance_score from best_run", "best_run")
_cats = " ".join(
    f"when audit_id in ({', '.join(q(a) for a in ids)}) then '{cat}'" for cat, ids in dims.LAB_AUDITS.items()
)
_s = "json_extract_string(a, '$.{}')"
cte("audit_rows", f"""select site_key, strategy, sr, audit_id, case when json_type(a, '$.score') in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast({_s.format('score')} as double) end as score,
    coalesce({_s.format('scoreDisplayMode')}, 'binary') as mode, coalesce({_s.format('title')}, audit_id) as title, coalesce({_s.format('description')}, '') as description,
    {_s.format('displayValue')} as display_value, case {_cats} end as mapped_category from (
      select site_key, strategy, sr, audit_id, json_extract(body, concat('{_lh}.audits."', audit_id, '"')) as a
      from lab_ok, unnest(json_keys(body, '{_lh}.audits')) as t(audit_id))""", "lab_ok")  # fmt: skip
cte("audits", """select * from audit_rows where score < 0.9 and mode not in ('notApplicable', 'manual', 'informative') and (mapped_category is not null or score < 0.5)
    qualify row_number() over (partition by site_key, audit_id order by score, sr) = 1""", "audit_rows")  # fmt: skip
ORACLES["lab_audits"] = build(
    "select site_key, audit_id, strategy, round(score, 6) as score, mode, title, display_value, mapped_category from audits", "audits")
_suppressed = ", ".join(q(a) for a in dims.LAB_SUPPRESSED)


def _worst(k: int, findings: int) -> str:
    return f"""select *, row_number() over (partition by site_key order by score, audit_id) as rank from (
      select * from audits qualify row_number() over (partition by site_key order by score, audit_id) <= {k}) where audit_id not in ({_suppressed})
      qualify row_number() over (partition by site_key order by score, audit_id) <= {findings}"""  # fmt: skip


cte("worst", _worst(25, 15), "audits")
ORACLES["worst_lab_audits"] = build(f"select site_key, audit_id, rank from ({_worst(4, 3)})", "audits")
_low = lambda c: f"{c} > 0 and {c} < 90"
_grade = lambda c: either(f"{c} < 70", "warning", "notice")
_LAB = [
    ("pagespeed-poor", "performance_score < 50", "critical", ("performance_score",)),
    ("pagespeed-improve", "performance_score between 50 and 89", "warning", ("performance_score",)),
    ("cwv-lcp", "lcp_ms > 2500", either("lcp_ms > 4000", "critical", "warning"), (fixed("lcp_ms / 1000", 1),)),
    ("cwv-cls", "cls > 0.1::double", either("cls > 0.25::double", "critical", "warning"), (fixed("cls", 3),)),
    ("cwv-inp", "inp_ms > 200", either("inp_ms > 500", "warning", "notice"), ("inp_ms",)),
    ("lh-a11y", _low("accessibility_score"), _grade("accessibility_score"), ("accessibility_score",)),
    ("lh-best-practices", _low("best_practices_score"), _grade("best_practices_score"), ("best_practices_score",)),
    ("lh-seo", _low("seo_score"), _grade("seo_score"), ("seo_score",)),
]
_plain = lambda x: rx_replace(rx_replace(x, r"\[([^\]]+)\]\([^)]+\)", r"\1"), "[`*_]")
_hints = " ".join(f"when {q(a)} then {q(t)}" for a, t in dims.LAB_HINTS.items())
_high = ", ".join(q(a) for a in dims.LAB_HIGH_IMPACT)
cte("lab_issues", " union all ".join(
    rule_select("(best_run join sites using (site_key))", i, key, when, sev, LAB_TEXTS[key], values, url="base_url", columns="site_key")
    for i, (key, when, sev, values) in enumerate(_LAB, start=1)
) + f""" union all select site_key, 8 + rank, concat('lh-', audit_id), coalesce(mapped_category, 'performance'),
    case when score = 0 and audit_id in ({_high}) then 'critical' when score < 0.5 then 'warning' else 'notice' end, {squashed(_plain('title'))},
    case when display_value <> '' then concat(left({trimmed(_plain('description'))}, 260), ' (Current: ', display_value, ')') else left({trimmed(_plain('description'))}, 300) end,
    case audit_id {_hints} else {q(LAB_DEFAULT_HINT)} end, base_url from worst join sites using (site_key)""", "best_run", "worst", "sites")  # fmt: skip
ORACLES["lab_findings"] = build(
    "select site_key, issue_key, category, severity, title, description, recommendation, affected_url from lab_issues", "lab_issues")

_METRICS = {
    "lcp": ("largest_contentful_paint", 2500, 4000), "cls": ("cumulative_layout_shift", 0.1, 0.25),
    "inp": ("interaction_to_next_paint", 200, 500), "fcp": ("first_contentful_paint", 1800, 3000),
    "ttfb": ("experimental_time_to_first_byte", 800, 1800),
}
_p75 = ", ".join(
    f"case when http_status = 200 then {_num(f'$.record.metrics.{m}.percentiles.p75')} end as {n}_p75" for n, (m, _, _) in _METRICS.items()
)
_ratings = ", ".join(
    f"case when {n}_p75 is null then 'UNKNOWN' when {n}_p75 <= {g}::double then 'GOOD' when {n}_p75 <= {m}::double then 'NEEDS_IMPROVEMENT' else 'POOR' end as {n}_rating"
    for n, (_, g, m) in _METRICS.items()
)
cte("field", f"""select * exclude (r), case when list_contains(r, 'POOR') then 'POOR' when list_contains(r, 'NEEDS_IMPROVEMENT') then 'NEEDS_IMPROVEMENT'
    when list_contains(r, 'GOOD') then 'GOOD' else 'UNKNOWN' end as overall_rating from (select *, [lcp_rating, cls_rating, inp_rating] as r from
    (select *, {_ratings} from (select site_key, http_status <> 404 as available, {_p75} from field_payloads where http_status in (200, 404))))""", "field_payloads")  # fmt: skip
ORACLES["field_ratings"] = build("select * from field", "field")

_data = "trim(data, '\"')"
cte("dns", f"""select *, cast(least(100, has_spf::int * 40 + has_dmarc::int * 40 + coalesce(dmarc_policy in ('quarantine', 'reject'), false)::int * 20 + has_mx::int * 10) as bigint) as email_auth_score
    from (select *, spf_record is not null as has_spf, dmarc_record is not null as has_dmarc,
      nullif(lower({rx('dmarc_record', '(?i);' + chr(92) + 's*p' + chr(92) + 's*=' + chr(92) + 's*(none|quarantine|reject)')}), '') as dmarc_policy from (
      select site_key, arg_min({_data}, pos) filter (rtype = 'TXT' and not starts_with(name, '_dmarc.') and starts_with(lower({_data}), 'v=spf1')) as spf_record,
        arg_min({_data}, pos) filter (rtype = 'TXT' and starts_with(name, '_dmarc.') and starts_with(lower({_data}), 'v=dmarc1')) as dmarc_record,
        bool_or(rtype = 'MX') as has_mx, coalesce(string_agg(data, '|' order by pos) filter (rtype = 'MX'), '') as mx_records, bool_or(rtype = 'AAAA') as has_ipv6
      from dns_answers group by 1))""", "dns_answers")  # fmt: skip
ORACLES["dns_flags"] = build("select * from dns", "dns")
cte("threat", """select s.site_key, s.available, s.message, coalesce(t.threats, '') as threats, coalesce(t.n, 0) = 0 as safe, coalesce(t.n, 0) as n from threat_scans s left join (
    select site_key, string_agg(threat_type, '|' order by pos) as threats, count(*) as n from (select site_key, threat_type, min(pos) as pos from threat_matches group by 1, 2) group by 1) t
    using (site_key)""", "threat_scans", "threat_matches")  # fmt: skip
ORACLES["threats"] = build("select * exclude (n) from threat", "threat")
cte("markup", """select site_key, count(*) filter (type = 'error') = 0 as valid, count(*) filter (type = 'error') as error_count,
    count(*) filter (type in ('info', 'warning')) as warning_count,
    coalesce(string_agg(concat(type, ':', coalesce(message, 'Validation issue'), ':', last_line), '|' order by pos) filter (k <= 6 and listed), '') as top_issues,
    arg_min(coalesce(message, 'Validation issue'), pos) filter (listed) as top_message from (
    select *, type in ('error', 'warning') as listed, row_number() over (partition by site_key, type in ('error', 'warning') order by pos) as k from html_messages) group by 1""", "html_messages")  # fmt: skip
ORACLES["html_messages"] = build("select * exclude (top_message) from markup", "markup")
_r = "coalesce(cast(rank_integer as double), rank_decimal)"
cte("ranks", f"""select site_key, {_r} is not null as available, least(100, {jsround(f'case when {_r} <= 10 then {_r} * 10 else {_r} end')}) as domain_rank,
    case when {_r} is not null then case when status_code = 404 then 'Domain not in Open PageRank index — scored as 0 authority.' else 'Domain authority from Open PageRank (free API).' end
      else coalesce(nullif(error, ''), 'No PageRank data returned for this domain.') end as message from authority""", "authority")  # fmt: skip
# LEAST ignores nulls here, so a missing rank has to be kept apart.
cte("rank", "select site_key, available, case when available then domain_rank end as domain_rank, message from ranks", "ranks")
ORACLES["authority"] = build("select *, coalesce(domain_rank, 50) as score from rank", "rank")
_flag = lambda m: f"c_custkey % {m} = 0"
cte("headers", f"""select site_key, {HEADER_GRADE} as grade, score, n_failed, failed, available from (select *, true as available, cast(floor((6 - n_failed) / 6.0 * 100 + 0.5) as bigint) as score from (
    select *, len(failed) as n_failed from (select site_key, list_filter({HEADER_NAMES}, lambda n, i: not tests[i]) as failed from (
      select concat('c', c_custkey, '.example.com') as site_key, {header_tests('is_https')} as tests from (
        select c_custkey, c_custkey % 5 <> 0 as is_https, {_flag(2)} as hsts, {_flag(3)} as csp, {_flag(4)} as x_content_type, {_flag(5)} as x_frame_options,
          {_flag(6)} as referrer_policy, {_flag(7)} as permissions_policy from customer)))))""")  # fmt: skip
_FAILED_TEXT = {
    "strict-transport-security": "HSTS header not set", "content-security-policy": "CSP header not set",
    "x-frame-options": "No X-Frame-Options or CSP frame protection", "x-content-type-options": "X-Content-Type-Options missing",
    "referrer-policy": "Referrer-Policy header missing", "permissions-policy": "Permissions-Policy header missing",
}
_ft = lambda n: f"case {n} " + " ".join(f"when '{k}' then '{v}'" for k, v in _FAILED_TEXT.items()) + " end"
# A passing HSTS header on a plain HTTP site still fails the test with the passed text.
_hsts_set = "cast(substr(split_part(site_key, '.', 1), 2) as bigint) % 2 = 0"
_ftx = lambda n: f"case when {n} = 'strict-transport-security' and {_hsts_set} then 'Strict-Transport-Security header set' else {_ft(n)} end"
GRADE_SCORE = "case grade " + " ".join(f"when '{g}' then {s}" for g, s in dims.HEADER_GRADE_SCORES.items()) + " else 60 end"


def _ext(table: str, key: str, when: str, severity: str, *values: str, **more) -> str:
    return rule_select(f"({table} join sites using (site_key))", 0, key, when, severity, EXTERNAL_TEXTS[key], values, url="base_url", columns="site_key", **more)


_bad = "('POOR', 'NEEDS_IMPROVEMENT')"
_secs = fixed("coalesce(lcp_p75, 0) / 1000", 1)
_EXTERNAL = [
    _ext("field", "crux-no-data", "not available", "notice"),
    _ext("field", "crux-lcp-poor", "available and lcp_rating = 'POOR'", "critical", _secs),
    _ext("field", "crux-lcp-needs-improvement", "available and lcp_rating = 'NEEDS_IMPROVEMENT'", "warning", _secs),
    _ext("field", "crux-cls", f"available and cls_rating in {_bad}", either("cls_rating = 'POOR'", "critical", "warning"), fixed("cls_p75", 3), "lower(replace(cls_rating, '_', ' '))"),
    _ext("field", "crux-inp", f"available and inp_rating in {_bad}", either("inp_rating = 'POOR'", "warning", "notice"), "cast(inp_p75 as bigint)"),
    _ext("headers", "observatory-unavailable", "not available", "notice", q(SCAN_MESSAGE)),
    _ext("headers", "observatory-grade-low", f"{GRADE_SCORE} < 70", either(f"{GRADE_SCORE} < 50", "warning", "notice"), "score", "n_failed", title_values=("grade",)),
    *[_ext("headers", "observatory-", f"n_failed >= {i}", "notice", _ftx(f"failed[{i}]"), title_values=(f"replace(failed[{i}], '-', ' ')",), key_value=f"failed[{i}]") for i in range(1, 5)],
    _ext("threat", "safe-browsing-unavailable", "not available", "notice", f"coalesce(message, {q(THREAT_MESSAGE)})"),
    _ext("threat", "safe-browsing-threat", "available and not safe", "critical", "replace(threats, '|', ', ')"),
    _ext("dns", "dns-no-spf", "not has_spf", "notice", "site_key"),
    _ext("dns", "dns-no-dmarc", "not has_dmarc", "notice", "site_key"),
    _ext("dns", "dns-dmarc-none", "has_dmarc and dmarc_policy = 'none'", "notice"),
    _ext("dns", "dns-no-mx", "not has_mx", "notice", "site_key"),
    _ext("dns", "dns-no-ipv6", "not has_ipv6", "notice"),
    _ext("markup", "w3c-html-errors", "error_count + warning_count > 0", either("error_count > 5", "warning", "notice"), "error_count", "warning_count", f"coalesce(top_message, {q(HTML_MESSAGE)})",
         title_values=(either("error_count > 0", HTML_ERRORS_TITLE, HTML_WARNINGS_TITLE),)),
    _ext("rank", "backlinks-not-configured", "not available", "notice", f"coalesce(message, {q(AUTHORITY_MESSAGE)})"),
    _ext("rank", "weak-link-profile", "domain_rank < 15", "critical", "domain_rank"),
    _ext("rank", "low-domain-authority", "domain_rank between 15 and 34", "warning", "domain_rank"),
]
cte("external_issues", " union all ".join(_EXTERNAL), "field", "headers", "threat", "dns", "markup", "rank", "sites")
ORACLES["external_findings"] = build(
    "select site_key, issue_key, category, severity, title, description, affected_url from external_issues", "external_issues")

# --- refresh ----------------------------------------------------------------------

_key = "case when ends_with(site_key, '7.example.com') then null else issue_key end"
cte("stored_issues", f"""select site_key, {_key} as issue_key, severity, title, affected_url from external_issues
    union all select site_key, {_key}, severity, title, affected_url from lab_issues""", "external_issues", "lab_issues")  # fmt: skip
_dns_old = "case when issue_key is not null then starts_with(issue_key, 'dns-') else regexp_matches(title, '(?i)spf|dmarc|mx record|ipv6') end"
cte("new_dns", """select site_key, has_dmarc, dmarc_policy, has_ipv6, not has_spf as has_spf, base_url from dns join sites using (site_key)""", "dns", "sites")


def _new(key: str, when: str) -> str:
    return f"select site_key, '{key}', 'notice', {q(EXTERNAL_TEXTS[key].title)}, base_url from new_dns where {when}"


ORACLES["refresh_slice"] = build(
    f"select site_key, issue_key, severity, title, affected_url from stored_issues where not ({_dns_old}) union all "
    + " union all ".join([_new("dns-no-spf", "not has_spf"), _new("dns-no-dmarc", "not has_dmarc"), _new("dns-dmarc-none", "has_dmarc and dmarc_policy = 'none'"),
                          _new("dns-no-mx", "true"), _new("dns-no-ipv6", "not has_ipv6")]), "stored_issues", "new_dns")
ORACLES["refresh_vitals"] = build(
    """select site_key, issue_key, severity, title from stored_issues where not (case when issue_key is not null then regexp_matches(issue_key, '^(crux-|pagespeed-|cwv-|lh-)')
    else regexp_matches(title, '(?i)PageSpeed|CrUX|LCP|CLS|INP|Lighthouse|Core Web Vitals') end)""", "stored_issues")  # fmt: skip
cte("refreshed_issues", f"""select cast(regexp_extract(site_key, '^c([0-9]+)', 1) as bigint) as audit_id, * from (
    select site_key, issue_key, severity, title, affected_url from stored_issues
      where cast(regexp_extract(site_key, '^c([0-9]+)', 1) as bigint) % 4 <> 0 or not ({_dns_old})
    union all select * from (""" + " union all ".join([
        _new("dns-no-spf", "not has_spf"), _new("dns-no-dmarc", "not has_dmarc"), _new("dns-dmarc-none", "has_dmarc and dmarc_policy = 'none'"),
        _new("dns-no-mx", "true"), _new("dns-no-ipv6", "not has_ipv6")]) + """) where cast(regexp_extract(site_key, '^c([0-9]+)', 1) as bigint) % 4 = 0)""",
    "stored_issues", "new_dns")
_worst = "min(case severity when 'critical' then 1 when 'warning' then 2 else 3 end)"
cte("refreshed_totals", f"""select audit_id, sum(n)::bigint as total_issues, count(*) filter (worst = 1) as critical_count,
      count(*) filter (worst = 2) as warning_count, count(*) filter (worst = 3) as notice_count
    from (select audit_id, coalesce(issue_key, title) as k, count(*) as n, {_worst} as worst from refreshed_issues where audit_id % 4 = 0 group by 1, 2)
    group by 1""", "refreshed_issues")  # fmt: skip
ORACLES["refresh_stored_audits"] = build(
    """select audit_id, site_key, issue_key, severity, title, case when affected_url = base_url then audit_id * 10 end as page_id,
      total_issues, critical_count, warning_count, notice_count
    from refreshed_issues join sites using (site_key) left join refreshed_totals using (audit_id)""",
    "refreshed_issues", "refreshed_totals", "sites")
