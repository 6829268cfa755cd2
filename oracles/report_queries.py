"""Oracles of scores, reports, recommendations, usage, payments and streams."""

from __future__ import annotations

from siteglass import dims
from siteglass.operators.recommend import (
    DEVELOPER_NOTES, HOW_TO_FIX, PLAN_FALLBACK, REQUEST_HEAD, REQUEST_LINE, SUMMARY_FALLBACK, WHY_IT_MATTERS,
)
from siteglass.operators.rule_texts import SITE_TEXTS
from siteglass.plans.catalog import PAID_TODAY, TODAY

from .base import build, cte, fill, fixed, jsround, q, trimmed
from .page_queries import HEADER_GRADE, HEADER_NAMES, RANK, groups_sql, header_tests
from .site_queries import GRADE_SCORE, _ftx, site_rules

ORACLES: dict[str, str] = {}

# --- scores -----------------------------------------------------------------------

# One row per page with its home rank; the home page is rank 1 of its site.
cte("scored_pages", """select *, row_number() over (partition by site_key order by case when is_homepage then 0 else 1 end, page_id) as home_rank,
    row_number() over (partition by site_key order by page_id) as first_rank,
    case when title is null then 0 when length(title) between 10 and 70 then 100 when length(title) between 5 and 9 then 75 when length(title) between 71 and 90 then 85 else 60 end as ts,
    case when length(meta_description) >= 70 then 100 when length(meta_description) >= 30 then 80 when og_description is not null or og_title is not null then 70 else 0 end as ms,
    case when h1_count = 1 then 100 when h1_count = 0 then case when is_homepage and title is not null then 55 when title is not null then 40 else 0 end when h1_count = 2 then 70 else 50 end as hs,
    not is_homepage and word_count > 250 as is_content, has_linkedin_link or has_facebook_link or has_instagram_link or has_youtube_link as profiles from s_sig""", "s_sig")  # fmt: skip
cte("norm_pages", r"""select *, regexp_replace(regexp_replace(url, '#.*', ''), '^(https?://[^/?]+/[^?]+)/(\?|\z)', '\1\2') as n from s_sig""", "s_sig")
cte("orphan_counts", """select site_key, count(*) as orphans from (select distinct site_key, n, is_homepage from norm_pages) a
    where not is_homepage and (select count(*) from s_sig c where c.site_key = a.site_key) > 1
    and not exists (select 1 from norm_pages b where b.site_key = a.site_key and b.n <> a.n and list_contains(b.targets, a.n)) group by 1""", "norm_pages", "s_sig")  # fmt: skip
cte("dup_counts", """select site_key, count(*) as dups from (select site_key, lower(trim(title)) from s_sig where title is not null group by 1, 2 having count(*) > 1) group by 1""", "s_sig")


def _agg_blend(flag: str, w: float) -> str:
    home = f"(bool_or({flag}) filter (home_rank = 1))::int * 100"
    others = f"case when count(*) > 1 then (count(*) filter (home_rank > 1 and {flag}))::double / (count(*) - 1) * 100 else 100.0::double end"
    return jsround(f"{home} * {w}::double + ({others}) * (1.0::double - {w}::double)")


def _agg_score(col: str, w: float, v: float) -> str:
    others = f"case when count(*) > 1 then (sum({col}) filter (home_rank > 1))::double / (count(*) - 1) else 100.0::double end"
    return jsround(f"(max({col}) filter (home_rank = 1)) * {w}::double + ({others}) * {v}::double")


_home = lambda e: f"(any_value({e}) filter (home_rank = 1))"
cte("facts", f"""select site_key, count(*) as n, {_home('is_https')} as h_https, {_home('status_code')} as h_status, any_value(spa) filter (first_rank = 1) as first_spa,
    any_value(is_https) filter (first_rank = 1) as first_https,
    {_home('hsts')} as hsts, {_home('csp')} as csp, {_home('x_content_type')} as x_content_type, {_home('x_frame_options')} as x_frame_options,
    {_home('referrer_policy')} as referrer_policy, {_home('permissions_policy')} as permissions_policy,
    {_agg_score('ts', 0.65, 0.35)} as title, {_agg_score('ms', 0.65, 0.35)} as meta, {_agg_score('hs', 0.6, 0.4)} as h1,
    {_agg_blend('canonical is not null', 0.7)} as canonical, {_home('is_indexable')} as h_index, {_home('has_schema')} as h_schema,
    count(*) filter (has_schema) as n_schema, count(*) filter (has_schema and schema_valid) as n_valid, bool_or(mixed_content) as any_mixed,
    count(*) filter (is_content) as nc, count(*) filter (is_content and h2_count > 0) as nc_h2, count(*) filter (is_content and internal_links >= 3) as nc_linked,
    coalesce(sum(least(internal_links, 15)) filter (is_content), 0) as nc_links, count(*) filter (status_code < 400) as nr,
    count(*) filter (status_code < 400 and internal_links >= 3) as nr_linked, coalesce(sum(least(internal_links, 15)) filter (status_code < 400), 0) as nr_links,
    count(*) filter (status_code > 0 and status_code < 400) as n_ok, count(*) filter (generic_link_count > 0) as n_generic,
    {_agg_blend('has_viewport', 0.75)} as viewport, {_agg_blend('has_lang', 0.7)} as lang, {_agg_blend('has_favicon', 0.8)} as favicon,
    avg(images_without_alt) filter (images_without_alt > 0) as alt_mean, bool_or(has_flash) as any_flash, count(*) filter (iframe_count > 3) as n_iframes,
    {_home('load_time_ms')} as h_load, {_home('compression is not null')} as h_comp, {_home('html_size_bytes')} as h_bytes,
    {_agg_blend('has_social_tags', 0.8)} as og, {_agg_blend('og_image is not null', 0.8)} as og_image, {_agg_blend('has_twitter_card', 0.75)} as twitter,
    {_home('profiles')} as h_profiles, count(*) filter (has_social_tags) as n_og from scored_pages group by 1""", "scored_pages")  # fmt: skip
# One scored site per customer: the facts of the site that has the page with the customer's number.
cte("page_sites", """select s.site_key as customer_key, q.site_key as page_site from sites s join s_sig q
    on q.page_id = cast(regexp_extract(s.site_key, '^c([0-9]+)', 1) as bigint) % (select count(*) from s_sig)""", "sites", "s_sig")  # fmt: skip
cte("customer_facts", """select f.* replace (customer_key as site_key), page_site, coalesce(o.orphans, 0) as orphans, coalesce(d.dups, 0) as dups, n % 5 as broken, n % 8 as moved,
    p.https_enforced, p.canonicalized or not p.www_resolves or not p.apex_resolves as www_ok, p.site_key is not null as has_probe,
    l.performance_score, l.accessibility_score, l.best_practices_score, l.seo_score, l.lcp_ms, l.cls, l.inp_ms,
    fd.available as field_ok, fd.lcp_rating, fd.cls_rating, fd.inp_rating, h.grade as scan_grade, dn.email_auth_score, m.valid as html_valid, m.error_count, r.domain_rank
    from page_sites join facts f on f.site_key = page_site left join orphan_counts o on o.site_key = page_site left join dup_counts d on d.site_key = page_site
    left join probes p on p.site_key = customer_key left join best_run l on l.site_key = customer_key
    left join field fd on fd.site_key = customer_key left join headers h on h.site_key = customer_key and h.n_failed < 5
    left join dns dn on dn.site_key = customer_key left join markup m on m.site_key = customer_key
    left join rank r on r.site_key = customer_key""",
    "page_sites", "facts", "orphan_counts", "dup_counts", "probes", "best_run", "field", "headers", "dns", "markup", "rank")


def steps(x: str, *pairs: tuple[float, int], low: int) -> str:
    return "case " + " ".join(f"when {x} <= {b}::double then {s}" for b, s in pairs) + f" else {low} end"


def nul(x: str, default: int, body: str) -> str:
    return f"case when {x} is null then {default} else {body} end"


_local = f"({jsround('((hsts and h_https)::int + x_content_type::int + (x_frame_options or csp)::int + referrer_policy::int) / 4.0 * 100')})"
_scan = GRADE_SCORE.replace("case grade", "case scan_grade")
_rates = "[lcp_rating, cls_rating, inp_rating]"
_tally = lambda r: f"len(list_filter({_rates}, lambda x: x = '{r}'))"
_pick = lambda a, b: f"(case when nc > 0 then {a} else {b} end)"
_nsample = _pick("nc", "nr")
_avg = f"least(100, {jsround(f'{_pick('nc_links', 'nr_links')} / {_nsample} / 8 * 100')})"
_CHECKS = [
    ("ssl", "onpage", 12, "case when h_https then 100 else 0 end"),
    ("title", "onpage", 14, "title"), ("meta-description", "onpage", 10, "meta"), ("h1", "onpage", 10, "h1"),
    ("canonical", "onpage", 8, "canonical"), ("indexable", "onpage", 10, "case when h_index then 100 else 0 end"),
    ("robots-txt", "onpage", 8, "case when n % 2 = 0 then 100 else 40 end"), ("sitemap", "onpage", 8, "case when n % 3 = 0 then 100 else 50 end"),
    ("schema", "onpage", 6, f"case when h_schema then {jsround('60 + n_valid / n_schema * 40')} else 30 end"),
    ("https-redirect", "onpage", 6, "case when https_enforced then 100 else 40 end"),
    ("www-canonical", "onpage", 4, "case when www_ok or not has_probe then 100 else 50 end"),
    ("mixed-content", "onpage", 4, "case when any_mixed then 30 else 100 end"), ("lighthouse-seo", "onpage", 18, "coalesce(seo_score, 70)"),
    ("duplicate-titles", "onpage", 6, "case dups when 0 then 100 when 1 then 70 else 40 end"),
    ("heading-structure", "onpage", 6, f"case when nc = 0 then 100 else {jsround('nc_h2 / nc * 100')} end"),
    ("crawlable-pages", "onpage", 8, jsround("n_ok / n * 100")),
    ("broken-links", "onpage", 10, steps("broken", (0, 100), (1, 60), (3, 35), low=10)),
    ("redirect-links", "onpage", 6, steps("moved", (0, 100), (2, 70), (5, 45), low=20)),
    ("internal-linking", "onpage", 8, f"case when {_nsample} = 0 then 50 else {jsround(f'{_pick('nc_linked', 'nr_linked')} / {_nsample} * 100 * 0.55::double + {_avg} * 0.45::double')} end"),
    ("orphan-pages", "onpage", 6, "case when n <= 1 or orphans = 0 then 100 else " + steps("orphans / n", (0.2, 75), (0.4, 50), low=25) + " end"),
    ("friendly-anchors", "onpage", 4, jsround("(1 - n_generic / n) * 100")),
    ("referring-domains", "links", 40, "coalesce(domain_rank, 50)"), ("domain-authority", "links", 35, "coalesce(domain_rank, 50)"),
    ("backlink-volume", "links", 25, "coalesce(domain_rank, 50)"),
    ("viewport", "usability", 18, "viewport"), ("lang", "usability", 12, "lang"), ("favicon", "usability", 8, "favicon"),
    ("alt-text", "usability", 14, nul("alt_mean", 100, steps("alt_mean", (1, 85), (3, 65), low=40))),
    ("no-flash", "usability", 6, "case when any_flash then 0 else 100 end"), ("iframes", "usability", 6, jsround("(1 - n_iframes / n) * 100")),
    ("security-headers", "usability", 10, f"case when scan_grade is not null then {_scan} else {_local} end"),
    ("email-auth", "onpage", 5, "coalesce(email_auth_score, 70)"),
    ("html-validity", "onpage", 5, nul("html_valid", 75, "case when html_valid then 100 else " + steps("error_count", (2, 80), (5, 60), low=40) + " end")),
    ("lighthouse-accessibility", "usability", 25, "coalesce(accessibility_score, 70)"), ("lighthouse-best-practices", "usability", 15, "coalesce(best_practices_score, 70)"),
    ("load-time", "performance", 8, "case when h_load <= 0 then 70 else " + steps("h_load", (1500, 100), (2500, 85), (3500, 65), (5000, 45), low=25) + " end"),
    ("compression", "performance", 5, "case when h_comp then 100 else 60 end"),
    ("page-size", "performance", 5, steps("h_bytes / 1024", (200, 100), (500, 85), (1000, 65), low=40)),
    ("lighthouse-performance", "performance", 40, "coalesce(performance_score, 70)"),
    ("cwv-lcp", "performance", 12, nul("nullif(lcp_ms, 0)", 70, steps("lcp_ms", (2500, 100), (4000, 60), low=30))),
    ("cwv-cls", "performance", 8, nul("cls", 70, steps("cls", (0.1, 100), (0.25, 60), low=25))),
    ("cwv-inp", "performance", 6, nul("nullif(inp_ms, 0)", 70, steps("inp_ms", (200, 100), (500, 60), low=30))),
    ("crux-field-data", "performance", 15, f"""case when not coalesce(field_ok, false) then 70 when {_tally('POOR')} >= 2 then 35 when {_tally('POOR')} = 1 then 55
      when {_tally('NEEDS_IMPROVEMENT')} >= 2 then 65 when {_tally('NEEDS_IMPROVEMENT')} = 1 then 80 when {_tally('GOOD')} = 3 then 100 else 75 end"""),
    ("open-graph", "social", 25, "og"), ("og-image", "social", 15, "og_image"), ("twitter-card", "social", 15, "twitter"),
    ("social-profiles", "social", 10, "case when h_profiles then 100 else 55 end"), ("og-coverage", "social", 15, jsround("n_og / n * 100")),
]


def _check_rows(source: str, security: str | None = None) -> str:
    rows = []
    for cid, cat, weight, score in _CHECKS:
        if cid == "security-headers" and security:
            score = security
        rows.append(f"select site_key, '{cid}' as check_id, '{cat}' as category, {weight} as weight, cast({score} as bigint) as score from {source}")
    return " union all ".join(rows)


def _category_rows(checks: str, source: str) -> str:
    """Floors and rounding on top of the weighted means."""
    return f"""select *, {jsround('(onpage + links + usability + performance + social) / 5')} as overall_score from (
      select site_key, {", ".join(f"max(s) filter (category = '{c}') as {c}" for c in dims.CATEGORIES)} from (
        select w.site_key, category, cast(floor(least(100, greatest(0, case
          when category = 'onpage' and first_spa then greatest(w, 60) when category in ('onpage', 'links') then w
          when category = 'social' and first_spa then greatest(w, 60)
          when not (h_status >= 500 or not h_https) then greatest(w, 25) else w end)) + 0.5) as bigint) as s
        from (select site_key, category, sum(score * weight)::double / sum(weight) as w from {checks} group by 1, 2) w join {source} f using (site_key)) group by 1)"""  # fmt: skip


cte("check_rows", _check_rows("customer_facts"), "customer_facts")
ORACLES["check_scores"] = build("select site_key, check_id, category, weight, score from check_rows", "check_rows")
ORACLES["weighted_scores"] = build(
    "select site_key, category, round(sum(score * weight)::double / sum(weight), 6) as weighted from check_rows group by 1, 2", "check_rows")
ORACLES["category_scores"] = build(_category_rows("check_rows", "customer_facts"), "check_rows", "customer_facts")
cte("home_scan", f"""select *, cast(floor((6 - n_failed) / 6.0 * 100 + 0.5) as bigint) as score from (select *, len(failed) as n_failed from (
    select *, list_filter({HEADER_NAMES}, lambda x, i: not tests[i]) as failed from (select *, {header_tests('h_https')} as tests from facts)))""", "facts")  # fmt: skip
ORACLES["home_header_grade"] = build(f"select site_key, {HEADER_GRADE} as grade, score from home_scan", "home_scan")
# The refreshed scan lost its first failed test, so that test now passes.
cte("refreshed", """select f.* exclude (h_https, hsts, csp, x_content_type, x_frame_options, referrer_policy, permissions_policy, scan_grade),
    f.first_https as h_https, not list_contains(k, 'strict-transport-security') as hsts, not list_contains(k, 'content-security-policy') as csp,
    not list_contains(k, 'x-content-type-options') as x_content_type, not list_contains(k, 'x-frame-options') as x_frame_options,
    not list_contains(k, 'referrer-policy') as referrer_policy, not list_contains(k, 'permissions-policy') as permissions_policy, null as scan_grade
    from customer_facts f join (select site_key as page_site, failed[2:] as k from home_scan) s using (page_site)""", "customer_facts", "home_scan")  # fmt: skip
cte("refreshed_rows", _check_rows("refreshed", _local), "refreshed")
ORACLES["refresh_scores"] = build(_category_rows("refreshed_rows", "refreshed"), "refreshed_rows", "refreshed")

# --- reports ----------------------------------------------------------------------

cte("saved_issues", """select * replace (case rule_seq when 13 then 'schema' when 19 then 'accessibility' when 12 then 'made-up' else category end as category,
    case when rule_seq % 5 <> 0 then page_id end as page_id, case when rule_seq % 15 <> 0 then affected_url end as affected_url),
    length(site_key) as audit_id, page_id * 100 + rule_seq as issue_id, case when page_id % 3 = 1 then concat('advice ', page_id) end as ai from issues""", "issues")  # fmt: skip
_category = "case category " + " ".join(f"when '{k}' then '{v}'" for k, v in dims.LEGACY_CATEGORIES.items()) + " else 'onpage' end"
ORACLES["report_groups"] = build(
    f"""select cast(audit_id as varchar) as site_key, {_category} as category, lower(trim(title)) as title_key,
    case min({RANK}) when 0 then 'critical' when 1 then 'warning' else 'notice' end as severity, arg_min(title, issue_id) as title,
    arg_min(description, issue_id) as description, arg_min(ai, issue_id) filter (ai is not null) as ai_recommendation,
    count(distinct affected_url) as url_count, count(*) as count from saved_issues group by audit_id, {_category}, lower(trim(title))""", "saved_issues")  # fmt: skip
cte("by_url", "select length(site_key) as audit_id, url, max(page_id) as page_id from s_sig group by 1, 2", "s_sig")
ORACLES["attach_page_id"] = build(
    "select i.issue_id, u.page_id from saved_issues i left join by_url u on u.audit_id = i.audit_id and u.url = i.affected_url", "saved_issues", "by_url")
ORACLES["issues_with_page"] = build(
    """select i.issue_id, p.url as page_url, p.title as page_title, p.word_count as page_word_count from saved_issues i left join s_sig p using (page_id)""", "saved_issues", "s_sig")  # fmt: skip
ORACLES["pages_with_serious_issue"] = build(
    """select length(site_key) as audit_id, page_id from s_sig p where exists (select 1 from saved_issues i where i.page_id = p.page_id and severity <> 'notice')
    qualify row_number() over (partition by length(site_key) order by page_id) <= 5""", "s_sig", "saved_issues")  # fmt: skip
ORACLES["page_issue_lists"] = build(
    """select page_id, row_number() over (partition by page_id order by issue_id) as position, title, severity from (
    select coalesce(i.page_id, u.page_id) as page_id, issue_id, title, severity from saved_issues i left join by_url u on u.audit_id = i.audit_id and u.url = i.affected_url)
    where page_id is not null""", "saved_issues", "by_url")  # fmt: skip
ORACLES["issue_count_per_page"] = build(
    "select p.page_id, count(i.issue_id) as issue_count from s_sig p left join saved_issues i using (page_id) group by 1", "s_sig", "saved_issues")
ORACLES["audit_children"] = build(
    """select length(site_key) as audit_id, 'page' as child, row_number() over (partition by length(site_key) order by page_id) as position, page_id as child_id, url as label from s_sig
    union all select audit_id, 'issue', row_number() over (partition by audit_id order by severity, issue_id), issue_id, title from saved_issues""", "s_sig", "saved_issues")  # fmt: skip
ORACLES["compact_summary"] = build(
    """select a.audit_id, coalesce(t, '') as top_problems from (select distinct length(site_key) as audit_id from s_sig) a left join (
    select audit_id, string_agg(concat(title, ':', severity, ':', category), '|' order by issue_id) as t from (select * from saved_issues where severity <> 'notice'
      qualify row_number() over (partition by audit_id order by issue_id) <= 8) group by 1) b using (audit_id)""", "s_sig", "saved_issues")  # fmt: skip
_g = "overall_score"
_grade = "case " + " ".join(f"when {_g} >= {b} then '{g}'" for b, g in dims.REPORT_GRADES) + " else 'F' end"


def _verdict(i: int) -> str:
    v = dims.VERDICTS
    return f"case left({_grade}, 1) when 'A' then {q(v['A'][i])} when 'B' then {q(v['B'][i])} when 'C' then {q(v['C'][i])} else {q(v[''][i])} end"


ORACLES["report_summary"] = build(
    f"""select a.audit_id, url, domain, overall_score, {_grade} as overall_grade, {_verdict(0)} as verdict_title, {_verdict(1)} as verdict_text,
    overall_score as onpage_score, pages_crawled as links_score, 100 as usability_score, 100 as performance_score, 100 as social_score,
    coalesce(c, 0) as critical_count, coalesce(w, 0) as warning_count, coalesce(n, 0) as notice_count, coalesce(t, 0) as total_unique, pages_crawled
    from customer_audits a left join (select audit_id, count(*) filter (status = 'captured') as c, count(*) filter (status = 'failed') as w,
      count(*) filter (status = 'pending') as n, count(*) as t from payments group by 1) s using (audit_id)""", "customer_audits", "payments")  # fmt: skip
ORACLES["error_classes"] = build(
    """select case when trim(coalesce(error_message, '')) = '' then 'empty' when regexp_matches(error_message, '(?i)fetch failed|etimedout|network|timeout') then 'network'
    when regexp_matches(error_message, '(?i)prisma|invocation') or length(trim(error_message)) > 160 then 'technical' else 'showable' end as error_class, count(*) as audits
    from audit_history where status = 'failed' group by 1""", "audit_history")  # fmt: skip
_rated = lambda c: f"case when {c} <> 'UNKNOWN' then concat(' · ', replace({c}, '_', ' ')) else '' end"
_line = lambda table, block, pos, expr, where="true": f"select site_key, {q(block)} as block, {pos} as position, {expr} as line from {table} where {where}"
_have = lambda c: f"case when {c} then 'Present' else 'Missing' end"
_tech = [
    _line("rank", "Link Authority (Open PageRank)", 1, "concat('Domain authority: ', domain_rank, '/100')", "available"),
    _line("rank", "Link Authority (Open PageRank)", "case when available then 2 else 1 end", "message"),
    _line("field", "Core Web Vitals & Lighthouse", 1, f"concat('LCP (field): ', coalesce({fixed('nullif(lcp_p75, 0) / 1000', 1)} || 's', '—'), {_rated('lcp_rating')})", "available"),
    _line("field", "Core Web Vitals & Lighthouse", 2, f"concat('CLS (field): ', coalesce({fixed('cls_p75', 3)}, '—'), {_rated('cls_rating')})", "available"),
    _line("field", "Core Web Vitals & Lighthouse", 3, f"concat('INP (field): ', coalesce(cast(nullif(inp_p75, 0) as bigint) || 'ms', '—'), {_rated('inp_rating')})", "available"),
    _line("field", "Core Web Vitals & Lighthouse", 1, q("No Chrome UX Report data yet — site needs more real-user traffic for field metrics."), "not available"),
    *[_line("best_run", "Core Web Vitals & Lighthouse", 4 + i, f"concat('Lighthouse {label}: ', {col}, '/100')") for i, (label, col) in enumerate((
        ("performance", "performance_score"), ("accessibility", "accessibility_score"), ("best practices", "best_practices_score"), ("SEO", "seo_score")))],
    _line("headers", "Security Headers", 1, "concat('Security grade: ', grade, ' (', score, '/100)')"),
    _line("headers", "Security Headers", 2, "concat(6 - n_failed, ' passed · ', n_failed, ' failed')"),
    _line("headers", "Security Headers", 3, "'Source: local scan'"),
    *[_line("headers", "Security Headers", 3 + i, f"concat('• ', {_ftx(f'failed[{i}]')})", f"n_failed >= {i}") for i in range(1, 7)],
    _line("headers", "Security Headers", "4 + n_failed", q("MDN Observatory unavailable — graded from headers captured during crawl.")),
    _line("threat", "Google Safe Browsing", 1, "case when safe then 'Not on Google''s threat lists' else concat('Flagged: ', replace(threats, '|', ', ')) end", "available"),
    _line("(threat join sites using (site_key))", "Google Safe Browsing", 2, "concat('URL checked: ', base_url)", "available"),
    _line("threat", "Google Safe Browsing", 3, "concat('Threat types found: ', case n when 0 then 'None' else cast(n as varchar) end)", "available"),
    _line("threat", "Google Safe Browsing", 1, "message", "not available and message is not null"),
    _line("dns", "Email & DNS", 1, f"concat('SPF: ', {_have('has_spf')})"),
    _line("dns", "Email & DNS", 2, f"concat('DMARC: ', {_have('has_dmarc')}, coalesce(' (p=' || dmarc_policy || ')', ''))"),
    _line("dns", "Email & DNS", 3, f"concat('MX: ', {_have('has_mx')})"), _line("dns", "Email & DNS", 4, f"concat('IPv6: ', {_have('has_ipv6')})"),
    _line("dns", "Email & DNS", 5, "concat('Email auth score: ', email_auth_score, '/100')"),
    _line("markup", "HTML Validation (W3C)", 1, "case when valid then 'Valid markup' else concat(error_count, ' error(s)') end"),
    _line("markup", "HTML Validation (W3C)", 2, "concat(warning_count, ' warning(s)')"),
    """select site_key, 'HTML Validation (W3C)', 2 + k, concat(case when last_line <> 0 then concat('Line ', last_line, ': ') else '' end, coalesce(message, 'Validation issue')) from (
      select *, row_number() over (partition by site_key order by pos) as k from html_messages where type in ('error', 'warning')) where k <= 6""",
]
ORACLES["technical_lines"] = build(" union all ".join(_tech), "rank", "field", "best_run", "headers", "threat", "dns", "markup", "sites", "html_messages")
ORACLES["delete_audits"] = build("select domain, count(*) as audits from audit_history where status <> 'failed' group by 1", "audit_history")
ORACLES["reset_audits"] = build(
    """select audit_id, case when overall_score < 50 then 'running' else 'completed' end as status, case when overall_score < 50 then 0 else overall_score end as overall_score,
    case when overall_score < 50 then 0 else pages_crawled end as pages_crawled from customer_audits""", "customer_audits")  # fmt: skip

# --- recommendations --------------------------------------------------------------

ORACLES["fallback_recommendations"] = build(
    """select issue_id, concat('Fix: ', title) as title, description as summary, recommendation as how_to_fix, 'medium' as priority, 'moderate' as effort,
    recommendation as example_fix from saved_issues""", "saved_issues")  # fmt: skip


def _batches(limit: int) -> str:
    return f"""select *, cast(floor((r - 1) / 8) as bigint) as batch_no, (r - 1) % 8 as idx from (
      select *, row_number() over (partition by audit_id order by {RANK}, issue_id) as r from saved_issues where severity <> 'notice') where r <= {limit}"""  # fmt: skip


ORACLES["request_batches"] = build(f"select audit_id, batch_no, idx, issue_id from ({_batches(20)})", "saved_issues")
cte("batches", _batches(8), "saved_issues")
_req = fill("[%s] " + REQUEST_LINE.replace("%d", "%s"), "idx", "coalesce(p.url, b.affected_url, 'the site')", "b.title", "b.severity", "b.category",
            "b.description", "coalesce(b.recommendation, 'none')", "coalesce(p.title, 'none')", "coalesce(p.word_count, 0)", "coalesce(p.h1_count, 0)")
ORACLES["enrichment_requests"] = build(
    f"""select audit_id, batch_no, count(*) as issues, concat({q(REQUEST_HEAD.replace('%s', 'the site'))}, string_agg({_req}, {q(chr(10) + chr(10))} order by idx)) as request
    from batches b left join s_sig p on p.page_id = b.page_id group by 1, 2""", "batches", "s_sig")  # fmt: skip
# Batches of more than three findings fail and are halved; a critical finding alone fails too.
ORACLES["answered_requests"] = build(
    """select issue_id, case when n = 1 and severity = 'critical' then concat('Fix: ', title) else concat(idx - start + 1, ' of ', n) end as title
    from (with recursive halves as (
        select audit_id, batch_no, cast(0 as bigint) as start, count(*) as n from batches group by 1, 2
        union all
        select audit_id, batch_no, case when part = 0 then start else start + (n + 1) // 2 end, case when part = 0 then (n + 1) // 2 else n // 2 end
        from halves, (values (0), (1)) t(part) where n > 3) select * from halves where n <= 3) h
    join batches b on b.audit_id = h.audit_id and b.batch_no = h.batch_no and b.idx >= start and b.idx < start + n""", "batches")  # fmt: skip
ORACLES["apply_enrichment"] = build(
    f"""select issue_id, case when answered and idx < 2 then concat('T', idx) else concat('Fix: ', title) end as title,
    case when answered and idx < 2 then 'W' else {q(WHY_IT_MATTERS)} end as why_it_matters, recommendation as how_to_fix,
    case when answered and idx < 2 then 'high' else 'medium' end as priority, 'medium' as impact,
    case when answered and idx < 2 then 'quick' else 'moderate' end as effort, case when answered and idx < 2 then 'tool' end as recommended_tool
    from (select *, audit_id % 4 < 3 as answered from batches)""", "batches")  # fmt: skip
_label = "case category " + " ".join(f"when '{k}' then '{v}'" for k, v in dims.CATEGORY_LABELS.items()) + " end"
ORACLES["category_recommendations"] = build(
    f"""select s.audit_id, s.category, {_label.replace('category', 's.category', 1)} as label, score, {fill('This category scored %s/100 with %s related issue(s).', 'score', 'coalesce(n, 0)')} as summary,
    case when score < 60 then 'high' when score < 80 then 'medium' else 'low' end as priority, coalesce(r, '') as recommendations from (
      select audit_id, category, (audit_id * 7 + i * 31) % 101 as score from (select distinct length(site_key) as audit_id from s_sig),
      (values (0, 'onpage'), (1, 'links'), (2, 'usability'), (3, 'performance'), (4, 'social')) c(i, category)) s left join (
      select audit_id, category, count(*) as n, string_agg(concat(title, ':', description, ':', case severity when 'critical' then 'high' else 'medium' end, ':moderate'), '|' order by issue_id) as r
      from (select * from saved_issues where severity <> 'notice' qualify row_number() over (partition by audit_id, category order by issue_id) <= 5) group by 1, 2) t
    on t.audit_id = s.audit_id and t.category = s.category""", "s_sig", "saved_issues")  # fmt: skip
ORACLES["page_summaries"] = build(
    f"""select i.page_id, p.url as page_url, {fill('This page has %s SEO issue(s) to address.', 'count(*)')} as summary,
    string_agg(i.title, '|' order by issue_id) filter (k <= 5) as problems, string_agg(i.description, '|' order by issue_id) filter (k <= 5) as fixes,
    case when bool_or(severity = 'critical') then 'high' else 'medium' end as priority
    from (select *, row_number() over (partition by page_id order by issue_id) as k from saved_issues where page_id is not null) i join s_sig p using (page_id) group by 1, 2""", "s_sig", "saved_issues")  # fmt: skip
_sf, _pf = SUMMARY_FALLBACK, PLAN_FALLBACK
ORACLES["overview_answers"] = f"""
select event_id, case when event_id % 4 = 0 then concat('H', event_id) else {q(_sf['headline'])} end as headline,
  case when event_id % 4 = 1 then 'O' else {q(_sf['summary'])} end as summary,
  case when event_id % 4 = 0 then 'a|3' else {q('|'.join(_sf['topStrengths']))} end as strengths,
  case when event_id % 4 = 0 then 'q' else {q('|'.join(_pf['quickWins']))} end as quick_wins, {q('|'.join(_pf['sevenDayPlan']))} as seven_days from events"""

# --- usage and payments -----------------------------------------------------------

ORACLES["usage_overview"] = build(
    f"""select count(*) as total_audits, count(distinct client_ip) as unique_ips, count(distinct domain) as unique_domains,
    count(*) filter (created_at >= timestamp '{TODAY}') as audits_today from audit_history""", "audit_history")  # fmt: skip
cte("clients", """select coalesce(client_ip, 'unknown') as ip, count(*) as audit_count, count(distinct domain) as unique_domains,
    array_to_string(list_sort(list(distinct domain))[1:8], '|') as domains, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') as first_seen,
    strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_seen from audit_history group by client_ip""", "audit_history")  # fmt: skip
ORACLES["ip_usage"] = build("select * from clients", "clients")
ORACLES["top_ips"] = build("select ip, audit_count, unique_domains from clients order by audit_count desc, ip limit 10", "clients")
_created = "strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at"
_newest = "order by audit_history.created_at desc, audit_id desc"
ORACLES["recent_audits"] = build(f"select audit_id, domain, client_ip, {_created} from audit_history {_newest} limit 25", "audit_history")
ORACLES["audits_page"] = build(f"select audit_id, domain, {_created} from audit_history {_newest} limit 40 offset 80", "audit_history")
ORACLES["audits_page_info"] = build(
    "select count(*) as total, 3 as page, 40 as page_size, cast(greatest(1, ceil(count(*) / 40)) as bigint) as total_pages from audit_history", "audit_history")
ORACLES["numbered_pages"] = build(
    f"""select audit_id, position, cast(floor((position - 1) / 25) as bigint) + 1 as page, (position - 1) % 25 + 1 as place
    from (select audit_id, row_number() over ({_newest}) as position from audit_history)""", "audit_history")  # fmt: skip
ORACLES["payment_stats"] = build(
    f"""select count(*) as total_payments, count(*) filter (status = 'captured') as captured_payments, cast(coalesce(sum(amount_paise) filter (status = 'captured'), 0) as bigint) as captured_paise,
    count(*) filter (status = 'pending') as pending_payments, count(*) filter (status = 'failed') as failed_payments,
    count(*) filter (paid_at >= timestamp '{PAID_TODAY}') as today_payments,
    cast(coalesce(sum(amount_paise) filter (paid_at >= timestamp '{PAID_TODAY}'), 0) as bigint) as today_paise from payments""", "payments")  # fmt: skip
ORACLES["recent_payments"] = build(
    f"""select payment_id, status, amount_paise, {_created} from payments where status = 'captured' order by payments.created_at desc, payment_id desc limit 10""", "payments")
ORACLES["payments_with_audit_url"] = build(
    "select payment_id, p.audit_id, a.url as audit_url from payments p left join customer_audits a using (audit_id)", "payments", "customer_audits")

# The ledger as segments between refunds.
cte("kinds", """select *, case when event in ('payment.captured', 'payment.authorized') then 'captured' when event = 'payment.failed' then 'failed'
    when event = 'refund.processed' then 'refunded' else 'other' end as kind from payment_events where order_id in (select order_id from payment_orders)""", "payment_events", "payment_orders")  # fmt: skip
cte("stretches", "select *, count(*) filter (kind = 'refunded') over (partition by order_id order by seq) as stretch from kinds", "kinds")
cte("applied", """select * from (select *, min(seq) filter (kind = 'captured') over (partition by order_id, stretch) as cap from stretches)
    where kind in ('refunded', 'other') or (kind = 'captured' and seq = cap) or (kind = 'failed' and (cap is null or seq < cap))""", "stretches")  # fmt: skip
_last = lambda c, w: f"arg_max({c}, seq) filter ({w})"
_paid = "kind in ('captured', 'failed')"
cte("ledger", f"""select o.order_id, coalesce(status, 'pending') as status, a.* exclude (order_id, status) from (select distinct order_id from payment_orders) o left join (
    select order_id, {_last('kind', "kind <> 'other'")} as status, {', '.join(_last(c, f'{_paid} and {c} is not null') + ' as ' + c for c in ('payment_id', 'email', 'contact', 'method'))},
      arg_max_null(error_code, seq) filter (kind = 'failed') as error_code, {_last("coalesce(error_description, 'Payment failed')", "kind = 'failed'")} as error_description,
      max(seq) filter (kind = 'captured') as paid_seq, {_last('event', 'true')} as last_event from applied group by 1) a using (order_id)""", "applied", "payment_orders")  # fmt: skip
ORACLES["payment_ledger"] = build("select * from ledger", "ledger")
ORACLES["payment_ledger_stream"] = build("select * from ledger", "ledger")
ORACLES["payment_status_stream"] = build(
    """select order_id, case when max(seq) filter (event in ('payment.captured', 'payment.authorized')) > r then 'captured' when max(seq) filter (event = 'payment.failed') > r then 'failed'
    when r >= 0 then 'refunded' else 'pending' end as status from payment_events join (
      select order_id, coalesce(max(seq) filter (event = 'refund.processed'), -1) as r from payment_events group by 1) using (order_id)
    where order_id in (select order_id from payment_orders) group by order_id, r""", "payment_events", "payment_orders")  # fmt: skip
cte("confirmed", "select *, first_value(order_id) over (partition by payment_id order by seq) as owner, min(seq) over (partition by payment_id) as first_seq from confirmations", "confirmations")
ORACLES["checkout_confirm"] = build(
    """select seq, order_id, payment_id, case when order_id <> owner then 'rejected' when seq = first_seq then 'recorded' else 'repeated' end as outcome from confirmed""", "confirmed")  # fmt: skip
ORACLES["checkout_outcome_stream"] = ORACLES["checkout_confirm"]
ORACLES["checkout_stream"] = build("select payment_id, arg_min(order_id, seq) as order_id from confirmations group by 1", "confirmations")
_found = lambda key, severity, url, *values: (
    f"select site_key, '{key}' as issue_key, '{severity}' as severity, {fill(SITE_TEXTS[key].description, *values)} as description, {url} as affected_url")
_same = lambda column: f"from s_sig where {column} is not null group by site_key, lower({trimmed(column)}) having count(*) > 1"
ORACLES["site_state_stream"] = build(
    "select site_key, issue_key, severity, description, affected_url from ("
    + site_rules("n as crawled, 'any' as robots, true as sitemap")
    + ") union all " + _found("dup-titles", "critical", "arg_min(url, page_id)", "count(*)") + " " + _same("title")
    + " union all " + _found("dup-metas", "warning", "arg_min(url, page_id)", "count(*)") + " " + _same("meta_description")
    + " union all " + _found("orphan-page", "warning", "url", "url")
    + """ from (select site_key, n, arg_max(url, page_id) as url, bool_or(is_homepage) as home from norm_pages group by 1, 2) a
    where not home and (select count(*) from s_sig b where b.site_key = a.site_key) > 1
    and not exists (select 1 from norm_pages b where b.site_key = a.site_key and b.n <> a.n and list_contains(b.targets, a.n))""",
    "linking", "norm_pages", "s_sig")
