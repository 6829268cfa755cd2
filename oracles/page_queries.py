"""Oracles of the page functions, signals, page rules and groups."""

from __future__ import annotations

from siteglass.operators.rule_texts import NOINDEX_BY_HEADER, NOINDEX_BY_META, PAGE_TEXTS

from .base import (
    build, cte, either, fill, fixed, jsround, percent, q, rule_select, rx, rx_replace, site_key,
    squashed, trimmed,
)

ORACLES: dict[str, str] = {}

_host = rx("lower(url)", "^https?://([^/?#]+)")
_org = rx("url", "^(https?://[^/?#]+)")
_path = rx("url", "^https?://[^/?#]+([^?#]*)")
_folder = rx_replace(_path, r"[^/]*\z")
_up = rx_replace(_folder, r"[^/]*/\z")
_apex = rx_replace(_host, r"^(www|blog)\.")
_norm_path = rx_replace(f"concat({_path}, '')", r"(.)/\z", r"\1")
ORACLES["url_functions"] = f"""
select page_id, concat('https://', regexp_replace(url, '^https?://', '')) as formatted, {_host} as host, {site_key('url')} as site_key,
  regexp_matches({site_key('url')}, '(^|\\.)example\\.com\\z') as same_site, true as same_host,
  concat({_org}, {_up}, 'a/b%20c?x=%C3%BC#f') as resolved,
  case when contains(url, '#') then concat({_org}, {_norm_path}, {rx('url', '^[^?#]*([?][^#]*)')})
       when contains(url, '?') then concat(url, '/') else concat({_org}, {_path}) end as normalized,
  coalesce(nullif({rx_replace(_path, '/' + chr(92) + 'z')}, ''), '/') as path,
  {rx_replace(_path, '/' + chr(92) + 'z')} = '' as home_path, true as home,
  not regexp_matches({_path}, '(?i)\\.(xml|pdf|png|js|css)\\z') as crawlable,
  cast(len(list_filter(string_split({_path}, '/'), lambda s: s <> '')) as bigint) as depth,
  case page_id % 3 when 0 then concat('www.', {_apex}) when 1 then {rx_replace(_host, '^www[.]')} else {_apex} end as canonical_host,
  starts_with(url, 'https://') as https
from pages"""

_c = squashed("text")
ORACLES["text_functions"] = f"""
select doc_id, {_c} as squashed, cast(case when {_c} = '' then 0 else len(string_split({_c}, ' ')) end as bigint) as words,
  (with t as (select {squashed(rx_replace("concat('<b>', text, '</b>')", '<[^>]*>'))} as c) select case when length(c) <= 40 then c else concat(substr(c, 1, 39), '…') end from t) as short,
  {trimmed(rx_replace(rx_replace("concat('  [Doc](', source, ') `', text, '` * ')", r'\[([^\]]+)\]\([^)]+\)', chr(92) + '1'), '[`*_]'))} as plain,
  {trimmed(rx_replace(rx_replace("concat('<i>JavaScript:', text, '</i>  ')", '<[^>]*>'), '(?i)javascript:'))} as clean,
  lang as unfenced, {fixed('n_chars / 8.0', 2)} as fixed, {jsround('n_chars / 2.0 - 40')} as rounded
from documents"""

ORACLES["date_labels"] = """
select event_id, case when event_id % 7 = 0 then '—' else concat(strftime(ts, '%b %-d, %Y, %-I:%M %p'), ' UTC') end as long_label,
  case when event_id % 7 = 0 then '—' else strftime(ts, '%b %-d, %Y') end as short_label from events"""

ORACLES["json_or"] = """
select event_id, case when event_id % 4 = 0 then -1 else cast(json_extract(props, '$.k') as bigint) end as k from events"""

_rupees = "cast(round(paise * 1000 / 100.0) as bigint)"
_digits = f"cast({_rupees} as varchar)"
_group = f"""case when length({_digits}) <= 3 then {_digits} when length({_digits}) <= 5 then concat(left({_digits}, -3), ',', right({_digits}, 3))
  when length({_digits}) <= 7 then concat(left({_digits}, -5), ',', left(right({_digits}, 5), 2), ',', right({_digits}, 3))
  else concat(left({_digits}, -7), ',', left(right({_digits}, 7), 2), ',', left(right({_digits}, 5), 2), ',', right({_digits}, 3)) end"""
_simple = "cast(cast(round(paise / 100.0) as bigint) as varchar)"
ORACLES["amounts"] = f"""
with a as (select o_orderkey, cast(round(o_totalprice * o_orderkey % 300000) as bigint) as paise from orders)
select o_orderkey, concat('₹', {_group}) as inr,
  case when o_orderkey % 3 = 0 or paise = 9900 then '₹99' when paise = 4900 then '₹49' when paise = 14900 then '₹149' when paise = 19900 then '₹199'
       when paise = 29900 then '₹299' when paise = 49900 then '₹499'
       else concat('₹', case when length({_simple}) > 3 then concat(left({_simple}, -3), ',', right({_simple}, 3)) else {_simple} end) end as label,
  paise between 4900 and 1000000 as valid,
  case when paise <= 0 then 'Enter a valid amount in rupees.' when paise < 4900 then 'Minimum amount is ₹49.' when paise > 1000000 then 'Maximum amount is ₹10,000.' end as error,
  case o_orderkey % 5 when 4 then 4900 when 0 then case when paise % 12000 between 49 and 10000 then paise % 12000 * 100 end end as parsed_paise,
  case o_orderkey % 5 when 1 then 'Enter an amount.' when 2 then 'Use whole rupees only (no decimals or symbols).' when 3 then 'Amount is too large.'
    when 0 then case when paise % 12000 <= 0 then 'Enter a valid amount in rupees.' when paise % 12000 < 49 then 'Minimum amount is ₹49.' when paise % 12000 > 10000 then 'Maximum amount is ₹10,000.' end end as parsed_error
from a"""

ORACLES["client_ips"] = """
select event_id, case when event_id % 4 = 1 then concat('10.0.0.', event_id % 256) when event_id % 5 = 0 then concat('192.168.1.', event_id % 100)
  when event_id % 7 < 5 then '2001:db8::1' end as ip from events"""

# --- signals ----------------------------------------------------------------------

ORACLES["page_signals_text"] = build(
    "select page_id, title, h1, has_email_plaintext, h1_count, h2_count, h3_count, word_count, html_size_bytes from p_sig", "p_sig")
ORACLES["page_links"] = build(
    """select page_id, internal_links, external_links, generic_link_count, array_to_string(targets, '|') as targets,
    array_to_string(list_filter(checked_all, lambda x, i: list_position(checked_all, x) = i), '|') as checked from s_sig""", "s_sig")  # fmt: skip
ORACLES["meta_signals"] = build(
    """select page_id, title, meta_description, canonical, is_indexable, has_viewport, has_lang, has_favicon, hreflang_count > 0 as has_hreflang,
    hreflang_count, og_title, og_description, og_image, has_social_tags, has_twitter_card from s_sig""", "s_sig")  # fmt: skip
ORACLES["schema_signals"] = build(
    "select page_id, array_to_string(schema_types, '|') as schema_types, schema_valid, has_schema from s_sig", "s_sig")
ORACLES["flag_signals"] = build(
    """select page_id, h1_count, h2_count, word_count, image_count, images_without_alt, iframe_count, script_count, html_size_bytes, is_https, is_homepage,
    has_flash, mixed_content, spa as looks_like_spa_shell, has_linkedin_link, has_facebook_link, has_instagram_link, has_youtube_link, has_email_plaintext from s_sig""", "s_sig")  # fmt: skip
ORACLES["header_signals"] = build(
    """select page_id, compression, x_robots_noindex, hsts, csp, x_content_type, x_frame_options, referrer_policy, permissions_policy,
    cast(n_headers as bigint) as headers from s_sig""", "s_sig")  # fmt: skip

# Every seventeenth page has no fetch data, and of the others every thirty-first fetch failed.
_bare = "page_id % 17 = 16"
ORACLES["stored_page_signals"] = build(
    f"""select page_id, title, word_count::bigint as word_count, case when {_bare} then 200 else status_code end::bigint as status_code,
    case when {_bare} then 0 else load_time_ms end::bigint as load_time_ms, case when not ({_bare}) then compression end as compression,
    x_robots_noindex and not ({_bare}) as x_robots_noindex, meta_index and ({_bare} or not x_robots_noindex) as is_indexable,
    case when {_bare} then 0 else n_headers end::bigint as headers from s_sig where {_bare} or page_id % 31 <> 30""", "s_sig")  # fmt: skip

HEADER_GRADE = """case when score >= 95 then 'A+' when score >= 90 then 'A' when score >= 85 then 'A-' when score >= 80 then 'B+' when score >= 75 then 'B'
  when score >= 70 then 'B-' when score >= 65 then 'C+' when score >= 60 then 'C' when score >= 50 then 'D' else 'F' end"""


def header_tests(https: str) -> str:
    """Pass flags of the six header tests as a list."""
    return f"[hsts and {https}, csp, x_frame_options or csp, x_content_type, referrer_policy, permissions_policy]"


HEADER_NAMES = "['strict-transport-security', 'content-security-policy', 'x-frame-options', 'x-content-type-options', 'referrer-policy', 'permissions-policy']"
ORACLES["header_grade"] = build(
    f"""select page_id, {HEADER_GRADE} as grade, score, cast(6 - n_failed as bigint) as tests_passed, cast(n_failed as bigint) as tests_failed,
    array_to_string(list_filter({HEADER_NAMES}, lambda n, i: not tests[i]), '|') as failed
    from (select *, cast(floor((6 - n_failed) / 6.0 * 100 + 0.5) as bigint) as score from
      (select *, len(list_filter(tests, lambda t: not t)) as n_failed from (select page_id, {header_tests('is_https')} as tests from s_sig)))""", "s_sig")  # fmt: skip

# --- page rules -------------------------------------------------------------------

_t = PAGE_TEXTS
_home = lambda a, b: either("is_homepage", a, b)
_noindex = f"case when x_robots_noindex then {q(NOINDEX_BY_HEADER)} else {q(NOINDEX_BY_META)} end"
_RULES = [
    ("ssl-not-enabled", "not is_https", "critical", ()),
    ("missing-title", "title is null", "critical", ()),
    ("title-too-short", "length(title) < 10", _home("notice", "warning"), ("length(title)",)),
    ("title-too-long", "length(title) > 70", "notice", ("length(title)",)),
    ("meta-description-missing", "meta_description is null and not spa", _home("warning", "critical"), ()),
    ("meta-description-short", "length(meta_description) < 70", "warning", ("length(meta_description)",)),
    ("missing-h1", "h1_count = 0 and not spa", _home("notice", "critical"), ()),
    ("multiple-h1", "h1_count > 1", "warning", ("h1_count",)),
    ("no-h2", "h2_count = 0 and word_count > 300", "warning", ()),
    ("low-content", "not is_homepage and not spa and word_count > 0 and word_count < 300", "warning", ("word_count",)),
    ("noindex", "not is_indexable", "critical", (_noindex,)),
    ("missing-canonical", "canonical is null", "warning", ()),
    ("no-schema", "not has_schema", "notice", ()),
    ("invalid-schema", "has_schema and not schema_valid", "warning", ()),
    ("mixed-content", "mixed_content", "warning", ()),
    ("generic-anchors", "generic_link_count > 2", either("generic_link_count > 6", "warning", "notice"), ("generic_link_count",)),
    ("low-internal-linking", "internal_links < 3 and word_count > 200", "notice", ("internal_links",)),
    ("no-viewport", "not has_viewport", _home("warning", "critical"), ()),
    ("no-lang", "not has_lang", "warning", ()),
    ("no-favicon", "not has_favicon", "notice", ()),
    ("missing-alt", "images_without_alt > 0", either("images_without_alt / image_count > 0.5", "warning", "notice"), ("images_without_alt", "image_count")),
    ("heavy-iframes", "iframe_count > 2", "notice", ("iframe_count",)),
    ("flash", "has_flash", "critical", ()),
    ("plain-email", "has_email_plaintext", "notice", ()),
    ("slow-load", "load_time_ms > 2000", either("load_time_ms > 3500", "warning", "notice"), (fixed("load_time_ms / 1000", 1),)),
    ("large-html", "html_size_bytes > 500000", "warning", (jsround("html_size_bytes / 1024"),)),
    ("no-compression", "compression is null", "notice", ()),
    ("no-og", "not has_social_tags", _home("warning", "notice"), ()),
    ("no-og-image", "has_social_tags and og_image is null", "warning", ()),
    ("no-twitter-card", "not has_twitter_card", "notice", ()),
    ("http-", "status_code >= 400", "critical", ("status_code",)),
    ("no-hsts", "is_homepage and is_https and not hsts", "notice", ()),
    ("no-xcto", "is_homepage and not x_content_type", "notice", ()),
    ("no-frame-protection", "is_homepage and not x_frame_options and not csp", "notice", ()),
    ("spa-shell", "is_homepage and spa", "notice", ()),
]


def _rules_sql(source: str) -> str:
    parts = []
    for i, (key, when, severity, values) in enumerate(_RULES, start=1):
        dynamic = {"key_value": "status_code", "title_values": ("status_code",)} if key == "http-" else {}
        parts.append(rule_select(source, i, key, when, severity, _t[key], values, **dynamic))
    return " union all ".join(parts)


cte("issues", _rules_sql("s_sig"), "s_sig")
cte("plain_issues", _rules_sql("p_sig"), "p_sig")
RANK = "case severity when 'critical' then 0 when 'warning' then 1 else 2 end"


def groups_sql(source: str, keys: str = "site_key, issue_key") -> str:
    order = "page_id * 100 + rule_seq"
    return f"""select {keys}, arg_min(category, {order}) as category,
      case min({RANK}) when 0 then 'critical' when 1 then 'warning' else 'notice' end as severity,
      arg_min(title, {order}) as title, arg_min(description, {order}) as description, arg_min(affected_url, {order}) as first_url,
      count(distinct affected_url) as url_count, count(*) as count from {source} group by {keys}"""


cte("groups", groups_sql("issues"), "issues")
cte("plain_groups", groups_sql("plain_issues"), "plain_issues")
ORACLES["page_rules"] = build("select * from issues", "issues")
ORACLES["page_rules_plain"] = build("select page_id, issue_key, severity, description from plain_issues", "plain_issues")
ORACLES["issue_groups"] = build("select * from groups", "groups")
ORACLES["issue_group_urls"] = build(
    "select site_key, issue_key, affected_url, count(*) as count, min(page_id) as first_page from issues group by 1, 2, 3", "issues")
ORACLES["visible_urls"] = build(
    """select site_key, issue_key, string_agg(case when r <= 4 then affected_url end, '|' order by r) as shown, greatest(count(*) - 4, 0) as more_urls
    from (select *, row_number() over (partition by site_key, issue_key order by first_page) as r from
      (select site_key, issue_key, affected_url, min(page_id) as first_page from issues group by 1, 2, 3)) group by 1, 2""", "issues")  # fmt: skip
ORACLES["worst_sites"] = build(
    "select site_key, issue_key, severity, title, first_url, url_count, count from plain_groups where category = 'onpage'", "plain_groups")
ORACLES["severity_counts"] = build(
    """select site_key, count(*) filter (severity = 'critical') as critical_count, count(*) filter (severity = 'warning') as warning_count,
    count(*) filter (severity = 'notice') as notice_count, count(*) as total_unique from groups group by 1""", "groups")  # fmt: skip
ORACLES["category_counts"] = build(
    """select site_key, category, count(*) as groups from groups group by 1, 2 union all select site_key, 'all', count(*) from groups group by 1""", "groups")  # fmt: skip
ORACLES["dup_titles"] = build(
    "select site_key, lower(trim(title)) as value, count(*) as pages, arg_min(url, page_id) as first_url from p_sig where title is not null group by 1, 2 having count(*) > 1", "p_sig")
ORACLES["dup_metas"] = build(
    f"""select site_key, 'warning' as severity, {fill('Same meta description on %s pages.', 'count(*)')} as description, arg_min(url, page_id) as affected_url
    from s_sig where meta_description is not null group by site_key, lower({trimmed('meta_description')}) having count(*) > 1""", "s_sig")  # fmt: skip
ORACLES["audit_stream"] = build("select page_id, issue_key, severity, description from issues", "issues")
