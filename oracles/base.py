"""Building blocks of the oracle SQL (DuckDB dialect).

Every oracle is one SELECT over named CTEs. The CTEs restate what the operators
compute; they share nothing with the Spark code but the derived inputs and the
fixed texts.
"""

from __future__ import annotations

from siteglass.operators.rule_texts import RuleText
from siteglass.sources.derived import CRAWL_PAGE_COLUMNS, SQL

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def build(select: str, *needs: str) -> str:
    """SELECT with all CTEs it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return select
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {ctes}\n{select}"


for _name, _sql in SQL.items():
    cte(_name, _sql.format(customer="customer", events="events", orders="orders", pages="pages"))

WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx_replace(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def rx(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def trimmed(x: str) -> str:
    return rx_replace(x, rf"^{WS}+|{WS}+\z")


def squashed(x: str) -> str:
    return f"trim({rx_replace(x, WS + '+', ' ')})"


def jsround(x: str) -> str:
    return f"cast(floor(({x}) + 0.5) as bigint)"


def fill(template: str, *values: str) -> str:
    """A text template with %s filled by SQL expressions."""
    parts = template.split("%s")
    out = []
    for i, part in enumerate(parts):
        if part:
            out.append(q(part.replace("%%", "%")))
        if i < len(values):
            out.append(f"cast({values[i]} as varchar)")
    return "concat(" + ", ".join(out) + ")" if len(out) > 1 or values else out[0]


def fixed(x: str, digits: int) -> str:
    """Decimals as text; the printf of the engine sends exact ties to even."""
    d = f"cast({x} as double)"
    tie = f"({d} * {2 ** (digits + 1)}) % 2 = 1"
    return f"printf('%.{digits}f', case when {tie} then {d} + 1e-9 else {d} end)"


def site_key(url: str) -> str:
    return rx(f"lower({url})", r"^[a-z]+://(?:www\.)?([^/?#:]+)")


_IN = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""


def text_of(x: str) -> str:
    """Tags out, the character references of the inputs decoded."""
    out = rx_replace(x, rf"<[a-zA-Z/!?]{_IN}>")
    for name, char in (("nbsp", " "), ("copy", "©"), ("middot", "·"), ("#233", "é"),
                       ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = f"replace({out}, '&{name};', {q(char)})"
    return out


def attribute(tag: str, name: str) -> str:
    raw = rx(tag, rf"""(?is)[\s/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
    bare = rx_replace(raw, r"""^["']|["']\z""")
    for ref, char in (("#233", "é"), ("nbsp", " "), ("amp", "&")):
        bare = f"replace({bare}, '&{ref};', {q(char)})"
    return bare


def percent(x: str) -> str:
    chars = f"regexp_extract_all({x}, '(?s)(.)', 1)"
    bad = q(r"""[^\x21-\x7E]|["<>`{}^]""")
    return f"array_to_string(list_transform({chars}, lambda ch: case when regexp_matches(ch, {bad}) then url_encode(ch) else ch end), '')"


def signal_ctes(source: str, prefix: str) -> None:
    """Signals of a page table with the columns of the derived pages."""
    p = prefix
    script = r"(?is)(<{0}(?:[\s/][^>]*)?>).*?(</{0}|\z)"
    cte(f"{p}1", f"""select *, {site_key('url')} as site_key, lower(html) as low, starts_with(url, 'https://') as is_https,
        {rx('url', '^(https?://[^/?#]+)')} as org, coalesce(nullif({rx('url', '^https?://[^/?#]+([^?#]*)')}, ''), '/') as upath,
        {rx_replace('html', '(?s)<!--.*?(?:-->|' + chr(92) + 'z)')} as clean from {source}""", source)  # fmt: skip
    cte(f"{p}2", f"""select *, {rx_replace(rx_replace('clean', script.format('script'), chr(92) + '1' + chr(92) + '2'), script.format('style'), chr(92) + '1' + chr(92) + '2')} as markup,
        string_split({rx_replace(rx('clean', r'(?is)<body(?:[\s/][^>]*)?>(.*)\z'), r'(?i)<(?:script|style)(?:[\s/][^>]*)?>', chr(1))}, chr(1)) as parts from {p}1""", f"{p}1")  # fmt: skip
    after_raw = rx("part", r"(?is)</(?:script|style)[^>]*>(.*)\z")
    raw = rx("part", r"(?is)^(.*?)</(?:script|style)")
    cte(f"{p}3", f"""select * exclude (parts), regexp_extract_all(markup, '(?i)<(?:meta|link|html|img|iframe|script|h1|h2|h3)(?:[\\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*)?>') as tags,
        {squashed(f"concat({text_of('parts[1]')}, array_to_string(list_transform(parts[2:], lambda part: concat({raw}, {text_of(after_raw)})), ''))")} as body,
        string_split({rx_replace('markup', r'(?i)<a([\s/>])', chr(1) + chr(92) + '1')}, chr(1))[2:] as a_parts from {p}2""", f"{p}2")  # fmt: skip
    head = rx("a", rf"^({_IN}>)")
    inner = rx("a", rf"(?is)^{_IN}>(.*?)(?:</a[\s>]|\z)")
    has_href = r"(?i)[\s/]href[\s=>]"
    cte(f"{p}4", f"""select * exclude (a_parts),
        list_transform(list_filter(a_parts, lambda a: {matches(head, has_href)}), lambda a: {{'href': {attribute(head, 'href')}, 'label': {trimmed(text_of(inner))}}}) as links,
        list_transform(list_filter(tags, lambda t: {matches('t', '(?i)^<meta')}), lambda t: {{'n': {attribute('t', 'name')}, 'p': {attribute('t', 'property')}, 'c': nullif({trimmed(attribute('t', 'content'))}, '')}}) as metas,
        list_transform(list_filter(tags, lambda t: {matches('t', '(?i)^<link')}), lambda t: {{'r': lower({attribute('t', 'rel')}), 'h': nullif({trimmed(attribute('t', 'href'))}, ''), 'l': {matches('t', '(?i)[ ]hreflang=')}}}) as rels
        from {p}3""", f"{p}3")  # fmt: skip
    absolute = """case when starts_with(k.href, '//') then concat(regexp_extract(url, '^(https?:)', 1), k.href)
        when starts_with(k.href, '/') then concat(org, k.href) when starts_with(k.href, '?') then concat(org, upath, k.href)
        when regexp_matches(k.href, '^[a-z]+:') then k.href
        else concat(org, regexp_replace(upath, '[^/]*\\z', ''), k.href) end"""
    cte(f"{p}5", f"""select *, list_transform(list_filter(links, lambda k: k.href <> '' and not regexp_matches(k.href, '^(#|mailto:|tel:)')),
        lambda k: {absolute}) as abs_links from {p}4""", f"{p}4")  # fmt: skip
    tidy = rx_replace(rx_replace("u", r"/[^/:]+/\.\./", "/"), r"/\./", "/")
    target = percent(rx_replace(tidy, "#.*"))
    path_slash = rx_replace("g", r"^(https?://[^/?]+/[^?]+)/(\?|\z)", r"\1\2")
    mine = f"list_filter(abs_links, lambda u: {site_key('u')} = site_key and starts_with(u, 'http'))"

    def meta(kind: str, value: str) -> str:
        return f"(list_filter(metas, lambda m: m.{kind} = '{value}'))[1].c"

    def count(tag: str) -> str:
        pattern = rf"(?i)^<{tag}[\s/>]"
        return f"len(list_filter(tags, lambda t: {matches('t', pattern)}))"

    blocks = r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script"
    ok_blocks = f"list_filter(regexp_extract_all(clean, {q(blocks)}, 1), lambda j: json_valid(j))"
    type_text = "case json_type(j, '$.\"@type\"') when 'ARRAY' then array_to_string(cast(json_extract_string(j, '$.\"@type\"[*]') as varchar[]), ',') else json_extract_string(j, '$.\"@type\"') end"
    types = f"list_filter(list_concat(list_transform({ok_blocks}, lambda j: {type_text}), flatten(list_transform({ok_blocks}, lambda j: json_extract_string(j, '$.\"@graph\"[*].\"@type\"')))), lambda t: t is not null)"
    h_type = "(?is)<title[^>]*>(.*?)</title"
    cte(f"{p}_signals", f"""select page_id, page_id as page_seq, site_key, url, low, html, body, tags, status_code, load_time_ms,
        nullif({trimmed(text_of(rx('markup', h_type)))}, '') as title,
        nullif({trimmed(text_of(rx('markup', '(?is)<h1[^>]*>(.*?)</h1')))}, '') as h1,
        coalesce({meta('n', 'description')}, {meta('p', 'og:description')}) as meta_description,
        {count('h1')} as h1_count, {count('h2')} as h2_count, {count('h3')} as h3_count, {count('iframe')} as iframe_count, {count('script')} as script_count,
        {count('img')} as image_count, len(list_filter(tags, lambda t: {matches('t', '(?i)^<img')} and not {matches('t', r'(?i)[ ]alt[\s=>/]')})) as images_without_alt,
        case when body = '' then 0 else len(string_split(body, ' ')) end as word_count,
        (list_filter(rels, lambda r: r.r = 'canonical'))[1].h as canonical,
        coalesce(len(list_filter(rels, lambda r: r.r = 'alternate' and r.l)), 0) as hreflang_count,
        len(list_filter(rels, lambda r: r.r in ('icon', 'shortcut icon', 'apple-touch-icon'))) > 0 as has_favicon,
        len(list_filter(metas, lambda m: m.n = 'viewport')) > 0 as has_viewport,
        {matches('markup', '(?i)<html[^>]* lang="[^"]+"')} as has_lang,
        not coalesce(contains(lower({meta('n', 'robots')}), 'noindex'), false) as meta_index,
        coalesce(contains(lower(h_robots), 'noindex'), false) as x_robots_noindex,
        {meta('p', 'og:title')} as og_title, {meta('p', 'og:description')} as og_description, {meta('p', 'og:image')} as og_image,
        coalesce({meta('n', 'twitter:card')}, {meta('n', 'twitter:title')}) is not null as has_twitter_card,
        {types} as schema_types,
        len(list_filter({ok_blocks}, lambda j: json_exists(j, '$."@context"') or json_exists(j, '$."@graph"[0]."@context"'))) > 0 as schema_valid,
        len({mine}) as internal_links,
        len(list_filter(abs_links, lambda u: not (starts_with(u, 'http') and {site_key('u')} = site_key))) as external_links,
        len(list_filter(links, lambda k: lower(k.label) in ('click here', 'read more', 'learn more', 'here', 'more', 'link'))) as generic_link_count,
        list_transform(list_transform({mine}, lambda u: {target}), lambda g: {path_slash}) as targets,
        list_transform({mine}, lambda u: {percent(tidy)}) as checked_all,
        is_https, regexp_matches(url, '^https?://[^/?#]+/?([?#]|\\z)') as is_homepage, strlen(html) as html_size_bytes,
        contains(low, '<object') or contains(low, 'application/x-shockwave-flash') as has_flash,
        is_https and {matches('html', '''(?i)<(?:img|script|link|iframe|source|video|audio)[^>]+(?:src|href)=["']http://''')} as mixed_content,
        {matches('html', '''(?i)<div[^>]+id=["'](?:root|__next|app|__nuxt|svelte)["']''')} as app_root,
        {matches('html', r'(?i)linkedin\.com/(?:in|company|school)')} as has_linkedin_link,
        len(list_filter(regexp_extract_all(low, 'facebook\\.com/([^"''\\s<>]+)', 1), lambda f: not starts_with(f, 'sharer') and not starts_with(f, 'share'))) > 0 as has_facebook_link,
        {matches('html', '''(?i)instagram\\.com/[^"'\\s<>]+''')} as has_instagram_link,
        {matches('html', r'(?i)youtube\.com/(?:c|channel|user|@)')} as has_youtube_link,
        {matches('body', r'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')} as has_email_plaintext,
        case when contains(lower(h_encoding), 'br') then 'brotli' when contains(lower(h_encoding), 'gzip') then 'gzip' when contains(lower(h_encoding), 'zstd') then 'zstd' end as compression,
        h_hsts is not null as hsts, h_csp is not null as csp, coalesce(lower(h_xcto) = 'nosniff', false) as x_content_type, h_xfo is not null as x_frame_options,
        h_referrer is not null as referrer_policy, h_permissions is not null as permissions_policy,
        (h_encoding is not null)::int + (h_robots is not null)::int + (h_hsts is not null)::int + (h_csp is not null)::int + (h_xcto is not null)::int + (h_xfo is not null)::int + (h_referrer is not null)::int + (h_permissions is not null)::int as n_headers
        from {p}5""", f"{p}5")  # fmt: skip
    cte(f"{p}_sig", f"""select *, meta_index and not x_robots_noindex as is_indexable, og_title is not null and og_description is not null as has_social_tags,
        len(schema_types) > 0 as has_schema, word_count < 80 and (app_root or script_count >= 5) as spa from {p}_signals""", f"{p}_signals")  # fmt: skip


cte("crawl", "select " + ", ".join(f"{s} as {n}" for n, s in CRAWL_PAGE_COLUMNS.items()) + " from pages")
cte("plain", "select page_id, url, html, 200 as status_code, 0 as load_time_ms, " + ", ".join(
    f"cast(null as varchar) as {n}" for n in CRAWL_PAGE_COLUMNS if n.startswith("h_")) + " from pages")
signal_ctes("crawl", "s")
signal_ctes("plain", "p")


def rule_select(source: str, seq: int, key: str, when: str, severity: str, text: RuleText,
                values=(), title_values=(), key_value: str | None = None,
                url: str = "url", columns: str = "site_key, page_id") -> str:
    sev = severity if severity.startswith("case") else q(severity)
    full_key = q(key) if key_value is None else f"concat({q(key)}, {key_value})"
    return (
        f"select {columns}, {seq} as rule_seq, {full_key} as issue_key, {q(text.category)} as category, {sev} as severity, "
        f"{fill(text.title, *title_values)} as title, {fill(text.description, *values)} as description, "
        f"{q(text.recommendation)} as recommendation, {url} as affected_url from {source} where {when}"
    )


def either(test: str, yes: str, no: str) -> str:
    return f"case when {test} then '{yes}' else '{no}' end"
