"""Audit inputs derived from the supplied tables.

The supplied pages have no meta tags, images, response headers, lab answers and so
on. The registered queries need them, so Spark derives one input row per supplied
row, with values that vary by id. The SQL below is the common subset of Spark and
ANSI SQL, which lets an oracle derive the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread_rows, spread_small

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_Q = "chr(39)"


def _pick(modulus: int, cases: dict[int, str], default: str = "''", key: str = "page_id") -> str:
    whens = " ".join(f"when {i} then {sql}" for i, sql in cases.items())
    return f"case {key} % {modulus} {whens} else {default} end"


def _lit(text: str) -> str:
    assert "'" not in text
    return f"'{text}'"


_HEAD = [
    _pick(
        5,
        {
            0: "''",
            1: _lit('<meta name="description" content="Short text">'),
            2: f"concat('<META content=', {_Q}, repeat('long words ', 9), {_Q}, ' NAME=description>')",
            3: _lit('<meta name="description" content="  "><meta property="og:description" content="From og &amp; more than that">'),
        },
        """concat('<meta name="description" content="Tom &amp; Jerry &#233;&nbsp;on page ', page_id % 40, ' > all the others">')""",
    ),
    _pick(3, {0: """concat('<link rel="canonical" href=" ', url, ' ">')"""}),
    _pick(11, {3: _lit('<meta name="robots" content="NOINDEX, nofollow">'), 4: _lit('<meta name="robots" content="index">')}),
    _pick(4, {1: "''"}, _lit('<meta name="viewport" content="width=device-width">')),
    _pick(
        7,
        {
            0: _lit('<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="i.png">'),
            1: _lit('<meta property="og:title" content="T"><meta property="og:description" content="D">'),
            2: _lit('<meta property="og:title" content="Only a title">'),
        },
    ),
    _pick(9, {0: _lit('<meta name="twitter:card" content="summary">'), 1: _lit('<meta name="twitter:title" content="T">')}),
    _pick(3, {1: _lit('<link rel="Shortcut Icon" href="/f.ico">')}),
    _pick(5, {1: _lit('<link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="fr" href="/fr">')}),
    _pick(
        8,
        {
            0: _lit('<script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization"}</script>'),
            1: _lit('<script type="application/ld+json">{"@type":["A","B"]}</script>'),
            2: _lit('<script type="application/ld+json">{"@graph":[{"@type":"WebPage","@context":"x"},{"@type":"Thing"}]}</script>'),
            3: _lit('<script type="application/ld+json">{"@type":</script>'),
            4: _lit('<script type="application/ld+json">{"@context":"x","name":"no type"}</script>'),
        },
    ),
    _pick(10, {0: _lit('<script src="http://cdn.example.com/a.js"></script>')}),
    "'<!-- <h1>not a heading</h1> <a href=x>no link</a> -->'",
]

_BODY = [
    """repeat('<a href="/more"> Read <b>More</b> </a>', cast(page_id % 8 as int))""",
    """'<a href="/a/../b/./c/">dots</a><a href="?q=1">q</a><a href="#top">x</a><a href="mailto:a@b.c">m</a><a href="tel:1">t</a>'""",
    """'<a href="javascript:void(0)">js</a><a href="//cdn.example.net/y">cdn</a><a href="page one">rel</a><a>none</a>'""",
    f"""concat('<a href="https://www.', {_HOST}, '/">home</a><a href=', {_Q}, 'http://other.example.net/x', {_Q}, '>click here</a>')""",
    _pick(13, {5: _lit('<a href="/open">open text')}),
    _pick(
        6,
        {
            0: _lit('<a href="https://www.linkedin.com/company/x">in</a>'),
            1: _lit('<a href="https://www.facebook.com/sharer/s.php">share</a>'),
            2: _lit('<a href="https://facebook.com/acme">fb</a>'),
            3: _lit('<a href="https://instagram.com/acme">ig</a>'),
            4: _lit('<a href="https://www.youtube.com/@acme">yt</a>'),
        },
    ),
    """repeat('<img src="a.png">', cast(page_id % 4 as int))""",
    """repeat('<img src="b.png" alt="">', cast(page_id % 3 as int))""",
    _pick(5, {0: _lit('<img data-alt="x" src=salt.png>')}),
    """repeat('<iframe src="x"></iframe>', cast(page_id % 5 as int))""",
    _pick(6, {2: _lit("<h1>Second</h1>")}),
    """repeat('<h2>Part</h2>', cast(page_id % 3 as int))""",
    """repeat('<script>if (a<b) { x("<h1> <a href=z>"); }</script>', cast(page_id % 7 as int))""",
    _pick(17, {4: _lit('<object data="x.swf"></object>')}),
    _pick(14, {3: _lit("<p>mail me@example.com now</p>")}),
]

_SHELL = "concat('<!DOCTYPE html><html><head><title>App</title>', {head}, '</head><body><div class=\"x\" id=\"root\"></div></body></html>')"


def _html() -> str:
    head, body = f"concat({', '.join(_HEAD)})", f"concat({', '.join(_BODY)})"
    full = f"replace(replace(html, '<head>', concat('<head>', {head})), '</nav>', concat('</nav>', {body}))"
    return f"case when page_id % 19 = 7 then {_SHELL.format(head=head)} else {full} end"


# Column expressions over the supplied pages.
CRAWL_PAGE_COLUMNS = {
    "page_id": "page_id",
    "url": "case when page_id % 6 = 0 then concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/') else url end",
    "html": _html(),
    "status_code": _pick(23, {5: "404", 9: "500", 11: "301"}, "200"),
    "load_time_ms": "cast((page_id * 37 % 60) * 100 as bigint)",
    "h_encoding": _pick(6, {0: "'br'", 1: "'GZIP'", 2: "'zstd'", 3: "'deflate'"}, "null"),
    "h_robots": _pick(29, {6: "'NoIndex'"}, "null"),
    "h_hsts": _pick(2, {0: "'max-age=1'"}, "null"),
    "h_csp": _pick(5, {1: "'default-src self'"}, "null"),
    "h_xcto": _pick(4, {0: "'NoSniff'", 1: "'sniff'"}, "null"),
    "h_xfo": _pick(3, {0: "'DENY'"}, "null"),
    "h_referrer": _pick(7, {0: "'origin'"}, "null"),
    "h_permissions": _pick(8, {0: "'camera=()'"}, "null"),
}
_HEADER_COLUMNS = {
    "Content-Encoding": "h_encoding",
    "X-Robots-Tag": "h_robots",
    "Strict-Transport-Security": "h_hsts",
    "Content-Security-Policy": "h_csp",
    "X-Content-Type-Options": "h_xcto",
    "X-Frame-Options": "h_xfo",
    "Referrer-Policy": "h_referrer",
    "Permissions-Policy": "h_permissions",
}

# Tables as SQL templates; the names in braces are supplied tables.
SQL = {
    # Pages and links of one site per user, from the event stream.
    "graph_pages": """
        select concat('u', user_id, '.example.com') as site_key,
               min(event_id) as page_id, min(event_id) as page_seq,
               concat('https://u', user_id, '.example.com/p/', regexp_extract(props, '([0-9]+)', 1)) as url
        from {events} group by user_id, regexp_extract(props, '([0-9]+)', 1)
    """,
    "graph_edges": """
        select concat('u', user_id, '.example.com') as site_key, event_id as src_id, event_id as src_seq,
               concat('https://u', user_id, '.example.com/p/', regexp_extract(props, '([0-9]+)', 1)) as src_url,
               cast(0 as int) as pos,
               case when event_type = 'view' then concat('https://u', user_id, '.example.com/')
                    else concat('https://u', user_id, '.example.com/p/', cast(floor(value) as bigint) % 100) end as target_url
        from {events}
    """,
    "graph_sites": """
        select concat('u', user_id, '.example.com') as site_key,
               concat('https://u', user_id, '.example.com/p/7') as base_url
        from {events} group by user_id
    """,
    "graph_links": """
        select concat('u', user_id, '.example.com') as site_key, cast(floor(event_id / 20) as bigint) as page_id,
               cast(floor(event_id / 20) as bigint) as page_seq, floor(event_id / 20) % 5 = 0 as is_homepage,
               cast(event_id % 20 as int) as pos,
               concat('https://u', user_id, '.example.com/p/', cast(floor(value) as bigint) % 40) as url
        from {events}
    """,
    "url_status": """
        select concat('https://u', user_id, '.example.com/p/', cast(floor(value) as bigint) % 40) as url,
               case (user_id + cast(floor(value) as bigint) % 40) % 9 when 0 then 404 when 1 then 301 when 2 then null
                    when 3 then 399 when 4 then 500 else 200 end as status
        from {events} group by user_id, cast(floor(value) as bigint) % 40
    """,
    # One site per customer, with the answers of every outside check.
    "sites": """
        select concat('c', c_custkey, '.example.com') as site_key,
               concat(case c_custkey % 5 when 0 then 'http' else 'https' end, '://',
                      case c_custkey % 3 when 0 then 'www.' else '' end, 'c', c_custkey, '.example.com/') as base_url
        from {customer}
    """,
    "probes": """
        select concat('c', c_custkey, '.example.com') as site_key, c_custkey % 2 = 0 as https_enforced,
               c_custkey % 3 <> 0 as www_resolves, c_custkey % 5 <> 0 as apex_resolves,
               c_custkey % 7 < 4 as canonicalized
        from {customer}
    """,
    "lab_payloads": """
        select concat('c', k, '.example.com') as site_key, strategy,
               case when (k + s) % 11 = 3 then 'HTTP 500' else concat(
                 '{{"lighthouseResult":{{"categories":{{"performance":{{"score":0.', lpad(cast((k * 37 + s * 13) % 100 as string), 2, '0'),
                 '}},"accessibility":{{"score":', case when k % 6 = 0 then 'null' else concat('0.', lpad(cast(60 + k % 40 as string), 2, '0')) end,
                 '}},"best-practices":{{"score":1}},"seo":{{"score":0.', lpad(cast(55 + k * 3 % 45 as string), 2, '0'),
                 '}}}},"audits":{{"largest-contentful-paint":{{"numericValue":', 1500 + k * 131 % 4000, '.6,"score":0.3}},',
                 '"cumulative-layout-shift":{{"numericValue":0.', lpad(cast(k * 7 % 400 as string), 3, '0'), '}},',
                 case when k % 4 = 0 then '"experimental-' else '"' end, 'interaction-to-next-paint":{{"numericValue":',
                 case when k % 5 = 1 then '"12"' else cast(50 + k * 17 % 700 as string) end, '}},',
                 '"unused-javascript":{{"score":0.', lpad(cast((k * 11 + s * 29) % 100 as string), 2, '0'),
                 ',"title":"Reduce `unused`  JavaScript","description":"See [the docs](https://example.com/d) for **more**.","displayValue":"',
                 k % 90, ' KiB"}},"color-contrast":{{"score":', (k + s) % 2, ',"title":"Contrast","description":"Low contrast."}},',
                 '"custom-check":{{"score":0.', lpad(cast(k * 19 % 100 as string), 2, '0'), ',"scoreDisplayMode":"numeric"}},',
                 '"document-title":{{"score":0}},"label":{{"score":0.5,"scoreDisplayMode":"manual"}},"font-size":{{"score":null}},',
                 '"dom-size":{{"score":0.', lpad(cast(k * 23 % 100 as string), 2, '0'), ',"title":"DOM","displayValue":""}}}}}}}}') end as body
        from (select c_custkey as k, 0 as s, 'mobile' as strategy from {customer}
              union all select c_custkey as k, 1 as s, 'desktop' as strategy from {customer}) t
    """,
    "field_payloads": """
        select concat('c', c_custkey, '.example.com') as site_key,
               case when c_custkey % 11 = 0 then 404 when c_custkey % 13 = 0 then 500 else 200 end as http_status,
               concat('{{"record":{{"metrics":{{"largest_contentful_paint":{{"percentiles":{{"p75":', 1000 + c_custkey * 97 % 5000,
                 '}}}},"cumulative_layout_shift":{{"percentiles":{{"p75":', case when c_custkey % 4 = 0 then '"0.20"'
                   else concat('0.', lpad(cast(c_custkey * 3 % 40 as string), 2, '0')) end,
                 '}}}},"interaction_to_next_paint":{{"percentiles":{{"p75":', 100 + c_custkey * 31 % 600,
                 '}}}},"first_contentful_paint":{{"percentiles":{{"p75":', 900 + c_custkey * 41 % 3000, '}}}}',
                 case when c_custkey % 3 = 0 then '' else concat(',"experimental_time_to_first_byte":{{"percentiles":{{"p75":', 300 + c_custkey * 7 % 2000, '}}}}') end,
                 '}}}}}}') as body
        from {customer}
    """,
    "dns_answers": """
        select concat('c', k, '.example.com') as site_key, rtype, name, data, pos from (
          select c_custkey as k, 'TXT' as rtype, concat('c', c_custkey, '.example.com') as name,
                 case c_custkey % 3 when 0 then '"v=SPF1 include:x -all"' when 1 then 'verify=1' else '"v=spf1 -all' end as data, 1 as pos from {customer}
          union all select c_custkey, 'TXT', concat('c', c_custkey, '.example.com'), '"v=spf1 late"', 2 from {customer}
          union all select c_custkey, 'TXT', concat('_dmarc.c', c_custkey, '.example.com'),
                 case c_custkey % 5 when 0 then '"v=DMARC1; p=none"' when 1 then 'v=DMARC1; rua=x; P = Reject' when 2 then 'v=DMARC1 p=none'
                      when 3 then '"v=dmarc1;p=quarantine"' else 'v=other' end, 1 from {customer}
          union all select c_custkey, case c_custkey % 4 when 0 then 'CNAME' else 'MX' end, concat('c', c_custkey, '.example.com'),
                 concat('10 mx', c_custkey % 7), cast(c_custkey % 3 as int) from {customer}
          union all select c_custkey, 'MX', concat('c', c_custkey, '.example.com'), '20 mx', 9 from {customer}
          union all select c_custkey, case c_custkey % 6 when 1 then 'A' else 'AAAA' end, concat('c', c_custkey, '.example.com'), '::2', 1 from {customer}) t
    """,
    "threat_scans": """
        select concat('c', c_custkey, '.example.com') as site_key, c_custkey % 7 <> 0 as available,
               case c_custkey % 14 when 0 then 'Key blocked.' else null end as message
        from {customer}
    """,
    "threat_matches": """
        select concat('c', o_custkey, '.example.com') as site_key,
               case o_orderpriority when '1-URGENT' then 'MALWARE' when '2-HIGH' then 'SOCIAL_ENGINEERING' else 'UNWANTED_SOFTWARE' end as threat_type,
               o_orderkey as pos
        from {orders}
    """,
    "html_messages": """
        select concat('c', o_custkey, '.example.com') as site_key,
               case when o_custkey % 4 = 0 then 'info' when o_orderstatus = 'F' then 'error' when o_orderstatus = 'O' then 'warning' else 'other' end as type,
               case when o_orderkey % 5 = 0 then null else concat('Message ', o_orderkey % 100) end as message,
               cast(o_orderkey % 50 as int) as last_line, o_orderkey as pos
        from {orders}
    """,
    "authority": """
        select concat('c', c_custkey, '.example.com') as site_key,
               cast(case when c_custkey % 3 = 0 then null else c_custkey % 12 end as int) as rank_integer,
               cast(case when c_custkey % 9 = 0 then null else c_custkey % 101 / 10.0 end as double) as rank_decimal,
               case when c_custkey % 12 = 0 then 404 else 200 end as status_code,
               case when c_custkey % 18 = 0 then 'Quota.' else null end as error
        from {customer}
    """,
    "robots": """
        select concat('c', c_custkey, '.example.com') as site_key,
               case c_custkey % 4 when 0 then null when 1 then 'User-agent: *'
                 when 2 then concat('sitemap: https://c', c_custkey, '.example.com/a.xml', chr(10), 'Sitemap:  https://c', c_custkey, '.example.com/index.xml ', chr(10), 'Allow: /')
                 else concat('Sitemap: https://c', c_custkey, '.example.com/sitemap.xml') end as robots_txt
        from {customer}
    """,
    "sitemap_docs": """
        select concat('c', k, '.example.com') as site_key, concat('https://c', k, '.example.com/', name) as sitemap_url,
               case when kind = 1 then concat('<sitemapindex><sitemap><loc>https://c', k, '.example.com/b.xml</loc></sitemap>',
                      '<sitemap><LOC> https://c', k, '.example.com/index2.xml </LOC></sitemap><loc>https://c', k, '.example.com/no</loc></sitemapindex>')
                    when kind = 2 then concat('<sitemapindex><loc>https://c', k, '.example.com/sitemap.xml</loc></sitemapindex>')
                    else concat('<urlset>', repeat(concat('<url><loc>https://www.c', k, '.example.com/', name, '/x</loc></url>'), 2),
                      '<loc>https://c', k, '.example.com/d/', k % 10, '/e</loc><loc>https://c', k, '.example.com/f.PDF</loc><loc>https://blog.c', k, '.example.com/p</loc>',
                      '<loc>https://elsewhere.example.org/</loc><loc>https://c', k, '.example.com/sitemap/page</loc><loc>ftp://c', k, '.example.com/z</loc></urlset>') end as body
        from (select c_custkey as k, 'a.xml' as name, 0 as kind from {customer}
              union all select c_custkey, 'index.xml', 1 from {customer}
              union all select c_custkey, 'index2.xml', 2 from {customer}
              union all select c_custkey, 'b.xml', 0 from {customer}
              union all select c_custkey, case c_custkey % 3 when 0 then 'sitemap.xml' else 'other.xml' end, 0 from {customer}) t
    """,
    # Audit history: one audit per event, one payment per order.
    "audit_history": """
        select event_id as audit_id, concat(event_type, '-', cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 12, '.example.com') as domain,
               case when user_id % 10 = 0 then null else concat('10.0.', cast(floor(user_id / 256) as bigint), '.', user_id % 256) end as client_ip,
               ts as created_at, case when event_type = 'error' then 'failed' else 'completed' end as status,
               case cast(floor(value) as bigint) % 7 when 0 then 'fetch failed' when 1 then concat('Invalid `prisma.x` ', 'invocation')
                 when 2 then repeat('long ', 40) when 3 then '  ' when 4 then null when 5 then 'Read ETIMEDOUT' else 'Could not crawl any pages.' end as error_message
        from {events}
    """,
    "payments": """
        select concat('p', o_orderkey) as payment_id, o_orderkey as order_no,
               case o_orderstatus when 'F' then 'captured' when 'O' then 'pending' else 'failed' end as status,
               cast(round(o_totalprice * 100) as bigint) as amount_paise,
               case when o_orderkey % 6 = 0 then null else o_custkey end as audit_id,
               o_orderdate as created_at, case when o_orderstatus = 'F' then o_orderdate else null end as paid_at
        from {orders}
    """,
    "customer_audits": """
        select c_custkey as audit_id, concat('https://c', c_custkey, '.example.com/') as url,
               concat('c', c_custkey, '.example.com') as domain,
               cast(abs(cast(floor(c_acctbal) as bigint)) % 101 as int) as overall_score, cast(c_custkey % 15 as int) as pages_crawled
        from {customer}
    """,
    "payment_events": """
        select event_id as seq, concat('o', user_id + case when user_id % 9 = 0 then 10000000 else 0 end) as order_id,
               case event_type when 'purchase' then 'payment.captured' when 'click' then 'payment.authorized' when 'error' then 'payment.failed'
                    when 'signup' then case when cast(floor(value) as bigint) % 3 = 0 then 'refund.processed' else 'payment.failed' end
                    else 'order.paid' end as event,
               case when event_id % 5 = 0 then null else concat('p', regexp_extract(props, '([0-9]+)', 1)) end as payment_id,
               case when event_id % 3 = 0 then null else concat('mail', event_id % 50, '@example.com') end as email,
               case when event_id % 4 = 0 then concat('+91', event_id) else null end as contact,
               case event_id % 3 when 0 then 'upi' when 1 then 'card' else null end as method,
               case when event_id % 2 = 0 then 'BAD_REQUEST' else null end as error_code,
               case when event_id % 7 = 0 then 'Declined' else null end as error_description
        from {events}
    """,
    "payment_orders": "select concat('o', c_custkey) as order_id from {customer}",
    "confirmations": """
        select event_id as seq, concat('o', user_id) as order_id, concat('p', cast(floor(event_id / 3) as bigint) % 500) as payment_id from {events}
    """,
}

# Rows a task derives its rows from, and the key that deals a table out to tasks.
_SPREAD = {
    "customer": (20_000, "c_custkey"),
    "orders": (200_000, "o_orderkey"),
    "events": (200_000, "event_id"),
}


def supplied(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A supplied table, one file or a folder of files, as a batch or as a stream of its files."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not stream:
        return spread_rows(table, *_SPREAD[name]) if name in _SPREAD else table
    # A stream takes a single file only by a pattern; this one fits nothing but the table.
    return spark.readStream.schema(table.schema).parquet(f"{sf_dir}/{name}.parque[t]")


def crawl_pages(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Supplied pages with the markup, fetch data and headers an audit looks at."""
    pages = spread_small(supplied(spark, sf_dir, "pages", stream)).selectExpr(
        *[f"{sql} as {name}" for name, sql in CRAWL_PAGE_COLUMNS.items()]
    )
    entries = F.array(
        *[
            F.when(F.col(c).isNotNull(), F.struct(F.lit(h).alias("key"), F.col(c).alias("value")))
            for h, c in _HEADER_COLUMNS.items()
        ]
    )
    return pages.withColumn("headers", F.map_from_entries(F.array_compact(entries))).drop(
        *_HEADER_COLUMNS.values()
    )


def derived(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """One of the ``SQL`` tables, read from the supplied tables at ``sf_dir``."""
    template = SQL[name]
    used = {t for t in ("customer", "events", "orders", "pages") if "{" + t + "}" in template}
    return spark.sql(template, **{t: supplied(spark, sf_dir, t, stream) for t in used})
