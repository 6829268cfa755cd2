"""URL column functions.

They follow the WHATWG rules that matter for http(s) links: scheme and host are
lower-cased, default ports dropped, dot segments resolved, and characters outside
printable ASCII percent-encoded. Internationalised host names are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, js_trim

_AUTHORITY = r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)(?::[0-9]*)?(?:[/?#]|\z)"
_SITE = (
    r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@\s]+)(?::[0-9]*)?(?:[/?#]|\z)"
)
# URLs that are canonical as they stand: plain characters, no port, no fragment.
_PLAIN = r"^https?://[a-z0-9.\-]+/[A-Za-z0-9\-._~!$&()*+,;=:@%/?]*\z"
_PORT = r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#:@\s]+:([0-9]+)(?:[/?#]|\z)"
_SCHEME = r"(?i)^([a-z][a-z0-9+.\-]*):"
_PATH = r"(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)"
_SEARCH = r"^[^?#]*(\?[^#]*)"
_FRAGMENT = r"^[^#]*(#.*)"

# Path endings that are never audited as pages.
ASSET_EXTENSIONS = (
    r"(?i)\.(xml|xml\.gz|pdf|jpg|jpeg|png|gif|webp|svg|css|js|zip|gz|mp4|woff2?|ico)\z"
)


def format_url(c: Column) -> Column:
    trimmed = js_trim(c)
    has_scheme = F.startswith(trimmed, F.lit("http://")) | F.startswith(trimmed, F.lit("https://"))
    return F.when(has_scheme, trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def host(c: Column) -> Column:
    """Lower-cased host name without port; null where the URL has none."""
    return F.lower(F.nullif(F.regexp_extract(c, _AUTHORITY, 1), F.lit("")))


def drop_www(c: Column) -> Column:
    return F.regexp_replace(c, r"^www\.", "")


def site_key(c: Column) -> Column:
    """Lower-cased host without a leading ``www.``."""
    return F.lower(F.nullif(F.regexp_extract(c, _SITE, 1), F.lit("")))


def is_same_site(a: Column, b: Column) -> Column:
    """Equal sites, or one is a sub-domain of the other."""
    x, y = site_key(a), site_key(b)
    return F.coalesce(
        (x == y)
        | F.endswith(x, F.concat(F.lit("."), y))
        | F.endswith(y, F.concat(F.lit("."), x)),
        F.lit(False),
    )


def same_site_host(a: Column, b: Column) -> Column:
    return F.coalesce(site_key(a) == site_key(b), F.lit(False))


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _SCHEME, 1))


def raw_path(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, _PATH, 1), F.lit("")), F.lit("/"))


def search(c: Column) -> Column:
    return F.regexp_extract(c, _SEARCH, 1)


def origin(c: Column) -> Column:
    """``scheme://host[:port]`` with a default port removed; null without a host."""

    def shown(port: Column, sch: Column) -> Column:
        default = ((sch == "http") & (port == "80")) | ((sch == "https") & (port == "443"))
        return F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))

    suffix = bind(F.regexp_extract(c, _PORT, 1), lambda port: shown(port, scheme(c)))
    return F.concat(scheme(c), F.lit("://"), host(c), suffix)


def url_path(c: Column) -> Column:
    """Path with one trailing slash removed, ``/`` when nothing is left."""
    stripped = F.regexp_replace(raw_path(c), r"/\z", "")
    return F.when(host(c).isNotNull(), F.when(stripped == "", F.lit("/")).otherwise(stripped))


def is_homepage_path(c: Column) -> Column:
    return F.coalesce(url_path(c) == "/", F.lit(False))


def is_homepage(c: Column, base: Column) -> Column:
    return is_homepage_path(c) & same_site_host(c, base)


def is_https(c: Column) -> Column:
    return F.startswith(c, F.lit("https://"))


def is_crawlable(c: Column, base: Column) -> Column:
    path = raw_path(c)
    return (
        c.rlike("(?i)^https?://")
        & ~path.rlike(ASSET_EXTENSIONS)
        & ~path.rlike("(?i)/sitemap")
        & is_same_site(c, base)
    )


def path_depth(c: Column) -> Column:
    return F.size(F.filter(F.split(raw_path(c), "/"), lambda s: s != ""))


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == ".", acc)
            .when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(seg)))
        )

    def resolved(p: Column) -> Column:
        segments = F.slice(F.split(p, "/"), 2, F.length(p) + 1)
        # A closing dot segment leaves the folder's slash behind.
        dotted = F.concat(F.aggregate(segments, empty, step), F.when(
            p.rlike(r"/\.\.?\z"), F.array(F.lit(""))
        ).otherwise(empty))
        return F.concat(F.lit("/"), F.array_join(dotted, "/"))

    return bind(path, lambda p: F.when(p.rlike(r"/\.\.?(/|\z)"), resolved(p)).otherwise(p))


def percent_encode(c: Column, extra: str) -> Column:
    """Percent-encode control, space and non-ASCII characters plus ``extra``."""
    unsafe = rf"[^\x21-\x7E]|[{extra}]"

    def encode_char(ch: Column) -> Column:
        hexed = F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
        return F.when(ch.rlike(unsafe), hexed).otherwise(ch)

    def encoded(v: Column) -> Column:
        chars = F.regexp_extract_all(v, F.lit("(?s)(.)"), 1)
        return F.array_join(F.transform(chars, encode_char), "")

    return bind(c, lambda v: F.when(v.rlike(unsafe), encoded(v)).otherwise(v))


def join_href(
    href: Column, base_scheme: Column, base_origin: Column, base_path: Column, base_search: Column
) -> Column:
    """Absolute but not yet canonical URL of a link on a page."""
    h = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")

    def absolute(v: Column) -> Column:
        folder = F.regexp_replace(base_path, r"[^/]*\z", "")
        return (
            F.when(v.rlike("(?i)^[a-z][a-z0-9+.\\-]*:"), v)
            .when(F.startswith(v, F.lit("//")), F.concat(base_scheme, F.lit(":"), v))
            .when(F.startswith(v, F.lit("/")), F.concat(base_origin, v))
            .when(F.startswith(v, F.lit("?")), F.concat(base_origin, base_path, v))
            .when(
                (v == "") | F.startswith(v, F.lit("#")),
                F.concat(base_origin, base_path, base_search, v),
            )
            .otherwise(F.concat(base_origin, folder, v))
        )

    return bind(h, absolute)


def is_special(joined: Column) -> Column:
    """Schemes whose URLs must carry a host to be valid."""
    return joined.rlike("(?i)^(https?|ftp|wss?):")


def clean_path(joined: Column) -> Column:
    return percent_encode(remove_dot_segments(raw_path(joined)), r'"<>`{}^')


def _is_plain(u: Column) -> Column:
    return ~F.contains(u, F.lit("/.")) & u.rlike(_PLAIN)


def canonical_url(joined: Column, fragment: bool = True) -> Column:
    """Canonical text of an absolute URL; null where it is not valid."""


    def canonical(u: Column) -> Column:
        tail = F.lit("")
        if fragment:
            tail = percent_encode(F.regexp_extract(u, _FRAGMENT, 1), '"<>`')
        query = percent_encode(search(u), "\"<>'")
        opaque = u if fragment else F.regexp_replace(u, "#.*", "")
        full = F.concat(origin(u), clean_path(u), query, tail)
        return F.when(_is_plain(u), u).when(is_special(u), full).otherwise(opaque)

    return bind(joined, canonical)


def drop_trailing_slash(joined: Column) -> Column:
    """Canonical URL without fragment and without one trailing path slash."""


    def trimmed(u: Column) -> Column:
        path = F.regexp_replace(clean_path(u), r"(.)/\z", "$1")
        full = F.concat(origin(u), path, percent_encode(search(u), "\"<>'"))
        as_is = ~F.endswith(u, F.lit("/")) & ~F.contains(u, F.lit("/?")) & _is_plain(u)
        opaque = F.regexp_replace(u, "#.*", "")
        return F.when(as_is, u).when(is_special(u), full).otherwise(opaque)

    return bind(joined, trimmed)


def _joined(href: Column, base: Column) -> Column:
    return join_href(href, scheme(base), origin(base), raw_path(base), search(base))


def resolve_href(href: Column, base: Column) -> Column:
    return canonical_url(_joined(href, base))


def normalize_internal_url(href: Column, base: Column) -> Column:
    return drop_trailing_slash(_joined(href, base))


def normalize_page_url(url: Column) -> Column:
    """``normalize_internal_url`` of a page's own absolute URL."""
    return drop_trailing_slash(js_trim(url))


def canonical_host(primary: Column, apex_final: Column, www_final: Column) -> Column:
    """Pick apex or www from the hosts where the two variants end up.

    ``apex_final`` and ``www_final`` are final host names, null where the
    variant did not answer.
    """
    p, apex, www = F.lower(primary), F.lower(apex_final), F.lower(www_final)
    apex_www, www_www = F.startswith(apex, F.lit("www.")), F.startswith(www, F.lit("www."))
    both = (
        F.when(drop_www(apex) != drop_www(www), p)
        .when((apex != www) & www_www & ~apex_www, www)
        .when((apex != www) & apex_www & ~www_www, apex)
        .otherwise(drop_www(p))
    )
    return F.when(apex.isNotNull() & www.isNotNull(), both).otherwise(F.coalesce(apex, www, p))


def first_valid_ip(headers: Column, reported: Column | None = None) -> Column:
    """First usable client address of the forwarding headers, else the reported one."""

    # Forwarding headers in order of trust.
    names = (
        "cf-connecting-ip",
        "x-vercel-forwarded-for",
        "x-real-ip",
        "true-client-ip",
        "x-forwarded-for",
    )

    def valid(ip: Column) -> Column:
        return F.when(
            ip.rlike(r"^[\d.a-fA-F:]+\z") & ~ip.isin("unknown", "::1", "127.0.0.1"), ip
        )

    candidates = [
        valid(js_trim(F.element_at(F.split(F.try_element_at(headers, F.lit(n)), ","), 1)))
        for n in names
    ]
    if reported is not None:
        candidates.append(valid(js_trim(reported)))
    return F.coalesce(*candidates)
