"""Column functions on hand-written edge cases."""

from __future__ import annotations

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from siteglass.functions import markup, money, text, urls
from siteglass.operators.signals import extract_signals
from siteglass.sources.derived import crawl_pages

BASE = "https://Ex.com:443/a/b/c.html?q=1#z"


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("x"))).collect()]


def test_resolve_href(spark):
    cases = {
        "../../../x": "https://ex.com/x",
        "./": "https://ex.com/a/b/",
        "..": "https://ex.com/a/",
        "?z": "https://ex.com/a/b/c.html?z",
        "#f": "https://ex.com/a/b/c.html?q=1#f",
        "": "https://ex.com/a/b/c.html?q=1",
        "//H.com:80/p": "https://h.com:80/p",
        "http://A.com:80": "http://a.com/",
        "/ü ü?ü": "https://ex.com/%C3%BC%20%C3%BC?%C3%BC",
        "mailto:x": "mailto:x",
        " \n/t\tab ": "https://ex.com/tab",
        "http://": None,
        "HTTPS://X.com/A//b/": "https://x.com/A//b/",
    }
    assert values(spark, lambda c: urls.resolve_href(c, F.lit(BASE)), cases) == list(cases.values())


def test_normalize_drops_one_slash_and_the_fragment(spark):
    cases = {"/a//#x": "https://ex.com/a/", "/": "https://ex.com/", "/p/?q": "https://ex.com/p?q"}
    got = values(spark, lambda c: urls.normalize_internal_url(c, F.lit(BASE)), cases)
    assert got == list(cases.values())


def test_site_keys(spark):
    cases = {
        "https://WWW.Ex.com/": "ex.com",
        "http://u:p@ex.com:8080/x": "ex.com",
        "https://www2.ex.com": "www2.ex.com",
        "ex.com": None,
        "https://": None,
    }
    assert values(spark, urls.site_key, cases) == list(cases.values())


def test_canonical_host(spark):
    rows = [
        ("ex.com", "ex.com", "ex.com", "ex.com"),
        ("ex.com", "www.ex.com", "www.ex.com", "ex.com"),
        ("ex.com", "ex.com", "www.ex.com", "www.ex.com"),
        ("ex.com", "www.ex.com", "ex.com", "www.ex.com"),
        ("www.ex.com", "other.com", "ex.com", "www.ex.com"),
        ("ex.com", "ex.com", None, "ex.com"),
        ("ex.com", None, "www.ex.com", "www.ex.com"),
        ("Ex.com", None, None, "ex.com"),
    ]
    df = spark.createDataFrame(rows, "p string, a string, w string, want string")
    got = df.select(urls.canonical_host(F.col("p"), F.col("a"), F.col("w")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_decode_entities(spark):
    cases = {
        "a &amp; b": "a & b",
        "&#233;&#xE9;&nbsp;|": "éé |",
        "&copy;&bogus;&amp;lt;": "©&bogus;&lt;",
        "&#0;&#xD800;&#x1F600;&#1114112;": "&#0;&#xD800;😀&#1114112;",
        "&apos;&": "'&",
        "& &&amp;": "& &&",
        "&check;&rarrw;|&NewLine;|&Tab;|": "✓↝|\n|\t|",
        "&#0000000065;&#x00000041;&#00;": "AA&#00;",
        "&lang;&NotEqualTilde;": "\u27e8\u2242\u0338",
    }
    assert values(spark, text.decode_entities, cases) == list(cases.values())


def test_to_fixed_rounds_the_binary_value(spark):
    cases = {"1.15": "1.1", "2.25": "2.3", "1234.56": "1234.6", "0.05": "0.1", "3": "3.0"}
    got = values(spark, lambda c: text.to_fixed(c.cast("double"), 1), cases)
    assert got == list(cases.values())


def test_squash_handles_unicode_space(spark):
    assert values(spark, text.squash_ws, [" a  \n b﻿", "\u0085"]) == ["a b", "\u0085"]


def test_amounts(spark):
    cases = {"4900": "₹49", "12345678900": "₹12,34,56,789", "150": "₹2", "9900": "₹99"}
    assert values(spark, lambda c: money.amount_label(c.cast("long")), cases) == list(cases.values())


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<META NAME=description CONTENT=\'x > "y"\'>', 'x > "y"'),
        ('<meta content="name=description" name="other">', None),
        ('<meta name="description" content="  "><meta property="og:description" content="og">', "og"),
        ("<!-- <meta name='description' content='no'> -->", None),
        ('<script>"<meta name=\'description\' content=\'no\'>"</script>', None),
    ],
)
def test_meta_description(spark, html, want):
    page = spark.createDataFrame([(1, "https://ex.com/", f"<html><head>{html}</head></html>")],
                                 "page_id long, url string, html string")
    assert extract_signals(page).first()["meta_description"] == want


def test_body_text_counts_script_text_unless_told_not_to(spark):
    html = "<body>a<script>if (x<y) b</script>c &amp; d<p>e"
    with_script = values(spark, lambda c: markup.body_text(markup.body_part(c)), [html])
    without = values(spark, lambda c: markup.body_text(markup.body_part(c), False), [html])
    assert with_script == ["aif (x<y) bc & de"] and without == ["ac & de"]


class _Walker(HTMLParser):
    """Counts elements the way a tokenizer does."""

    def __init__(self):
        super().__init__()
        self.counts: dict[str, int] = {}
        self.no_alt = 0

    def handle_starttag(self, tag, attrs):
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag == "img" and "alt" not in dict(attrs):
            self.no_alt += 1


def test_counts_agree_with_a_tokenizer(spark, sf_dir):
    pages = crawl_pages(spark, sf_dir)
    joined = pages.select("page_id", "html").join(extract_signals(pages), "page_id")
    columns = {"h1": "h1_count", "h2": "h2_count", "img": "image_count", "iframe": "iframe_count",
               "script": "script_count"}
    for row in joined.collect():
        walker = _Walker()
        walker.feed(row["html"])
        assert {t: row[c] for t, c in columns.items()} == {t: walker.counts.get(t, 0) for t in columns}
        assert row["images_without_alt"] == walker.no_alt


@pytest.mark.parametrize("n", [200, 1_000, 100_000])
def test_attributes_of_a_tag_with_very_many(spark, n):
    from siteglass.functions import markup

    many = " ".join(f'a{i}="v>{i}"' for i in range(n))
    tag = f"<a {many} b c='1' href=/x rel=\"nofollow\" checked>"
    row = spark.createDataFrame([(tag,)], "tag string").select(
        markup.attr(F.col("tag"), "href").alias("href"),
        markup.attr(F.col("tag"), "src").alias("src"),
        markup.has_attr(F.col("tag"), "checked").alias("checked"),
        markup.has_attr(F.col("tag"), "hidden").alias("hidden"),
    )
    assert tuple(row.first()) == ("/x", "", True, False)


def test_quotes_open_a_value_only_after_an_equals_sign(spark):
    from siteglass.functions import markup

    texts = {
        "<p class=it's>b</p> 5 &lt; 6": "b 5 < 6",
        "<p title='a>b' x=\"c>d\">e</p>": "e",
        "<p it's>b</p>": "b",
        "<p a='1'\">b</p>": "b",
        "<p a=>b</p>": "b",
        "<p a= 'x>y'>b</p>": "b",
        "<p href=?q=\"x>b</p>": "b",
        "<!DOCTYPE html PUBLIC \"-//x//EN\">b": "b",
    }
    assert values(spark, markup.element_text, texts) == list(texts.values())
    tags = {
        "<a title=it's href=/x'>": "/x'",
        "<a don't href='/y'>": "/y",
        "<a alt='href=/no' href=\"/it's\">": "/it's",
        "<a href=>": "",
    }
    assert values(spark, lambda c: markup.attr(c, "href"), tags) == list(tags.values())
    many = "<p " + "it's " * 100_000 + ">b"
    assert values(spark, markup.element_text, {many: "b"}) == ["b"]


def test_stored_errors_are_trimmed_of_all_white_space(spark):
    from siteglass.operators.report import error_class

    rows = spark.createDataFrame([("\u00a0\n",), ("Page answered 500\n",), ("a\nb",), (None,)], "m string")
    assert [r[0] for r in rows.select(error_class(F.col("m"))).collect()] == ["empty", "showable", "technical", "empty"]
