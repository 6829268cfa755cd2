"""Not-modified revisits of a web archive, resolved to the response they stand for.

A crawler that gets "not modified" stores a revisit without content. It stands for the
latest earlier full response of the same canonical URL, if a validator agrees: an entity
tag, compared weakly, or else the modification date. The resolved record has the response's
headers, updated by those that a not-modified answer may change.

The as-of join is by URL and time bucket, so one URL with a large share of all captures
is spread over its buckets: inside a bucket a window carries the last response on; the last
response of each bucket is carried to later buckets over one row per URL and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers of a not-modified answer that describe its own transfer, not the stored content.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path and query; no fragment.

    A URL without ``://`` is its own canonical form; null stays null.
    """
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([\s\S]*)$", 1)
    return F.when(host == "", bare).otherwise(
        F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    )


def _lower_names(headers: Column) -> Column:
    """Header map with lower-case names; of names that then collide the last in order stays."""
    entries = F.array_sort(
        F.transform(
            F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
            lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
        )
    )
    last = F.filter(
        entries, lambda e, i: ~F.coalesce(F.get(entries, i + 1)["key"] == e["key"], F.lit(False))
    )
    return F.map_from_entries(last)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")


def resolved(captures: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Every capture with what it stands for.

    ``captures``: ``record_id`` long, ``url``, ``ts`` timestamp, ``kind`` ("response" or
    "revisit"), ``headers`` map of strings; other columns are left out. Output: ``record_id``,
    ``url_key``, ``ts``, ``kind``, ``outcome``, ``refers_to``, ``matched_by``, ``headers``
    (lower-case names). Outcomes: ``full`` for a response; for a revisit ``resolved``,
    ``no_response`` (none earlier, or no URL or time), ``no_validator`` (nothing to compare) or
    ``changed`` (validators differ). Only ``resolved`` ones have merged headers; others keep
    their own. Of responses at the same time the largest ``record_id`` counts; a revisit
    never stands for a response of its own time or later.
    """
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind",
        _lower_names(F.col("headers")).alias("headers"),
    )
    full = F.col("kind") == "response"
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    bucket = F.floor(F.unix_micros("ts") / F.lit(1_000_000 * bucket_seconds))
    rows = rows.withColumn("_bucket", bucket)
    response = F.when(full & usable, F.struct("record_id", "headers"))
    # At one time revisits come first, so what precedes them is earlier.
    inside = Window.partitionBy("url_key", "_bucket").orderBy("ts", full.cast("int"), "record_id")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.last(response, ignorenulls=True).over(earlier))

    ends = (
        rows.where(full & usable)
        .groupBy("url_key", "_bucket")
        .agg(F.max_by(F.struct("record_id", "headers"), F.struct("ts", "record_id")).alias("_end"))
    )
    asked = rows.where(~full & usable).select("url_key", "_bucket").distinct()
    over = Window.partitionBy("url_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.join(asked, ["url_key", "_bucket"], "full_outer")
        .withColumn("_far", F.last("_end", ignorenulls=True).over(over))
        .where(F.col("_far").isNotNull())
        .select("url_key", "_bucket", "_far")
    )
    both = near.join(carried, ["url_key", "_bucket"], "left")
    source = F.coalesce("_near", "_far")
    own, theirs = F.col("headers"), F.col("_source.headers")
    by_tag = own["etag"].isNotNull() & theirs["etag"].isNotNull()
    by_date = own["last-modified"].isNotNull() & theirs["last-modified"].isNotNull()
    same = F.when(by_tag, _tag(own) == _tag(theirs)).when(
        by_date, F.trim(own["last-modified"]) == F.trim(theirs["last-modified"])
    )
    outcome = (
        F.when(full, "full")
        .when(F.col("_source").isNull(), "no_response")
        .when(same.isNull(), "no_validator")
        .when(same, "resolved")
        .otherwise("changed")
    )
    updates = F.map_filter(own, lambda k, v: ~k.isin(*NOT_UPDATED))
    kept = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(updates, k))
    done = F.col("outcome") == "resolved"
    return (
        both.withColumn("_source", F.when(usable & ~full, source))
        .withColumn("outcome", outcome)
        .select(
            "record_id", "url_key", "ts", "kind", "outcome",
            F.when(done, F.col("_source.record_id")).alias("refers_to"),
            F.when(done, F.when(by_tag, "etag").otherwise("last-modified")).alias("matched_by"),
            F.when(done, F.map_concat(kept, updates)).otherwise(own).alias("headers"),
        )
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history of stored pages, as a crawler that asks again would have made it.

    Every page is fetched once and asked again a day and 40 days later; every third page has
    changed on day 3 and is stored again. Tags come from the stored HTML. The first
    question carries the tag, the second a weak tag or, for every other page, the date.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    changed = F.concat(F.lit('"'), F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit("3"))), F.lit('"'))
    start = F.lit(1_700_000_000) + F.pmod("page_id", F.lit(1000)) * 3600
    again = F.pmod("page_id", F.lit(3)) == 0
    day = lambda n: F.concat(F.lit("day "), F.lit(n).cast("string"))
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")

    def capture(step: int, days: int, kind: str, headers: Column) -> Column:
        return F.struct(
            (F.col("page_id") * 4 + step).alias("record_id"),
            F.timestamp_seconds(start + days * 86_400).alias("ts"),
            F.lit(kind).alias("kind"),
            headers.alias("headers"),
        )

    def header_map(**pairs: Column) -> Column:
        cells = [x for k, v in pairs.items() for x in (F.lit(k.replace("_", "-")), v)]
        return F.create_map(*cells).cast("map<string,string>")

    text = {"Content_Type": F.lit("text/html"), "Content_Length": length}
    first = capture(0, 0, "response", header_map(ETag=tag, Last_Modified=day(0), Age=F.lit("0"), **text))
    asked = capture(1, 1, "revisit", header_map(etag=tag, Age=F.lit("5"), Content_Length=F.lit("0")))
    second = capture(2, 3, "response", header_map(ETag=changed, Last_Modified=day(3), **text))
    weak = header_map(ETag=F.concat(F.lit("W/"), tag), Expires=day(41), Connection=F.lit("close"))
    dated = header_map(Last_Modified=F.when(again, day(3)).otherwise(day(0)), Expires=day(41))
    late = capture(3, 40, "revisit", F.when(F.pmod("page_id", F.lit(2)) == 0, weak).otherwise(dated))
    history = F.when(again, F.array(first, asked, second, late)).otherwise(F.array(first, asked, late))
    return pages.select("url", F.explode(history).alias("_c")).select("url", "_c.*")
