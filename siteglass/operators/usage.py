"""Usage analytics over the audit history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import first_rows
from .ranking import positions

# Sample size per client, list sizes and page sizes.
SAMPLE_DOMAINS, TOP_CLIENTS, RECENT = 8, 10, 25
DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 25, 100
UNKNOWN = "unknown"


def overview(audits: DataFrame, today: Column) -> DataFrame:
    """Audits, distinct clients, distinct domains, and audits since ``today``.

    Counted per (client, domain) first, so the distinct counts run over that.
    """
    pairs = audits.groupBy("client_ip", "domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("created_at") >= today).alias("n_today"),
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_audits"),
        F.count_distinct("client_ip").alias("unique_ips"),
        F.count_distinct("domain").alias("unique_domains"),
        F.coalesce(F.sum("n_today"), F.lit(0)).alias("audits_today"),
    )


def ip_usage(audits: DataFrame, samples: int = SAMPLE_DOMAINS) -> DataFrame:
    """Audits, domains and first/last use per client; no client reads as unknown."""
    pairs = audits.groupBy("client_ip", "domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )
    sample = (
        first_rows(pairs, ["client_ip"], [F.col("domain")], samples)
        .groupBy("client_ip")
        .agg(F.array_sort(F.collect_list("domain")).alias("domains"))
    )
    totals = pairs.groupBy("client_ip").agg(
        F.sum("n").alias("audit_count"),
        F.count(F.lit(1)).alias("unique_domains"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    same = totals["client_ip"].eqNullSafe(sample["client_ip"])
    return totals.join(sample, same).select(
        F.coalesce(totals["client_ip"], F.lit(UNKNOWN)).alias("ip"),
        "audit_count",
        "unique_domains",
        "domains",
        "first_seen",
        "last_seen",
    )


def top_ips(usage: DataFrame, k: int = TOP_CLIENTS) -> DataFrame:
    return usage.orderBy(F.col("audit_count").desc(), "ip").limit(k)


def recent_audits(audits: DataFrame, k: int = RECENT) -> DataFrame:
    return audits.orderBy(F.col("created_at").desc(), F.col("audit_id").desc()).limit(k)


def parse_pagination(
    page: str | None, page_size: str | None, default_size: int = DEFAULT_PAGE_SIZE
) -> tuple[int, int]:
    """Page and size from request text; anything unusable gives the default."""

    def number(text: str | None, default: int) -> int:
        digits = ""
        for ch in (text or "").strip():
            if ch.isdigit() or (ch in "+-" and not digits):
                digits += ch
            else:
                break
        try:
            return int(digits) or default
        except ValueError:
            return default

    return max(1, number(page, 1)), min(MAX_PAGE_SIZE, max(1, number(page_size, default_size)))


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a sorted table."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_info(df: DataFrame, page: int, size: int) -> DataFrame:
    """Total rows and pages that go with ``page_of``."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).cast("long").alias("page"),
        F.lit(size).cast("long").alias("page_size"),
        pages.alias("total_pages"),
    )


def number_pages(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Every row with its page number and place on the page.

    For writing all pages at once; ``order`` should be unique.
    """
    rows = positions(df, order)
    return rows.withColumns(
        {
            "page": F.floor((F.col("position") - 1) / size) + 1,
            "place": F.pmod(F.col("position") - 1, F.lit(size)) + 1,
        }
    )
