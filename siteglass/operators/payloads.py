"""Typed rows from the stored answers of outside checks.

Every function maps a payload table to one row per site. Payloads are small and
keyed by site; anything with many rows per site is aggregated before it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import bind, js_round
from .grouping import first_rows

# Fixed values: (good, needs improvement) upper bounds of field metrics.
FIELD_LIMITS = {
    "lcp": ("largest_contentful_paint", 2500.0, 4000.0),
    "cls": ("cumulative_layout_shift", 0.1, 0.25),
    "inp": ("interaction_to_next_paint", 200.0, 500.0),
    "fcp": ("first_contentful_paint", 1800.0, 3000.0),
    "ttfb": ("experimental_time_to_first_byte", 800.0, 1800.0),
}
# Field ratings, worst first.
RATINGS = ("POOR", "NEEDS_IMPROVEMENT", "GOOD", "UNKNOWN")
# Lab display modes that are no finding.
SKIPPED_MODES = ("notApplicable", "manual", "informative")
# Local header tests with their passed and failed texts.
HEADER_TESTS = (
    ("strict-transport-security", "Strict-Transport-Security header set", "HSTS header not set"),
    ("content-security-policy", "Content-Security-Policy header set", "CSP header not set"),
    ("x-frame-options", "Clickjacking protection present", "No X-Frame-Options or CSP frame protection"),
    ("x-content-type-options", "X-Content-Type-Options set", "X-Content-Type-Options missing"),
    ("referrer-policy", "Referrer-Policy header set", "Referrer-Policy header missing"),
    ("permissions-policy", "Permissions-Policy header set", "Permissions-Policy header missing"),
)
LOCAL_SCAN_MESSAGE = "MDN Observatory unavailable — graded from headers captured during crawl."
AUTHORITY_FOUND = "Domain authority from Open PageRank (free API)."
AUTHORITY_UNLISTED = "Domain not in Open PageRank index — scored as 0 authority."
AUTHORITY_EMPTY = "No PageRank data returned for this domain."


def json_number(v: Column, path: str) -> Column:
    """A JSON number as double; null for text, missing or other values."""
    return bind(
        F.try_variant_get(v, path, "variant"),
        lambda x: F.when(
            F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
            F.try_variant_get(x, "$", "double"),
        ),
    )


def json_text(v: Column, path: str) -> Column:
    """A JSON string; null for any other value."""
    return bind(
        F.try_variant_get(v, path, "variant"),
        lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")),
    )


# --- lab scores ---------------------------------------------------------------


def _strategy_rank() -> Column:
    return F.when(F.col("strategy") == "mobile", 0).otherwise(1)


def lab_runs(payloads: DataFrame) -> DataFrame:
    """One row per (site, strategy) with rounded scores and metrics."""
    v = F.col("v")
    root = "$.lighthouseResult"

    def score(name: str) -> Column:
        found = json_number(v, f"{root}.categories['{name}'].score")
        return js_round(F.coalesce(found, F.lit(0.0)) * 100)

    def number(audit: str) -> Column:
        return json_number(v, f"{root}.audits['{audit}'].numericValue")

    # A generated column: as a plain one, the filter would parse every answer a second time,
    # and Spark would move it, with the parsing, into the few tasks that scan a small table.
    answer = F.struct(F.try_parse_json("body").alias("v"))
    parsed = payloads.select("site_key", "strategy", F.inline(F.array(answer))).where(v.isNotNull())
    return parsed.select(
        "site_key",
        "strategy",
        score("performance").alias("performance_score"),
        score("accessibility").alias("accessibility_score"),
        score("best-practices").alias("best_practices_score"),
        score("seo").alias("seo_score"),
        js_round(number("largest-contentful-paint")).alias("lcp_ms"),
        number("cumulative-layout-shift").alias("cls"),
        F.coalesce(
            js_round(number("interaction-to-next-paint")),
            js_round(number("experimental-interaction-to-next-paint")),
        ).alias("inp_ms"),
        js_round(number("first-contentful-paint")).alias("fcp_ms"),
        js_round(number("server-response-time")).alias("ttfb_ms"),
        js_round(number("total-blocking-time")).alias("tbt_ms"),
        js_round(number("speed-index")).alias("speed_index_ms"),
    )


def prefer_strategy(runs: DataFrame) -> DataFrame:
    """The mobile run of each site, else its desktop run."""
    fields = [c for c in runs.columns if c != "site_key"]
    best = F.min_by(F.struct(*fields), _strategy_rank()).alias("run")
    return runs.groupBy("site_key").agg(best).select("site_key", "run.*")


def lab_audits(payloads: DataFrame) -> DataFrame:
    """Failed lab audits per (site, strategy, audit)."""
    audits = F.try_variant_get(F.col("v"), "$.lighthouseResult.audits", "map<string,variant>")
    rows = (
        payloads.withColumn("v", F.try_parse_json("body"))
        .select("site_key", "strategy", F.explode(audits).alias("audit_id", "a"))
        .select(
            "site_key",
            "strategy",
            "audit_id",
            json_number(F.col("a"), "$.score").alias("score"),
            F.coalesce(json_text(F.col("a"), "$.scoreDisplayMode"), F.lit("binary")).alias("mode"),
            F.coalesce(json_text(F.col("a"), "$.title"), F.col("audit_id")).alias("title"),
            F.coalesce(json_text(F.col("a"), "$.description"), F.lit("")).alias("description"),
            json_text(F.col("a"), "$.displayValue").alias("display_value"),
            dims.lab_audit_category(F.col("audit_id")).alias("mapped_category"),
        )
    )
    actionable = ~F.col("mode").isin(*SKIPPED_MODES) & (F.col("score") < 0.9)
    return rows.where(actionable & (F.col("mapped_category").isNotNull() | (F.col("score") < 0.5)))


def dedupe_lab_audits(audits: DataFrame) -> DataFrame:
    """Same audit in both strategies: the lower score, ties to mobile."""
    fields = [c for c in audits.columns if c not in ("site_key", "audit_id")]
    order = F.struct(F.col("score"), _strategy_rank())
    best = F.min_by(F.struct(*fields), order).alias("a")
    return audits.groupBy("site_key", "audit_id").agg(best).select("site_key", "audit_id", "a.*")


def worst_lab_audits(audits: DataFrame, k: int = 25, findings: int = 15) -> DataFrame:
    """The ``k`` worst audits of a site; then the first ``findings`` not suppressed."""
    worst = first_rows(audits, ["site_key"], [F.col("score"), F.col("audit_id")], k).drop("rank")
    kept = worst.where(~F.col("audit_id").isin(*dims.LAB_SUPPRESSED))
    return first_rows(kept, ["site_key"], [F.col("score"), F.col("audit_id")], findings)


# --- field metrics ------------------------------------------------------------


def field_ratings(payloads: DataFrame) -> DataFrame:
    """p75 and rating per field metric; a 404 answer means "no data".

    Answers with another error status are dropped.
    """
    v = F.col("v")
    missing = F.col("http_status") == 404
    cols = []
    for name, (metric, good, middling) in FIELD_LIMITS.items():
        p75 = F.when(~missing, json_number(v, f"$.record.metrics.{metric}.percentiles.p75"))
        rating = (
            F.when(F.col(f"{name}_p75").isNull(), "UNKNOWN")
            .when(F.col(f"{name}_p75") <= good, "GOOD")
            .when(F.col(f"{name}_p75") <= middling, "NEEDS_IMPROVEMENT")
            .otherwise("POOR")
        )
        cols.append((f"{name}_p75", p75, f"{name}_rating", rating))
    ok = payloads.where(missing | F.col("http_status").between(200, 299))
    df = ok.withColumn("v", F.try_parse_json("body"))
    df = df.withColumns({p: e for p, e, _, _ in cols}).withColumns({r: e for _, _, r, e in cols})
    rank = {r: i for i, r in enumerate(RATINGS)}
    worst = F.least(*[dims.lookup(F.col(f"{m}_rating"), rank) for m in ("lcp", "cls", "inp")])
    return df.select(
        "site_key",
        (~missing).alias("available"),
        *[F.col(c) for p, _, r, _ in cols for c in (p, r)],
        dims.lookup(worst, dict(enumerate(RATINGS))).alias("overall_rating"),
    )


# --- response headers ---------------------------------------------------------


def grade_headers(pages: DataFrame) -> DataFrame:
    """Local header grade of a site's home page.

    ``pages`` holds ``site_key``, ``is_https`` and ``security_headers``.
    """
    h = F.col("security_headers")
    passed = {
        "strict-transport-security": (h["hsts"], h["hsts"] & F.col("is_https")),
        "content-security-policy": (h["csp"], h["csp"]),
        "x-frame-options": (h["x_frame_options"] | h["csp"],) * 2,
        "x-content-type-options": (h["x_content_type"],) * 2,
        "referrer-policy": (h["referrer_policy"],) * 2,
        "permissions-policy": (h["permissions_policy"],) * 2,
    }
    tests = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.when(passed[name][0], good).otherwise(bad).alias("score_description"),
                passed[name][1].alias("pass"),
            )
            for name, good, bad in HEADER_TESTS
        ]
    )
    total = len(HEADER_TESTS)
    df = pages.select("site_key", tests.alias("t")).select(
        "site_key",
        F.filter("t", lambda t: ~t["pass"]).alias("failed"),
    )
    df = df.withColumn("tests_failed", F.size("failed"))
    score = js_round((F.lit(total) - F.col("tests_failed")) / F.lit(float(total)) * 100)
    df = df.withColumn("score", score)
    return df.select(
        "site_key",
        F.lit(True).alias("available"),
        F.lit("local").alias("source"),
        dims.header_score_to_grade(F.col("score")).alias("grade"),
        "score",
        (F.lit(total) - F.col("tests_failed")).alias("tests_passed"),
        "tests_failed",
        F.transform(
            "failed", lambda t: F.struct(t["name"].alias("name"), t["score_description"].alias("score_description"))
        ).alias("failed_tests"),
        F.lit(LOCAL_SCAN_MESSAGE).alias("message"),
    )


# --- DNS, threats, markup messages, authority ------------------------------------


def dns_flags(answers: DataFrame) -> DataFrame:
    """Mail and address flags per site from ``(site_key, rtype, name, data, pos)``.

    ``rtype`` is TXT, MX or AAAA; ``name`` tells root and ``_dmarc.`` records apart.
    A site with no answer of some type has the flag false.
    """
    data = F.regexp_replace(F.col("data"), r'^"|"\z', "")
    lowered = F.lower(data)
    dmarc_name = F.startswith(F.col("name"), F.lit("_dmarc."))
    txt = F.col("rtype") == "TXT"
    spf = txt & ~dmarc_name & F.startswith(lowered, F.lit("v=spf1"))
    dmarc = txt & dmarc_name & F.startswith(lowered, F.lit("v=dmarc1"))
    mx = F.col("rtype") == "MX"
    mx_rows = first_rows(answers.where(mx), ["site_key"], [F.col("pos"), F.col("data")], 5)
    mx_first = mx_rows.groupBy("site_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "data"))).alias("m")
    )
    flags = answers.groupBy("site_key").agg(
        F.min_by(data, F.when(spf, F.col("pos"))).alias("spf_record"),
        F.min_by(data, F.when(dmarc, F.col("pos"))).alias("dmarc_record"),
        F.coalesce(F.bool_or(mx), F.lit(False)).alias("has_mx"),
        F.coalesce(F.bool_or(F.col("rtype") == "AAAA"), F.lit(False)).alias("has_ipv6"),
    )
    policy = F.lower(
        F.nullif(
            F.regexp_extract("dmarc_record", r"(?i);\s*p\s*=\s*(none|quarantine|reject)", 1),
            F.lit(""),
        )
    )
    flags = flags.withColumns(
        {
            "has_spf": F.col("spf_record").isNotNull(),
            "has_dmarc": F.col("dmarc_record").isNotNull(),
            "dmarc_policy": policy,
        }
    )
    points = (
        F.when(F.col("has_spf"), 40).otherwise(0)
        + F.when(F.col("has_dmarc"), 40).otherwise(0)
        + F.when(F.col("dmarc_policy").isin("quarantine", "reject"), 20).otherwise(0)
        + F.when(F.col("has_mx"), 10).otherwise(0)
    )
    return flags.join(mx_first, "site_key", "left").select(
        "site_key",
        "has_spf",
        "spf_record",
        "has_dmarc",
        "dmarc_record",
        "dmarc_policy",
        "has_mx",
        F.coalesce("m.data", F.array().cast("array<string>")).alias("mx_records"),
        "has_ipv6",
        F.least(F.lit(100), points).alias("email_auth_score"),
    )


def distinct_threats(scans: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct threat types per scanned site in first-seen order.

    ``scans`` is ``(site_key, available, message)``; threat types are a short
    fixed list at the source, so one row per type and site is all that is collected.
    """
    per_type = matches.groupBy("site_key", "threat_type").agg(F.min("pos").alias("pos"))
    listed = per_type.groupBy("site_key").agg(
        F.array_sort(F.collect_list(F.struct("pos", "threat_type"))).alias("t")
    )
    return scans.join(listed, "site_key", "left").select(
        "site_key",
        "available",
        "message",
        F.coalesce("t.threat_type", F.array().cast("array<string>")).alias("threats"),
        (F.coalesce(F.size("t"), F.lit(0)) <= 0).alias("safe"),
    )


def html_message_counts(messages: DataFrame, k: int = 6) -> DataFrame:
    """Errors, warnings and the first ``k`` errors or warnings per site."""
    kind = F.col("type")
    listed = messages.where(kind.isin("error", "warning"))
    first = first_rows(listed, ["site_key"], [F.col("pos")], k).groupBy("site_key").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "rank",
                    "type",
                    F.coalesce("message", F.lit("Validation issue")).alias("message"),
                    F.col("last_line").alias("line"),
                )
            )
        ).alias("m")
    )
    counts = messages.groupBy("site_key").agg(
        F.count_if(kind == "error").alias("error_count"),
        F.count_if(kind.isin("info", "warning")).alias("warning_count"),
    )
    top = F.transform(
        "m", lambda m: F.struct(m["type"].alias("type"), m["message"].alias("message"), m["line"].alias("line"))
    )
    return counts.join(first, "site_key", "left").select(
        "site_key",
        (F.col("error_count") == 0).alias("valid"),
        "error_count",
        "warning_count",
        F.coalesce(top, F.array().cast("array<struct<type:string,message:string,line:int>>")).alias(
            "top_issues"
        ),
    )


def authority_rank(answers: DataFrame) -> DataFrame:
    """0–100 authority from ``(site_key, rank_integer, rank_decimal, status_code, error)``."""
    raw = F.coalesce(F.col("rank_integer").cast("double"), F.col("rank_decimal"))
    rounded = js_round(F.when(raw <= 10, raw * 10).otherwise(raw))
    # LEAST skips nulls, so a missing rank is kept apart.
    scaled = F.when(raw.isNotNull(), F.least(F.lit(100), rounded))
    found = (
        F.when(F.col("status_code") == 404, AUTHORITY_UNLISTED).otherwise(AUTHORITY_FOUND)
    )
    return answers.select(
        "site_key",
        raw.isNotNull().alias("available"),
        scaled.alias("domain_rank"),
        F.when(raw.isNotNull(), found)
        .otherwise(F.coalesce(F.nullif("error", F.lit("")), F.lit(AUTHORITY_EMPTY)))
        .alias("message"),
    )


def authority_score(rank: Column) -> Column:
    """Score of the three authority checks; 50 without a rank."""
    clamped = F.least(F.lit(100), F.greatest(F.lit(0), js_round(rank.cast("double"))))
    return F.when(rank.isNull(), 50).otherwise(clamped)
