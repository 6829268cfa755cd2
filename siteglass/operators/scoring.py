"""The 48 weighted checks, category scores and the overall score.

Checks are column expressions over one row per site. All of them are evaluated in
one projection; the long form is one explode of that row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import js_round
from .payloads import authority_score


@dataclass(frozen=True)
class Check:
    """One weighted check; append your own to change scores everywhere."""

    id: str
    category: str
    weight: int
    score: Column


def _steps(value: Column, *steps: tuple[float, int], otherwise: int) -> Column:
    """Score of the first upper bound that the value does not exceed."""
    out = F.when(value <= steps[0][0], steps[0][1])
    for bound, score in steps[1:]:
        out = out.when(value <= bound, score)
    return out.otherwise(otherwise)


def _mean_or(total: Column, n: Column, default: float) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(default))


def blend(home: Column, others: Column, weight: float) -> Column:
    return js_round(home * F.lit(weight) + others * F.lit(1 - weight))


def _others() -> Column:
    return F.col("n_pages") - 1


def _pass_blend(flag: str, weight: float) -> Column:
    """Home page pass or fail, blended with the pass rate of the other pages."""
    home = F.coalesce(F.col(f"home_{flag}"), F.lit(False)).cast("int")
    hits = F.col(f"n_{flag}") - home
    rate = F.when(_others() > 0, hits / _others() * 100).otherwise(F.lit(100.0))
    return blend(home * 100, rate, weight)


def _score_blend(name: str, weight: float, other_weight: float) -> Column:
    home = F.col(f"home_{name}")
    others = _mean_or(F.col(f"sum_{name}") - home, _others(), 100.0)
    return F.coalesce(
        js_round(home * F.lit(weight) + others * F.lit(other_weight)), F.lit(0)
    )


def _flag(test: Column, yes: int, no: int) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), yes).otherwise(no)


def _if_checked(name: str, score: Column) -> Column:
    """No score where the input is null: it was not looked at, which is no failure."""
    return F.when(F.col(name).isNotNull(), score)


def _schema() -> Column:
    valid = F.coalesce(F.col("n_schema_valid") / F.nullif(F.col("n_schema"), F.lit(0)), F.lit(0.0))
    present = F.coalesce("home_has_schema", F.col("n_schema") > 0)
    return F.when(present, js_round(F.lit(60) + valid * 40)).otherwise(30)


def _internal_linking() -> Column:
    use_content = F.col("n_content") > 0
    pick = lambda a, b: F.when(use_content, F.col(a)).otherwise(F.col(b))
    n = pick("n_content", "n_reachable")
    linked = pick("n_content_linked", "n_reachable_linked")
    total = pick("sum_content_links", "sum_reachable_links")
    average = F.least(F.lit(100), js_round(total / n / 8 * 100))
    score = js_round(linked / n * 100 * F.lit(0.55) + average * F.lit(0.45))
    return F.when(n > 0, score).otherwise(50)


def _orphans() -> Column:
    rate = F.col("orphan_pages") / F.col("n_pages")
    scored = F.when(rate == 0, 100).otherwise(_steps(rate, (0.2, 75), (0.4, 50), otherwise=25))
    return F.when(F.col("n_pages") <= 1, 100).otherwise(scored)


def _missing_alt() -> Column:
    mean = F.col("sum_missing_alt") / F.nullif(F.col("n_missing_alt"), F.lit(0))
    return F.when(mean.isNull(), 100).otherwise(_steps(mean, (1, 85), (3, 65), otherwise=40))


def _security_headers() -> Column:
    c = F.col
    passed = sum(
        F.coalesce(t, F.lit(False)).cast("int")
        for t in (
            c("home_hsts") & c("home_is_https"),
            c("home_x_content_type"),
            c("home_x_frame_options") | c("home_csp"),
            c("home_referrer_policy"),
        )
    )
    local = F.when(c("n_pages") > 0, js_round(passed / F.lit(4.0) * 100)).otherwise(60)
    return F.when(c("headers_available"), dims.header_grade_to_score(c("headers_grade"))).otherwise(local)


def _markup() -> Column:
    errors = F.col("markup_error_count")
    return (
        F.when(F.col("markup_valid").isNull(), 75)
        .when(F.col("markup_valid"), 100)
        .otherwise(_steps(errors, (2, 80), (5, 60), otherwise=40))
    )


def _field_data() -> Column:
    ratings = [F.col(f"field_{m}_rating") for m in ("lcp", "cls", "inp")]
    tally = lambda r: sum((x == r).cast("int") for x in ratings)
    poor, needs, good = tally("POOR"), tally("NEEDS_IMPROVEMENT"), tally("GOOD")
    return (
        F.when(~F.coalesce("field_available", F.lit(False)), 70)
        .when(poor >= 2, 35)
        .when(poor == 1, 55)
        .when(needs >= 2, 65)
        .when(needs == 1, 80)
        .when(good == 3, 100)
        .otherwise(75)
    )


def checks() -> list[Check]:
    """All checks in report order."""
    c = F.col
    n = F.greatest(c("n_pages"), F.lit(1))
    rate = lambda hits: js_round((F.lit(1.0) - c(hits) / n) * 100)
    lab = lambda name: F.coalesce(c(f"lab_{name}"), F.lit(70))
    nonzero = lambda name: F.nullif(c(f"lab_{name}"), F.lit(0))
    metric = lambda v, *s, low: F.when(v.isNull(), 70).otherwise(_steps(v, *s, otherwise=low))
    has_home = c("n_pages") > 0
    authority = authority_score(F.when(c("authority_available"), c("authority_domain_rank")))
    load = F.when(c("home_load_time_ms") > 0, c("home_load_time_ms"))
    kb = c("home_html_size_bytes") / 1024
    dup_sets = F.coalesce("duplicate_title_sets", F.lit(0))
    broken, moved = c("broken_links"), c("redirect_links")
    return [
        Check("ssl", "onpage", 12, _flag(c("home_is_https"), 100, 0)),
        Check("title", "onpage", 14, _score_blend("title_score", 0.65, 0.35)),
        Check("meta-description", "onpage", 10, _score_blend("meta_score", 0.65, 0.35)),
        Check("h1", "onpage", 10, _score_blend("h1_score", 0.6, 0.4)),
        Check("canonical", "onpage", 8, _pass_blend("canonical", 0.7)),
        Check("indexable", "onpage", 10, _flag(c("home_is_indexable"), 100, 0)),
        Check("robots-txt", "onpage", 8, _if_checked("robots_txt", _flag(c("robots_txt") != "", 100, 40))),
        Check("sitemap", "onpage", 8, _if_checked("sitemap_found", _flag(c("sitemap_found"), 100, 50))),
        Check("schema", "onpage", 6, _schema()),
        Check("https-redirect", "onpage", 6, _if_checked("https_enforced", _flag(c("https_enforced"), 100, 40))),
        Check("www-canonical", "onpage", 4, _flag(c("www_canonicalized"), 100, 50)),
        Check("mixed-content", "onpage", 4, _flag(c("n_mixed_content") > 0, 30, 100)),
        Check("lighthouse-seo", "onpage", 18, lab("seo_score")),
        Check("duplicate-titles", "onpage", 6,
              F.when(dup_sets == 0, 100).when(dup_sets == 1, 70).otherwise(40)),
        Check("heading-structure", "onpage", 6,
              F.when(c("n_content") > 0, js_round(c("n_content_h2") / F.nullif(c("n_content"), F.lit(0)) * 100)).otherwise(100)),
        Check("crawlable-pages", "onpage", 8, js_round(c("n_status_ok") / n * 100)),
        Check("broken-links", "onpage", 10, _steps(broken, (0, 100), (1, 60), (3, 35), otherwise=10)),
        Check("redirect-links", "onpage", 6, _steps(moved, (0, 100), (2, 70), (5, 45), otherwise=20)),
        Check("internal-linking", "onpage", 8, _internal_linking()),
        Check("orphan-pages", "onpage", 6, _orphans()),
        Check("friendly-anchors", "onpage", 4, rate("n_generic")),
        Check("referring-domains", "links", 40, authority),
        Check("domain-authority", "links", 35, authority),
        Check("backlink-volume", "links", 25, authority),
        Check("viewport", "usability", 18, _pass_blend("viewport", 0.75)),
        Check("lang", "usability", 12, _pass_blend("lang", 0.7)),
        Check("favicon", "usability", 8, _pass_blend("favicon", 0.8)),
        Check("alt-text", "usability", 14, _missing_alt()),
        Check("no-flash", "usability", 6, _flag(c("n_flash") > 0, 0, 100)),
        Check("iframes", "usability", 6, rate("n_heavy_iframes")),
        Check("security-headers", "usability", 10, _security_headers()),
        Check("email-auth", "onpage", 5, F.coalesce("dns_email_auth_score", F.lit(70))),
        Check("html-validity", "onpage", 5, _markup()),
        Check("lighthouse-accessibility", "usability", 25, lab("accessibility_score")),
        Check("lighthouse-best-practices", "usability", 15, lab("best_practices_score")),
        Check("load-time", "performance", 8,
              F.when(load.isNull(), 70).otherwise(
                  _steps(load, (1500, 100), (2500, 85), (3500, 65), (5000, 45), otherwise=25))),
        Check("compression", "performance", 5,
              F.when(~has_home, 70).otherwise(_flag(c("home_compressed"), 100, 60))),
        Check("page-size", "performance", 5,
              F.when(~has_home, 70).otherwise(
                  _steps(kb, (200, 100), (500, 85), (1000, 65), otherwise=40))),
        Check("lighthouse-performance", "performance", 40, lab("performance_score")),
        Check("cwv-lcp", "performance", 12, metric(nonzero("lcp_ms"), (2500, 100), (4000, 60), low=30)),
        Check("cwv-cls", "performance", 8, metric(c("lab_cls"), (0.1, 100), (0.25, 60), low=25)),
        Check("cwv-inp", "performance", 6, metric(nonzero("inp_ms"), (200, 100), (500, 60), low=30)),
        Check("crux-field-data", "performance", 15, _field_data()),
        Check("open-graph", "social", 25, _pass_blend("social_tags", 0.8)),
        Check("og-image", "social", 15, _pass_blend("og_image", 0.8)),
        Check("twitter-card", "social", 15, _pass_blend("twitter_card", 0.75)),
        Check("social-profiles", "social", 10,
              F.when(~has_home, 50).otherwise(_flag(c("home_profile_link"), 100, 55))),
        Check("og-coverage", "social", 15,
              F.when(has_home, js_round(c("n_social_tags") / n * 100)).otherwise(0)),
    ]


# Payload columns that checks read, with the prefix they get in the facts row.
EXTERNAL_COLUMNS = {
    "lab": (
        "performance_score", "accessibility_score", "best_practices_score", "seo_score",
        "lcp_ms", "cls", "inp_ms",
    ),
    "field": ("available", "lcp_rating", "cls_rating", "inp_rating"),
    "headers": ("available", "source", "grade", "failed_tests"),
    "dns": ("email_auth_score",),
    "markup": ("valid", "error_count"),
    "authority": ("available", "domain_rank"),
}
_TYPES = {
    "lab": "long", "field_available": "boolean", "field": "string",
    "headers_available": "boolean", "headers_source": "string", "headers_grade": "string",
    "headers_failed_tests": "array<struct<name:string,score_description:string>>",
    "dns": "int", "markup_valid": "boolean", "markup": "long",
    "authority_available": "boolean", "authority_domain_rank": "long", "lab_cls": "double",
}


# Inputs of which a missing table says that nobody looked, not that a site has none.
UNCHECKED = {"robots_txt": "string", "sitemap_found": "boolean", "https_enforced": "boolean"}


def _beside(facts: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Facts with the columns of tables that hold at most one row per site.

    All rows meet in one union and one grouping, however many tables there are; sites that
    only a table knows are left out.
    """
    every = facts.select("site_key", F.struct(*facts.drop("site_key").columns).alias("row"))
    for i, table in enumerate(tables):
        row = F.struct(*table.drop("site_key").columns).alias(f"row_{i}")
        every = every.unionByName(table.select("site_key", row), allowMissingColumns=True)
    names = ["row", *[f"row_{i}" for i in range(len(tables))]]
    sites = every.groupBy("site_key").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return sites.where("row is not null").select("site_key", *[f"{n}.*" for n in names])


def attach_tables(
    facts: DataFrame, tables: list[DataFrame], defaults: dict, **payloads: DataFrame | None
) -> DataFrame:
    """Facts with everything that the checks read, one row per site.

    ``defaults`` fill what ``tables`` leave missing; columns of ``UNCHECKED`` that no table
    brings stay null: they were not looked at. Absent payloads become nulls.
    """
    given = {name: payloads[name] for name in EXTERNAL_COLUMNS if payloads.get(name) is not None}
    slim = [
        table.select("site_key", *[F.col(c).alias(f"{name}_{c}") for c in EXTERNAL_COLUMNS[name]])
        for name, table in given.items()
    ]
    full = _beside(facts, [*tables, *slim])

    def filled(name: str, value) -> Column:
        if name in full.columns:
            return F.coalesce(name, F.lit(value))
        return F.lit(None).cast(UNCHECKED[name]) if name in UNCHECKED else F.lit(value)

    missing = {}
    for name in EXTERNAL_COLUMNS.keys() - given.keys():
        for col in EXTERNAL_COLUMNS[name]:
            kind = _TYPES.get(f"{name}_{col}", _TYPES.get(name))
            missing[f"{name}_{col}"] = F.lit(None).cast(kind)
    return full.withColumns({**{name: filled(name, value) for name, value in defaults.items()}, **missing})


def _scored(facts: DataFrame, registry: list[Check]) -> DataFrame:
    keep = ["site_key", "is_spa_shell", "n_pages", "home_status_code", "home_is_https"]
    return facts.select(*keep, *[c.score.cast("long").alias(f"_{c.id}") for c in registry])


def check_scores(facts: DataFrame, registry: list[Check] | None = None) -> DataFrame:
    """Long table ``(site_key, check_id, category, weight, score)``."""
    registry = registry or checks()
    rows = F.array(
        *[
            F.struct(
                F.lit(c.id).alias("check_id"),
                F.lit(c.category).alias("category"),
                F.lit(c.weight).alias("weight"),
                F.col(f"`_{c.id}`").alias("score"),
            )
            for c in registry
        ]
    )
    return _scored(facts, registry).select("site_key", F.inline(rows))


def weighted_category_scores(scores: DataFrame) -> DataFrame:
    """Weighted mean per category of any ``check_scores`` table, before floors.

    Checks without a score don't count.
    """
    weight = F.sum(F.when(F.col("score").isNotNull(), F.col("weight")))
    total = F.coalesce(F.sum(F.col("score") * F.col("weight")), F.lit(0))
    return scores.groupBy("site_key", "category").agg(
        (total / F.greatest(F.coalesce(weight, F.lit(1)), F.lit(1))).alias("weighted")
    )


def category_scores(facts: DataFrame, registry: list[Check] | None = None) -> DataFrame:
    """One row per site with the five category scores and the overall score.

    Stays a projection: the weighted means are sums over the columns of one row.
    """
    registry = registry or checks()
    c = F.col
    df = _scored(facts, registry)
    hard_failure = F.coalesce(
        (c("n_pages") == 0) | (c("home_status_code") >= 500) | ~c("home_is_https"), F.lit(True)
    )
    weighted = {}
    for cat in dims.CATEGORIES:
        mine = [x for x in registry if x.category == cat]
        score = {x.id: c(f"`_{x.id}`") for x in mine}
        total = sum((F.coalesce(score[x.id] * x.weight, F.lit(0)) for x in mine), F.lit(0))
        weight = sum((F.when(score[x.id].isNotNull(), x.weight).otherwise(0) for x in mine), F.lit(0))
        weighted[f"_{cat}"] = total / F.greatest(weight, F.lit(1)).cast("double")
    df = df.withColumns(weighted)

    def floored(cat: str) -> Column:
        score = c(f"_{cat}")
        if cat in ("onpage", "social"):
            score = F.when(c("is_spa_shell"), F.greatest(score, F.lit(60.0))).otherwise(score)
        if cat not in ("onpage", "links"):
            score = F.when(~hard_failure, F.greatest(score, F.lit(25.0))).otherwise(score)
        return js_round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))

    df = df.select("site_key", *[floored(cat).alias(cat) for cat in dims.CATEGORIES])
    return df.withColumn("overall_score", overall_score(*[c(x) for x in dims.CATEGORIES]))


def overall_score(*scores: Column) -> Column:
    """Plain mean of the category scores, rounded."""
    return js_round(sum(scores[1:], scores[0]) / F.lit(float(len(scores))))
