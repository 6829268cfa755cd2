"""Brute-force checks and properties of the distributed operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siteglass.operators import discovery, grouping, links, payments, ranking, recommend, scoring, signals
from siteglass.operators.rules import ISSUE_COLUMNS, Rule, apply_rules
from siteglass.operators.rule_texts import RuleText
from siteglass.plans.audit import AuditInputs, audit_signals, run_audit
from siteglass.sources import schemas, tables
from siteglass.sources.derived import crawl_pages, derived


def test_ranks_equal_row_numbers_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", i) for i in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "k string, seq long")
    got = ranking.ranked(df, ["k"], [ranking.id_bucket(F.col("seq"), 6)], [F.col("seq")])
    want: dict[str, int] = {}
    for k, seq in sorted(rows, key=lambda r: r[1]):
        want[(k, seq)] = 1 + sum(1 for a, b in rows if a == k and b < seq)
    assert {(r["k"], r["seq"]): r["rank"] for r in got.collect()} == want


def test_sampled_links_follow_the_page_by_page_fold(spark):
    rng = random.Random(2)
    rows = [
        (site, page, page, page == 0, pos, f"u{rng.randrange(12)}")
        for site in ("a", "b")
        for page in range(5)
        for pos in range(10)
    ]
    schema = "site_key string, page_id long, page_seq long, is_homepage boolean, pos int, url string"
    # A page lists each link once.
    first = {(r[0], r[1], r[5]): r for r in reversed(rows)}.values()
    got = links.sample_links(spark.createDataFrame(list(first), schema), 2, 1).collect()
    want = set()
    for site in ("a", "b"):
        seen: set[str] = set()
        for page in range(5):
            mine = sorted(r for r in first if r[0] == site and r[1] == page)
            for cap in (2, 1) if page == 0 else (2,):
                fresh = [r for r in sorted(mine, key=lambda r: r[4]) if r[5] not in seen][:cap]
                seen |= {r[5] for r in fresh}
                want |= {(site, page, r[5]) for r in fresh}
    assert {(r["site_key"], r["page_id"], r["url"]) for r in got} == want


def _random_events(n: int) -> list[tuple]:
    rng = random.Random(3)
    names = ["payment.captured", "payment.authorized", "payment.failed", "refund.processed", "order.paid"]
    pick = lambda *xs: rng.choice([None, *xs])
    return [
        (i, rng.choice(names), rng.choice(["o1", "o2", "o3", "gone"]), pick("p1", "p2"), pick("a@b.c"),
         pick("1"), pick("upi", "card"), pick("E1"), pick("Declined"))
        for i in range(n)
    ]


def fold_event(state, event):
    """One event onto an order's state; a capture holds until a refund."""
    name = event["event"]
    if name in payments.CAPTURE_EVENTS or name == payments.FAILURE_EVENT:
        if state["status"] == "captured":
            return state
        kept = {f: event[f] or state[f] for f in ("payment_id", "email", "contact", "method")}
        state = {**state, **kept, "last_event": name}
        if name == payments.FAILURE_EVENT:
            text = event["error_description"] or payments.DEFAULT_ERROR
            return {**state, "status": "failed", "error_code": event["error_code"], "error_description": text}
        return {**state, "status": "captured", "paid_seq": event["seq"]}
    if name == payments.REFUND_EVENT:
        return {**state, "status": "refunded", "last_event": name}
    return {**state, "last_event": name}


def test_ledger_equals_the_event_by_event_fold(spark):
    rows = _random_events(200)
    names = [f.split()[0] for f in schemas.PAYMENT_EVENTS.split(", ")]
    fields = ("status", "payment_id", "email", "contact", "method", "error_code", "error_description",
              "paid_seq", "last_event")
    orders = spark.createDataFrame([("o1",), ("o2",), ("o3",), ("quiet",)], "order_id string")
    for size in (3, 25, 200):
        got = payments.payment_ledger(spark.createDataFrame(rows[:size], schemas.PAYMENT_EVENTS), orders)
        want = {o: {**dict.fromkeys(fields), "status": "pending"} for o in ("o1", "o2", "o3", "quiet")}
        for row in rows[:size]:
            event = dict(zip(names, row))
            if event["order_id"] in want:
                want[event["order_id"]] = fold_event(want[event["order_id"]], event)
        assert {r["order_id"]: {f: r[f] for f in fields} for r in got.collect()} == want


def test_user_rules_and_checks_plug_in(spark):
    df = spark.createDataFrame([("s", 5)], "site_key string, n int")
    rule = Rule("many", F.col("n") > 3, "notice", RuleText("onpage", "T", "%s things", "R"), (F.col("n"),))
    row = apply_rules(df, [rule], 1, F.lit("u")).first()
    assert (row["issue_key"], row["description"], row["affected_url"]) == ("many", "5 things", "u")


def test_full_audit(spark, sf_dir, tmp_path):
    pages = crawl_pages(spark, sf_dir)
    no_page = pages.limit(1).withColumns({"page_id": F.lit(10**6), "html": F.lit("%PDF-1.7")})
    pages = pages.unionByName(no_page)
    status = derived(spark, sf_dir, "url_status")
    result = run_audit(AuditInputs(pages, url_status=status), str(tmp_path / "signals"))
    issues, groups = result.issues, result.groups
    assert result.signals.count() == pages.count() - 1
    assert tuple(issues.columns) == ISSUE_COLUMNS
    assert groups.agg(F.sum("count")).first()[0] == issues.count()
    assert groups.agg(F.sum("url_count")).first()[0] == result.group_urls.count()
    for row in result.scores.collect():
        parts = [row[c] for c in ("onpage", "links", "usability", "performance", "social")]
        assert all(0 <= p <= 100 for p in parts)
        assert row["overall_score"] == int(sum(parts) / 5 + 0.5)
    assert result.checks.count() == 48 * result.scores.count()
    assert sum(c.weight for c in scoring.checks()) == 182 + 100 + 114 + 99 + 80
    # The number of partitions changes nothing.
    again = audit_signals(result.signals.repartition(3), AuditInputs(pages, url_status=status))
    key = ["site_key", "issue_key"]
    assert groups.orderBy(key).collect() == again.groups.orderBy(key).collect()


def test_visible_urls_keep_the_rest_as_a_count(spark):
    rows = [("s", i, 10, i, 1, "k", "c", "notice", "t", "d", "r", f"u{i % 7}") for i in range(20)]
    schema = ("site_key string, page_id long, stage int, page_seq long, rule_seq int, issue_key string, category string, "
              "severity string, title string, description string, recommendation string, affected_url string")  # fmt: skip
    issues = spark.createDataFrame(rows, schema)
    shown = grouping.visible_urls(grouping.issue_group_urls(issues), grouping.group_issues(issues)).first()
    assert shown["shown_urls"] == ["u0", "u1", "u2", "u3"] and shown["more_urls"] == 3


def test_saved_audits_round_trip(spark, tmp_path):
    root = str(tmp_path / "store")
    audits = spark.createDataFrame([(1, "https://a/"), (2, "https://b/")], "audit_id long, url string").withColumn(
        "created_at", F.lit("2024-01-02 03:04:05").cast("timestamp")
    )
    pages = spark.createDataFrame([(1, 10, 1, "https://a/x"), (1, 11, 2, "https://a/x"), (2, 20, 1, "https://b/")],
                                  "audit_id long, page_id long, page_seq long, url string")
    issues = spark.createDataFrame([(1, 100, "https://a/x"), (2, 200, "https://b/none")],
                                   "audit_id long, issue_id long, affected_url string")
    tables.write_audit(audits, pages, issues, root)
    stored = {r["issue_id"]: r["page_id"] for r in spark.read.parquet(f"{root}/issues").collect()}
    assert stored == {100: 11, 200: None}
    target = str(tmp_path / "kept")
    tables.rewrite_without(spark, root, spark.createDataFrame([(1,)], "audit_id long"), target)
    assert [r["audit_id"] for r in spark.read.parquet(f"{target}/pages").collect()] == [2]


def test_robots_and_sitemap_files(spark, tmp_path):
    (tmp_path / "robots").mkdir()
    (tmp_path / "robots" / "ex.com.txt").write_text("User-agent: *\nSitemap: x")
    folder = tmp_path / "maps" / "site=ex.com"
    folder.mkdir(parents=True)
    (folder / "https%3A%2F%2Fex.com%2Fsitemap.xml.xml").write_text("<urlset/>")
    robots = tables.read_robots(spark, str(tmp_path / "robots")).first()
    assert robots.asDict() == {"site_key": "ex.com", "robots_txt": "User-agent: *\nSitemap: x"}
    doc = tables.read_sitemaps(spark, str(tmp_path / "maps")).first()
    assert (doc["site_key"], doc["sitemap_url"], doc["body"]) == ("ex.com", "https://ex.com/sitemap.xml", "<urlset/>")


def test_many_sitemap_lines_keep_the_base_url_first(spark):
    robots_txt = "\n".join(f"Sitemap: https://a.example/{i}.xml" for i in range(1100))
    robots = spark.createDataFrame([("a.example", robots_txt)], "site_key string, robots_txt string")
    sites = spark.createDataFrame([("a.example", "https://a.example/x")], "site_key string, base_url string")
    body = "<urlset><loc>https://a.example/p%d</loc></urlset>"
    docs = spark.createDataFrame(
        [("a.example", f"https://a.example/{i}.xml", body % i) for i in (0, 1023, 1099)],
        "site_key string, sitemap_url string, body string",
    )
    found = discovery.discover_urls(robots, docs, sites).orderBy("pos").collect()
    want = ["https://a.example/x", "https://a.example/", *(f"https://a.example/p{i}" for i in (0, 1023, 1099))]
    assert [r["url"] for r in found] == want


def test_sitemap_indexes_that_list_each_other_come_to_an_end(spark):
    def index(*names):
        return "<sitemapindex>" + "".join(f"<loc>https://a.example/{n}.xml</loc>" for n in names) + "</sitemapindex>"

    bodies = {
        "sitemap": index("one", "x", "sitemap"),
        "one": index("two", "sitemap", "x"),
        "two": index("three", "one"),
        "three": index("y", "two"),
        "x": "<urlset><loc>https://a.example/x</loc><loc>https://a.example/both</loc></urlset>",
        "y": "<urlset><loc>https://a.example/both</loc><loc>https://a.example/y</loc></urlset>",
    }
    docs = spark.createDataFrame(
        [("a.example", f"https://a.example/{n}.xml", b) for n, b in bodies.items()],
        "site_key string, sitemap_url string, body string",
    )
    sites = spark.createDataFrame([("a.example", "https://a.example/")], "site_key string, base_url string")
    robots = spark.createDataFrame([], "site_key string, robots_txt string")

    def urls(**limits):
        found = discovery.discover_urls(robots, docs, sites, **limits)
        return [r["url"].removeprefix("https://a.example/") for r in found.orderBy("pos").collect()]

    assert urls(max_depth=None) == ["", "both", "y", "x"]
    assert urls() == ["", "x", "both"]
    assert urls(max_depth=0) == [""]
    assert urls(max_depth=None, children=1) == ["", "both", "y"]
    with pytest.raises(ValueError):
        discovery.discover_urls(robots, docs, sites, per_sitemap=3, max_depth=None)


def test_sitemaps_are_parsed_once(spark):
    docs = spark.createDataFrame([], "site_key string, sitemap_url string, body string")
    sites = spark.createDataFrame([("a.example", "https://a.example/")], "site_key string, base_url string")
    robots = spark.createDataFrame([], "site_key string, robots_txt string")
    found = discovery.discover_urls(robots, docs, sites)
    assert "body" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["url"] for r in found.collect()] == ["https://a.example/"]


def test_a_document_start_counts_wherever_it_stands(spark):
    texts = ["<!--" + "x" * 10_000 + "--><HTML>", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "html string")
    got = [r[0] for r in df.select(signals.looks_like_html(F.col("html"))).collect()]
    assert got == [True, False, False]


def _sampled(rows, n, extra):
    """Page after page of a site: the first links that no earlier page picked."""
    pages, seen, out = {}, {}, []
    for site, page, home, pos, url in sorted(rows):
        pages.setdefault((site, page), []).append((pos, url, home))
    for (site, page), own in sorted(pages.items()):
        fresh = [(pos, url) for pos, url, _ in own if url not in seen.setdefault(site, set())]
        first = fresh[:n]
        second = [x for x in fresh if x[1] not in {u for _, u in first}][:extra] if own[0][2] else []
        seen[site] |= {u for _, u in first + second}
        out += [(site, page, pos, url, 1) for pos, url in first] + [(site, page, pos, url, 2) for pos, url in second]
    return sorted(out)


def test_sampled_links_equal_the_fold(spark):
    draw = random.Random(8)
    rows = [
        (f"s{draw.choice([0, 0, 0, 1, 2])}", page, page % 4 == 0, pos, f"u{int(draw.random() ** 2 * 25)}")
        for page in range(40) for pos in range(draw.randint(0, 9))
    ]
    rows = [(f"s{page % 3 and 1}", page, home, pos, url) for _, page, home, pos, url in rows]
    table = spark.createDataFrame(
        [(s, p, p, h, pos, u) for s, p, h, pos, u in rows],
        "site_key string, page_id long, page_seq long, is_homepage boolean, pos int, url string",
    )
    for n, extra in ((2, 3), (1, 0), (50, 5)):
        found = links.sample_links(table, n, extra)
        got = sorted((r["site_key"], r["page_seq"], r["pos"], r["url"], r["round"]) for r in found.collect())
        assert got == _sampled(rows, n, extra)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan
    assert links.sample_links(table.limit(0)).count() == 0


def test_inputs_are_given_empty_or_absent(spark, sf_dir):
    signals_table = signals.extract_signals(crawl_pages(spark, sf_dir))
    site = signals_table.select("site_key").orderBy("site_key").first()[0]
    own = signals_table.where(F.col("site_key") == site)
    robots = spark.createDataFrame([(site, "User-agent: *")], schemas.ROBOTS)
    found = {}
    for name, table in (("given", robots), ("empty", robots.limit(0)), ("absent", None)):
        result = audit_signals(own, AuditInputs(None, robots=table))
        score = result.checks.where("check_id = 'robots-txt'").first()["score"]
        (weighted,) = [r["weighted"] for r in scoring.weighted_category_scores(result.checks).where("category = 'onpage'").collect()]
        keys = {r["issue_key"] for r in result.issues.collect()}
        found[name] = (score, "no-robots" in keys, "no-sitemap" in keys)
        rows = [r for r in result.checks.where("category = 'onpage'").collect() if r["score"] is not None]
        assert abs(weighted - sum(r["score"] * r["weight"] for r in rows) / sum(r["weight"] for r in rows)) < 1e-9
    assert found == {"given": (100, False, False), "empty": (40, True, False), "absent": (None, False, False)}


def test_positions_without_a_single_partition(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(50), i) for i in range(700)]
    table = spark.createDataFrame(rows, "a int, b int").repartition(5)
    found = ranking.positions(table, [F.col("a").desc(), F.col("b")])
    want = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert {(r["a"], r["b"]): r["position"] for r in found.collect()} == want
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert ranking.positions(table.limit(0), [F.col("a")]).count() == 0


def test_failed_requests_are_halved(spark, tmp_path):
    rows = [
        (a, 0, i, a * 100 + i, "critical", "onpage", f"t{i}", "d", None, f"https://s{a}/", None, None, None, None, "site")
        for a in range(1, 7) for i in range(7)
    ]
    schema = (
        "audit_id long, batch_no int, idx int, issue_id long, severity string, category string, title string, description string, "
        "recommendation string, affected_url string, page_url string, page_title string, page_word_count long, page_h1_count long, domain string"
    )
    batches = spark.createDataFrame(rows, schema)

    def answer(request):
        if "https://s3/" in request or "https://s6/" in request:
            raise ConnectionError  # every third audit has no answer, however small the request
        if "https://s2/" in request and request.count("https://") > 2:
            return "no json"
        return '{"recommendations": [' + ",".join('{"title": "ok"}' for _ in range(request.count("https://"))) + "]}"

    answers = recommend.request_answers(batches, answer)
    starts = sorted((r["audit_id"], r["start"]) for r in answers.collect())
    assert starts == [(1, 0), (2, 0), (2, 2), (2, 4), (2, 6), (4, 0), (5, 0)]
    found = recommend.apply_enrichment(batches, answers).collect()
    assert len(found) == 42 and all(r["title"] == ("ok" if r["audit_id"] % 3 else r["title"]) for r in found)
    plain = batches.select("audit_id", "batch_no").distinct().where("audit_id % 3 <> 0")
    plain = plain.withColumn("body", F.lit('[' + ",".join(['{"title": "ok"}'] * 7) + "]"))
    assert sorted(recommend.apply_enrichment(batches, plain).collect()) == sorted(found)


def _wide_table_plan(df):
    """Physical operators from the exchange that deals the customers out down to the scan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    return [next(x for x in range(i, len(lines)) if "FileScan" in lines[x]) - i for i in dealt], lines, dealt


@pytest.fixture
def many_customers(spark, tmp_path, monkeypatch):
    """40 customers in one row group and at most ten for a task."""
    from siteglass.sources import derived as source

    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setitem(source._SPREAD, "customer", (10, "c_custkey"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["lab_runs", "lab_audits", "worst_lab_audits", "lab_findings", "prefer_strategy"])
def test_answers_are_made_and_parsed_in_many_tasks(spark, many_customers, name):
    from siteglass.plans.catalog import QUERIES

    df = QUERIES[name](spark, many_customers)
    depths, lines, dealt = _wide_table_plan(df)
    assert dealt and all("hashpartitioning(c_custkey" in lines[i] and ", 4)" in lines[i] for i in dealt)
    below = "".join(line for i, n in zip(dealt, depths) for line in lines[i : i + n])
    assert "parse" not in below.lower() and not df.isEmpty()


def test_sites_meet_their_answers_by_key(spark, many_customers):
    """Spark guesses a few kB for these sites and their runs, however long the answers are."""
    from siteglass.operators import payloads, rules_external

    urls = derived(spark, many_customers, "sites")
    rank = payloads.authority_rank(derived(spark, many_customers, "authority"))
    lab = payloads.lab_audits(derived(spark, many_customers, "lab_payloads"))
    runs = payloads.prefer_strategy(payloads.lab_runs(derived(spark, many_customers, "lab_payloads")))
    found = rules_external.lab_issues(runs, payloads.worst_lab_audits(payloads.dedupe_lab_audits(lab)), urls)
    for df, joins in ((found, 2), (rules_external.external_issues(urls, authority=rank), 1)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == joins and "Broadcast" not in plan and not df.isEmpty()


def test_report_lines_of_many_sites_are_made_after_the_deal(spark, many_customers):
    from siteglass.operators import payloads, report

    field = payloads.field_ratings(derived(spark, many_customers, "field_payloads"))
    runs = payloads.prefer_strategy(payloads.lab_runs(derived(spark, many_customers, "lab_payloads")))
    out = report.technical_lines(field=field, lab=runs)
    depths, lines, dealt = _wide_table_plan(out)
    below = "".join(line for i, n in zip(dealt, depths) for line in lines[i : i + n])
    assert dealt and "parse" not in below.lower()
    # One line for the sites without field data, three for others, none for failed answers.
    kinds = [404 if k % 11 == 0 else 500 if k % 13 == 0 else 200 for k in range(40)]
    want = sum({404: 1, 500: 0, 200: 3}[x] for x in kinds) + 4 * runs.count()
    assert out.count() == want


def test_rows_counted_per_page_site_total_like_the_rows(spark):
    from siteglass.plans.audit import site_total

    pages = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "c")], "site_key string, url string")
    # A customer may come twice, a site may have many customers.
    owners = spark.createDataFrame(
        [("c1", "s1"), ("c1", "s1"), ("c2", "s1"), ("c3", "s2"), ("c4", None)], "customer string, site_key string"
    )
    named = lambda t: t.join(owners, "site_key").drop("site_key").withColumnRenamed("customer", "site_key")
    whole = site_total(named(pages), "n").orderBy("site_key").collect()
    counted = site_total(named(site_total(pages, "n")), "n").orderBy("site_key").collect()
    assert whole == counted and [tuple(r) for r in whole] == [("c1", 4), ("c2", 2), ("c3", 1)]
