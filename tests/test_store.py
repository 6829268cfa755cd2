"""Saved audits: runs written twice, refreshes that leave other partitions alone."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from siteglass.operators import scoring
from siteglass.operators.rules import ISSUE_COLUMNS
from siteglass.plans.audit import AuditInputs, audit_signals
from siteglass.operators.signals import extract_signals
from siteglass.sources import tables
from siteglass.sources.derived import crawl_pages

AUDITS = "audit_id long, site_key string, created_at timestamp, total_issues long, critical_count long, overall_score long"
ISSUE = "audit_id long, site_key string, issue_key string, severity string, title string, affected_url string"
REST = {"stage": "int", "page_seq": "long", "rule_seq": "int", "category": "string", "description": "string",
        "recommendation": "string"}


def _issues(spark, rows):
    table = spark.createDataFrame(rows, ISSUE)
    return table.withColumns({c: F.lit(None).cast(t) for c, t in REST.items()} | {"page_id": F.lit(None).cast("long")})


def _files(root, name):
    found = {}
    for folder, _, files in os.walk(f"{root}/{name}"):
        for f in files:
            if f.endswith(".parquet"):
                found[os.path.join(folder, f)] = os.path.getmtime(os.path.join(folder, f))
    return found


@pytest.fixture
def saved_run(spark, tmp_path):
    audits = spark.createDataFrame(
        [(i, f"s{i}", None, 0, 0, 50) for i in range(1, 7)], AUDITS
    ).withColumn("created_at", F.date_add(F.lit("2024-03-01").cast("date"), (F.col("audit_id") / 2).cast("int")).cast("timestamp"))
    pages = spark.createDataFrame(
        [(i, i * 10, 1, f"https://s{i}/") for i in range(1, 7)], "audit_id long, page_id long, page_seq long, url string"
    )
    rows = []
    for i in range(1, 7):
        rows.append((i, f"s{i}", "dns-no-spf", "notice", "old dns", f"https://s{i}/"))
        if i != 6:  # audit 6, alone on its day, has nothing else
            rows.append((i, f"s{i}", "missing-title", "critical", "no title", f"https://s{i}/"))
    write = lambda: tables.write_audit(audits, pages, _issues(spark, rows), str(tmp_path / "store"), run="first")
    write()
    return str(tmp_path / "store"), write


def test_a_run_written_twice_is_there_once(spark, saved_run):
    root, write = saved_run
    counts = lambda: [spark.read.parquet(f"{root}/{n}").count() for n in ("audits", "pages", "issues")]
    assert counts() == [6, 6, 11]
    write()
    assert counts() == [6, 6, 11]
    with pytest.raises(ValueError):
        tables.write_audit(*[spark.range(1)] * 3, root, run="2024-01-01")


def test_refresh_replaces_touched_audits_only(spark, saved_run):
    root, _ = saved_run
    before = {n: _files(root, n) for n in ("issues", "audits", "pages")}
    touched = spark.createDataFrame([(2,), (6,)], "audit_id long")
    new = _issues(spark, [(2, "s2", "dns-no-mx", "warning", "new dns", "https://s2/"),
                          (2, "s2", "dns-no-mx", "notice", "new dns", "https://s2/other")])
    for _ in range(2):  # an attempt may be repeated
        summary = {r["audit_id"]: r for r in tables.refresh_audits(spark, root, "dns", touched, new).collect()}
        assert {k: r["total_issues"] for k, r in summary.items()} == {"2": 3, "6": 0}
        stored = spark.read.parquet(f"{root}/issues").collect()
        found = sorted((r["audit_id"], r["issue_key"], r["page_id"]) for r in stored if r["audit_id"] in (2, 3, 6) and r["page_id"])
        assert found == [(2, "dns-no-mx", 20), (2, "missing-title", 20), (3, "dns-no-spf", 30), (3, "missing-title", 30)]
        assert sum(r["page_id"] is None for r in stored) == 1 and len(stored) == 11
        audits = {r["audit_id"]: r for r in spark.read.parquet(f"{root}/audits").collect()}
        assert (audits[2]["total_issues"], audits[2]["critical_count"], audits[2]["overall_score"]) == (3, 1, 50)
        assert (audits[6]["total_issues"], audits[3]["total_issues"]) == (0, 0) and len(audits) == 6
    after = {n: _files(root, n) for n in ("issues", "audits", "pages")}
    assert after["pages"] == before["pages"]
    for name in ("issues", "audits"):
        same = [f for f in before[name] if after[name].get(f) == before[name][f]]
        assert {f.split("audit_date=")[1][:10] for f in same} == {"2024-03-01", "2024-03-03"}
    assert not any("2024-03-04" in f for f in after["issues"])


def test_refresh_scores_touched_audits_again(spark, sf_dir, tmp_path):
    signals = extract_signals(crawl_pages(spark, sf_dir))
    facts = audit_signals(signals, AuditInputs(None)).facts
    some = [r["site_key"] for r in facts.select("site_key").orderBy("site_key").limit(3).collect()]
    number = F.array_position(F.array(*map(F.lit, some)), F.col("site_key")).cast("long")
    facts = facts.where(F.col("site_key").isin(some)).withColumn("audit_id", number)
    rows = [(i, site, None, 0, 0, -1) for i, site in enumerate(some, 1)]
    audits = spark.createDataFrame(rows, AUDITS)
    pages = spark.createDataFrame([(1, 1, 1, "u")], "audit_id long, page_id long, page_seq long, url string")
    root = str(tmp_path / "store")
    tables.write_audit(audits, pages, _issues(spark, [(1, some[0], "noindex", "critical", "t", "u")]), root)
    touched = audits.where("audit_id < 3")
    tables.refresh_audits(spark, root, "dns", touched, _issues(spark, []), facts)
    want = {r["site_key"]: r["overall_score"] for r in scoring.category_scores(facts).collect()}
    got = {r["site_key"]: r["overall_score"] for r in spark.read.parquet(f"{root}/audits").collect()}
    assert got == {some[0]: want[some[0]], some[1]: want[some[1]], some[2]: -1}
    assert set(ISSUE_COLUMNS) <= set(spark.read.parquet(f"{root}/issues").columns)


def test_only_days_are_sent_to_every_task(spark, saved_run):
    """However small the files look: a row per audit goes through shuffles, never to the driver."""
    root, write = saved_run

    def executions():  # Spark forgets all but the last thousand
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {x.executionId(): x for x in map(found.apply, range(found.size()))}

    begun = max(executions())
    write()
    touched = spark.createDataFrame([(2,), (2,), (6,), (None,)], "audit_id long")
    new = _issues(spark, [(2, "s2", "dns-no-mx", "warning", "new dns", "https://s2/"),
                          (3, "s3", "dns-no-mx", "warning", "new dns", "https://s3/")])
    void = new.withColumn("note", F.lit(None))
    summary = tables.refresh_audits(spark, root, "dns", touched, void).collect()
    assert {r["audit_id"]: (r["total_issues"], r["warning_count"]) for r in summary} == {"2": (2, 1), "6": (0, 0)}
    found = spark.read.parquet(f"{root}/issues").select("audit_id", "issue_key").collect()
    old = [(i, k) for i in (1, 3, 4, 5) for k in ("dns-no-spf", "missing-title")]
    assert sorted(map(tuple, found)) == sorted([*old, (2, "dns-no-mx"), (2, "missing-title")])
    plans = "".join(x.physicalPlanDescription() for i, x in executions().items() if i > begun)
    assert "SortMergeJoin" in plans and "BroadcastNestedLoopJoin" not in plans
    keys = re.findall(r"\) BroadcastHashJoin.*\nLeft keys \[\d+\]: \[(.*)\]", plans)
    assert keys and {re.sub(r"#\w+", "", k) for k in keys} == {"run, audit_date"}


def test_html_meets_no_exchange(spark, sf_dir, tmp_path):
    pages = crawl_pages(spark, sf_dir)
    root = str(tmp_path)
    pages.select("page_id", "url", "html").write.parquet(f"{root}/pages")
    meta = pages.select(
        "page_id", F.col("status_code").cast("int").alias("status_code"), F.col("load_time_ms").cast("long").alias("load_time_ms"),
        "headers", F.when(F.col("page_id") == 3, "timeout").alias("error"),
    )
    meta.write.parquet(f"{root}/meta")
    found = tables.read_page_signals(spark, f"{root}/pages", f"{root}/meta")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert len(joins) == 1
    # Above the join stand signals alone.
    above = plan.split("Join")[0]
    assert "html#" not in above
    want = extract_signals(pages.where("page_id <> 3")).select("page_id", "status_code", "is_indexable", "response_headers")
    got = found.select(want.columns).orderBy("page_id").collect()
    assert got == want.orderBy("page_id").collect()
    failures = tables.fetch_failures(tables.read_pages(spark, f"{root}/pages"), tables.read_fetch_meta(spark, f"{root}/meta"))
    assert [(r["page_id"], r["error"]) for r in failures.collect()] == [(3, "timeout")]
