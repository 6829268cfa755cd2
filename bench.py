"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Each query writes
to the ``noop`` sink, so all rows and columns are produced. One warm-up run, then the
median of ``BENCH_RUNS`` runs (one unless set). Times include query planning.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from siteglass.plans.audit import AuditInputs, run_audit
from siteglass.plans.catalog import QUERIES
from siteglass.session import build_session, work_folder
from siteglass.sources.derived import crawl_pages

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = (
    "page_signals_text", "page_rules", "issue_groups", "worst_sites", "inbound_counts",
    "orphan_pages", "link_status", "lab_findings", "external_findings", "category_scores",
    "report_groups", "crawl_rank", "ip_usage", "usage_overview", "payment_stats",
    "payments_with_audit_url", "payment_ledger", "payment_status_stream",
)


def _full_audit(spark, sf_dir):
    """The whole audit of every site; groups and scores are written."""
    result = run_audit(AuditInputs(crawl_pages(spark, sf_dir)), work_folder(spark, "bench"))
    return result.groups.join(result.scores, "site_key")


def _seconds(spark, fn) -> float:
    start = time.perf_counter()
    fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        "siteglass-bench",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name, fn in [("full_audit", _full_audit), *((n, QUERIES[n]) for n in HEADLINE)]:
        _seconds(spark, fn)
        timings[name] = round(statistics.median(_seconds(spark, fn) for _ in range(RUNS)), 3)
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
