"""Streams over several batches with late and repeated rows against their batch forms."""

from __future__ import annotations

import random

import pytest

from siteglass.operators import payments
from siteglass.sources import schemas
from siteglass.streaming import ledger


def _events(n, seed=5):
    draw = random.Random(seed)
    names = ["payment.captured", "payment.authorized", "payment.failed", "refund.processed", "order.paid"]
    pick = lambda *xs: draw.choice([None, *xs])
    return [
        (i, draw.choice(names), draw.choice(["o1", "o1", "o2", "o3", "gone"]), pick("p1", "p2"), pick("a@b.c"),
         pick("1"), pick("upi", "card"), pick("E1"), pick("Declined"))
        for i in range(n)
    ]


def stream_of(spark, folder, rows, schema, batches=4, shuffle=7, repeats=0):
    """Rows in random order as a stream of as many batches; some rows come twice."""
    draw = random.Random(shuffle)
    rows = rows + draw.sample(rows, repeats)
    draw.shuffle(rows)
    size = -(-len(rows) // batches)
    for at in range(0, len(rows), size):
        part = spark.createDataFrame(rows[at : at + size], schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


ORDERS = [("o1",), ("o2",), ("o3",), ("quiet",)]


@pytest.mark.parametrize("bits", [ledger.SLICE_BITS, 3])
def test_late_events_give_the_batch_ledger(spark, tmp_path, monkeypatch, bits):
    # Slices of eight numbers spread an order over many keys.
    monkeypatch.setattr(ledger, "SLICE_BITS", bits)
    rows = _events(120)
    orders = spark.createDataFrame(ORDERS, "order_id string")
    want = payments.payment_ledger(spark.createDataFrame(rows, schemas.PAYMENT_EVENTS), orders)
    stream = stream_of(spark, tmp_path / "events", rows, schemas.PAYMENT_EVENTS, repeats=20)
    found = ledger.run_ledger(spark, stream, orders)
    assert found.orderBy("order_id").collect() == want.select(found.columns).orderBy("order_id").collect()


def test_a_late_refund_brings_back_a_later_capture(spark, tmp_path):
    tail = ("a@b.c", None, None, None, None)
    rows = [(1, "payment.captured", "o1", "p1", *tail), (5, "payment.captured", "o1", "p2", *tail),
            (3, "refund.processed", "o1", None, *tail)]
    for row in rows:
        spark.createDataFrame([row], schemas.PAYMENT_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schemas.PAYMENT_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    (found,) = ledger.run_ledger(spark, stream, spark.createDataFrame(ORDERS[:1], "order_id string")).collect()
    assert (found["status"], found["payment_id"], found["paid_seq"]) == ("captured", "p2", 5)


def test_status_of_known_orders_only(spark, tmp_path):
    rows = _events(90)
    orders = spark.createDataFrame(ORDERS, "order_id string")
    want = payments.payment_ledger(spark.createDataFrame(rows, schemas.PAYMENT_EVENTS), orders).collect()
    stream = stream_of(spark, tmp_path / "events", rows, schemas.PAYMENT_EVENTS)
    found = {r["order_id"]: r["status"] for r in ledger.run_status(spark, stream, orders).collect()}
    assert found == {r["order_id"]: r["status"] for r in want if r["order_id"] != "quiet"}


def test_outcomes_follow_a_late_earlier_claim(spark, tmp_path):
    schema = "seq long, order_id string, payment_id string"
    draw = random.Random(2)
    rows = [(i, f"o{draw.randint(1, 4)}", f"p{draw.randint(1, 9)}") for i in range(80)]
    want = payments.checkout_confirm(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    stream = stream_of(spark, tmp_path / "claims", rows, schema, batches=5)
    found = ledger.run_outcomes(spark, stream).orderBy("seq").collect()
    assert found == want and {r["outcome"] for r in found} == {"recorded", "repeated", "rejected"}


def test_site_findings_from_merged_state(spark, tmp_path):
    from pyspark.sql import functions as F

    from siteglass.operators import links, sites
    from siteglass.operators.rules import union_issues
    from siteglass.operators.signals import extract_signals, looks_like_html
    from siteglass.streaming.pages import SiteState

    link = lambda *ids: "".join(f"<a href='/{i}'>x</a>" for i in ids)
    rows = [
        (i, f"https://s{i % 3}.example/{i if i > 2 else ''}", f"<html><head><title>t{i % 4}</title>"
         f"<meta name='description' content='d{i % 5}'></head><body>{'word ' * 200}{link(i + 3, i + 6)}</body></html>")
        for i in [*range(24), 50]
    ] + [(90, "https://s0.example/x", "no page"), (91, "https://s1.example/y", None)]
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(rows, schema)
    signals = extract_signals(pages.where(looks_like_html(F.col("html"))))
    facts = sites.site_facts(signals)
    want = union_issues(
        sites.duplicate_issues(sites.duplicate_values(signals, "title"), "dup-titles"),
        sites.duplicate_issues(sites.duplicate_values(signals, "meta_description"), "dup-metas"),
        sites.crawl_site_issues(facts),
        links.orphan_issues(
            links.orphan_pages(links.link_edges(signals), links.page_urls(signals), facts.select("site_key", "base_url"))
        ),
    )
    # The home pages, first in order, may come last.
    stream = stream_of(spark, tmp_path / "pages", rows, schema, batches=3)
    state = SiteState(spark, stream, files_per_batch=1)
    order = ["site_key", "issue_key", "affected_url"]
    found = state.issues()
    assert found.orderBy(order).collect() == want.orderBy(order).collect()
    keys = {r["issue_key"] for r in want.collect()}
    assert keys >= {"dup-titles", "dup-metas", "orphan-page", "low-schema-coverage"}
    # Every batch reads the pages of one file, not those before.
    for updates in state.batches.values():
        assert len(updates.rows_read) == 3 and sum(updates.rows_read) == 25


def test_streams_read_a_table_stored_as_a_file_or_a_folder(spark, tmp_path):
    from siteglass.plans.catalog import QUERIES

    row = "<html><head><title>t</title></head><body>{}</body></html>"
    pages = spark.createDataFrame(
        [(i, f"https://s{i % 2}.example/{i}", row.format("word " * i)) for i in range(1, 9)],
        "page_id long, url string, html string",
    )
    folder, file = tmp_path / "folder", tmp_path / "file"
    file.mkdir()
    pages.repartition(3).write.parquet(str(folder / "pages.parquet"))
    pages.coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("part-*.parquet")
    (file / "pages.parquet").write_bytes(part.read_bytes())
    (file / "other.parquet").write_bytes(b"no table")
    for name in ("site_rules_stream", "audit_stream"):
        found = [sorted(QUERIES[name](spark, str(d)).collect()) for d in (folder, file)]
        assert found[0] == found[1] and found[0]


def test_a_stream_without_pages_has_no_findings(spark, tmp_path):
    from siteglass.streaming.pages import SiteState, run_site_issues

    schema = "page_id long, url string, html string"
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(schema).parquet(str(tmp_path / "none"))
    assert run_site_issues(spark, empty).isEmpty()
    assert SiteState(spark, empty).issues().isEmpty()
