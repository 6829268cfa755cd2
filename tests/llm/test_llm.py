"""Operators of the training-data pipeline against brute force on small tables."""

from __future__ import annotations

import collections
import math
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteglass.llm import (
    jaccard, licenses, mixing, neighbours, ngram_lm, packing, quality, queries, revisits, token_counts, url_filter,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, size string"
ODD = [
    (1, None, "en", "a", "x"), (2, "", "en", None, None), (3, "a b", None, "a", None),
    (4, "one two three four five six seven", "en", "b", None), (4, "one two three four five six seven", "en", "b", None),
    (5, "ONE two three four five six seven", "xx", "b", None), (None, "one two", "en", "c", None),
    (6, "word " * 30_000, "en", "c", None), (7, "the MIT License, <|endoftext|> ΣΑΣ 日本 x\x1cy", "en", "c", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize(
    "operator",
    [
        quality.judged, mixing.mixed, jaccard.near_duplicates, licenses.scanned, ngram_lm.scored,
        lambda d: token_counts.token_counts(d, PATH), lambda d: packing.packed(d, PATH),
    ],
)
def test_odd_rows_and_empty_tables(odd, empty, operator):
    assert operator(empty).count() == 0
    rows = operator(odd).collect()
    assert len(rows) >= len(ODD)
    assert collections.Counter(r["doc_id"] for r in rows)[4] == 2


def test_quality_base_counts(docs):
    for r in quality.judged(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = r["text"].encode().split()
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in r["text"])
        lines = [x for x in r["text"].split("\n") if x.encode().split()]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = collections.Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if twice[w] > 1 for j in range(3)}
        assert r["n_repeat_words"] == len(covered)


def _sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def _components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            both = len(a & b) if i < j else 0
            if both and 100 * both >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_jaccard_components(docs):
    sets = _sets(docs.select("doc_id", "text").collect())
    root = _components(sets)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert found == {i: (len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize("name", queries.ORACLES)
def test_rows_equal_their_sql(spark, sf_dir, duck, name):
    found = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    by_text = lambda row: tuple(map(str, row))
    theirs = sorted(found.fetchall(), key=by_text)
    ours = sorted((tuple(r) for r in queries.QUERIES[name](spark, sf_dir).select(columns).collect()), key=by_text)
    assert ours == theirs


def test_pipeline_equals_its_stages_by_hand(spark, docs, sf_dir):
    """What each stage must leave, found on the driver, against the packed pieces."""
    kept = {r["doc_id"]: r["text"] for r in docs.join(quality.judged(docs).where("kept"), "doc_id", "left_semi").collect()}
    root = _components(_sets(kept.items()))
    single = [i for i in kept if root[i] == i]
    assert len(single) < len(kept) < docs.count()
    mixed = mixing.mixed(docs.where(F.col("doc_id").isin(single))).collect()
    library = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for r in mixed:
        ids = np.array([*library.encode(kept[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes())] += r["taken"] // max(r["size"], 1)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert collections.Counter(tuple(r[k] for k in keys) for r in rows) == +want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in places.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 4096



CLASHING = ["n_words", "class_counts", "kept", "_text", "_words", "base_failed", "size", "taken", "target", "_hash",
            "source_size", "nth", "_nth", "hash", "row", "copy", "piece", "start", "sequence_id", "n_tokens", "n_bytes"]


def test_stages_leave_user_columns_alone(spark, odd, docs, sf_dir):
    extra = {c: F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING}
    good = docs.where("n_chars > 500").drop("n_chars").withColumn("size", F.lit("x"))
    table = odd.union(good.select(odd.columns)).withColumns(extra)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, table, sf_dir)
        assert rows.columns == table.columns
        for r in rows.collect():
            assert all(r[c] == f"own {c} {'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING)
        assert stage(spark, table.limit(0), sf_dir).count() == 0
    for operator in (token_counts.token_counts, packing.packed):
        for r in operator(table, PATH, keep=["doc_id", *CLASHING]).collect():
            assert r["row"]["n_tokens"] == f"own n_tokens {'none' if r['row']['doc_id'] is None else r['row']['doc_id']}"
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() >= table.count()


def test_parity_keys_never_miss():
    rng = np.random.default_rng(1)
    for n in [1, 2, 4, 5, 6, 9, 10, 23, 60, 200, 700, 3000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            cut = rng.integers(0, n // 5 + 1)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, rng.integers(0, n // 8 + 1), dtype=np.uint64)]))
            if jaccard.linked(a, b):
                assert len(np.intersect1d(jaccard.join_keys(a), jaccard.join_keys(b)))


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mixed(docs, keep=["doc_id", "source"]).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["row"]["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(r["size"] for r in rows)
    assert math.isclose(sum(v[0]["target"] for v in by.values()), total)
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)


def test_tokens_and_packing_equal_the_library(docs, odd):
    library = Tokenizer.from_file(PATH)
    every = docs.select("doc_id", "text").union(odd.where("doc_id <> 4").select(F.col("doc_id") + 10**6, "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in every.collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in token_counts.token_counts(every, PATH).collect():
        assert (r["n_tokens"], r["n_bytes"]) == (len(ids[r["doc_id"]]), len(texts[r["doc_id"]].encode()))
    space = collections.defaultdict(list)
    for r in packing.packed(every, PATH).collect():
        own = np.array([*ids[r["doc_id"]], 1], "<u4")[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        space[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in space.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_license_places(spark):
    text = "x MIT License mit-license; Licensed under the Apache License, Version 2.0"
    r = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_base"], r["first_word"], r["last_word"]) == (3, 1, 8)
    assert r["base_labels"] == "apache,mit" and r["labels"] == "apache,mit" and r["score"] == 1.0


def test_lm_base_scores(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = collections.Counter()
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    held = [0.0, 0.0]
    for r in ngram_lm.scored(docs).collect():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[r["doc_id"]])
        assert math.isclose(r["base_score"], base, rel_tol=1e-6) and r["train_tokens"] == n
        if r["held_out"]:
            held = [held[0] + r["base_score"], held[1] + r["score"]]
    assert held[1] > held[0]


def _brute_lm(rows):
    """Interpolated scores over all training words; weights from a brute-force histogram."""
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [b"\n"]) for r in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c, pairs = collections.Counter(), collections.Counter()
    for i, w in tokens:
        if not held(i):
            c.update(w)
            pairs.update(zip([b"\n", *w], w))
    n, v = sum(c.values()), len(c)
    cell = lambda a, b: round(4 * math.log2(a / b)) if a > 0 else -9_999
    bucket = lambda x: min(math.ceil(math.log2(x + 1)), ngram_lm.BUCKETS - 1)
    cells = collections.Counter()
    for (a, b), k in pairs.items():
        cells[bucket(c[a]), cell(k - 1, max(c[a] - 1, 1)), cell(c[b] - 1, max(n - 1, 1))] += k
    table = np.array([(*key, k) for key, k in sorted(cells.items())], float).reshape(-1, 4)
    weights = ngram_lm.learned_weights(table, v + 1)
    for i, w in tokens:
        score = 0.0
        for a, b in zip([b"\n", *w], w):
            m = weights[bucket(c[a])]
            score += math.log10(m[0] * pairs[a, b] / max(c[a], 1) + m[1] * c[b] / max(n, 1) + m[2] / (v + 1))
        yield i, held(i), len(w), sum(c[x] > 0 for x in w), n, score


@pytest.mark.parametrize("block", [ngram_lm.BLOCK, 50])
def test_lm_scores_are_those_of_all_words(docs, odd, monkeypatch, block):
    # Small blocks cut texts and give every word and bigram many questions.
    monkeypatch.setattr(ngram_lm, "BLOCK", block)
    for table in (odd, docs):
        key = lambda r: tuple(map(str, r[:5])) + (round(r[5], 3),)
        found = sorted(((r[0], r[1], r[2], r[3], r[4], r["score"]) for r in ngram_lm.scored(table).collect()), key=key)
        want = sorted(_brute_lm([(r["doc_id"], r["text"]) for r in table.collect()]), key=key)
        assert [r[:5] for r in found] == [r[:5] for r in want]
        assert all(math.isclose(a[5], b[5], abs_tol=1e-4) for a, b in zip(found, want))


def test_lm_block_numbers_round_trip():
    x = np.array([0, 1, 255, 256, 1 << 40, (1 << 64) - 1], np.uint64)
    assert (ngram_lm.unpacked(ngram_lm.packed(x)) == x).all() and len(ngram_lm.unpacked(b"")) == 0
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    bounds = ngram_lm._range_bounds(keys, 7)
    assert bounds[0] == 0 and bounds[-1] == 1000 and (np.diff(bounds) > 90).all()


def test_neighbour_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16))
    x[700:760] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0).collect()
    y = np.array(x, np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = np.round(y @ y[q], 12)
        want = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:5]
        hits += len(set(want) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits >= 0.9 * 5 * 30 and max(r["query_id"] for r in found) < 1500


def _all_nearest(rows, q, k=5):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows}
    return [i for _, i in sorted((-round(float(unit[q] @ x), 12), i) for i, x in unit.items() if i != q)][:k]


@pytest.mark.parametrize(
    "rows",
    [
        [(0, [1.0, 2.0]), (1, [-1.0, -2.0])],
        [(i, [1.0, i / 9]) for i in range(3)] + [(10 + i, [-1.0, -i / 7]) for i in range(1, 5)],
        [(i, [float(i % 3 - 1), 1.0, i / 5]) for i in range(1, 40)] + [(50, [0.0, -1.0, -9.0])],
    ],
)
def test_far_vectors_are_candidates_too(spark, rows):
    table = spark.createDataFrame([(i, v, 1, "own") for i, v in rows], "vec_id long, embedding array<double>, node int, w string")
    found = collections.defaultdict(list)
    for r in neighbours.nearest_neighbours(table, F.lit(True)).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert all(len(found[q]) == min(5, len(rows) - 1) for q, _ in rows)
    if len(rows) < 10:
        assert found == {q: _all_nearest(rows, q) for q, _ in rows}


def test_neighbours_of_none_and_of_repeated_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert neighbours.nearest_neighbours(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0])]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], round(r["score"], 9)) for r in found) == [(1, 1, 1.0), (2, 2, 0.0)]


def test_neighbour_rounds_go_on_until_the_graph_settles(spark, monkeypatch):
    # From two projections and few proposals, neighbours come nearer for more than four rounds.
    made, stored = [], neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df, name: made.append(name) or stored(df, name))
    x = np.random.default_rng(5).standard_normal((3000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    neighbours.nearest_neighbours(table, F.col("vec_id") == 0, tables=2, degree=10, proposals=5, beam=10)
    assert made.count("graph") > 5


def test_neighbour_search_walks_to_the_end(spark):
    # Node 9 is the nearest to node 0, nine edges away.
    turn = [0.0] + [(10 - i) / 10 for i in range(1, 10)]
    units = [(i, np.array([np.cos(a), np.sin(a)], np.float16).tobytes()) for i, a in enumerate(turn)]
    graph = spark.createDataFrame([(i, i + 1, float(np.cos(turn[i] - turn[i + 1]))) for i in range(9)], "u long, w long, s float")
    nodes = spark.createDataFrame(units, "node long, unit binary")
    found = neighbours.searched(graph, nodes, nodes.where("node = 0"), beam=4).collect()
    assert (0, 9) in {(r["q"], r["w"]) for r in found}


def test_revisits(spark):
    rows = [
        (1, "http://A.example/p#x", 10, "response", {"ETag": '"1"', "Content-Length": "9"}),
        (2, "https://www.a.example/p", 100_000, "revisit", {"etag": 'W/"1"', "Content-Length": "0", "Age": "3"}),
        (3, "http://a.example/p", 100_000, "response", {"ETag": '"2"'}),
        (4, "http://a.example/p", 300_000, "revisit", {"ETag": '"1"'}),
        (5, "http://b.example/", 5, "revisit", {"ETag": '"1"'}),
        (6, None, 5, "revisit", None),
        (7, "http://a.example/p", 300_001, "revisit", {}),
    ]
    table = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>")
    found = {r["record_id"]: r for r in revisits.resolved(table.withColumn("ts", F.timestamp_seconds("ts"))).collect()}
    assert {i: r["outcome"] for i, r in found.items()} == {
        1: "full", 2: "resolved", 3: "full", 4: "changed", 5: "no_response", 6: "no_response", 7: "no_validator",
    }
    assert found[2]["refers_to"] == 1
    assert found[2]["headers"] == {"etag": 'W/"1"', "content-length": "9", "age": "3"}


def test_url_rules_and_model(spark):
    urls = [
        (1, "http://X.example.org/es/1"), (2, "https://a.org/x?y"), (3, "http://www.casino-win.example.net/en/3"),
        (4, "http://city-museum.example.net/en/3#t"), (5, None), (6, "nothing"), (7, "http://a.org"),
    ]
    model = url_filter.fit(url_filter.labelled_urls(spark))
    found = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(urls, "page_id long, url string"), model).collect()}
    assert [found[i]["rule"] for i in range(1, 8)] == ["example.org/es/", "org/", None, None, None, None, None]
    assert [found[i]["verdict"] for i in range(1, 5)] == ["block", "allow", "block", "allow"]
    assert (found[5]["host"], found[6]["path"]) == ("", "") and found[1]["host"] == "x.example.org"
