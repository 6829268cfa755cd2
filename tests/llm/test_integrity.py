"""Merkle manifest, language mixtures and conversation trie against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteglass.llm import conversation_trie, language_mix, merkle, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, _id int, grp string"
ODD = [
    (1, None, "en", None, "x"), (None, "s", None, 3, None), (None, "s", None, 3, None), (4, "é", "fr", 3, ""),
    (4, "é", "fr", 3, ""), (4, "b", "fr", 3, ""), (5, "a", "", 2, "日" * 5), (6, "a", "", 2, "word " * 50_000),
    *[(i, "s", "zz", i, "t") for i in range(20, 57)],
]
ODD = [(*r, "own", 9, "own") for r in ODD]
TURNS = "conv_id long, turn long, role string, text string, depth int, bytes string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple(map(str, row))


def brute_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, add=0):
        n = None if r[3] is None else r[3] + add
        return digest("".join(map(field, (r[0], r[1], r[2], n, r[4]))))

    def grown(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
            levels.append(nodes)
        return levels

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    for group in groups.values():
        group.sort(key=lambda x: x[:3])
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: grown([x[2] for x in groups[g]]) for g in groups}
    top = grown([trees[g][-1][0] for g in order])
    root = top[-1][0]
    for at, g in enumerate(order):
        for i, (known, number, own, r) in enumerate(groups[g]):
            node = leaf(r, 1) if known and zlib.crc32(str(number).encode()) % 7 == 0 else own
            siblings = []
            for tree, place in ((trees[g], i), (top, at)):
                for level in tree[:-1]:
                    other = place ^ 1
                    if other < len(level):
                        siblings.append(level[other])
                        node = digest(level[other] + node if other < place else node + level[other])
                    else:
                        node = digest(node)
                    place //= 2
            yield r[0], own, trees[g][-1][0], root, digest("".join(siblings)), node, node == root


def manifest_rows(docs, levels=merkle.BLOCK_LEVELS):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claims = {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    rows = merkle.verified(merkle.manifest(docs, claims=claims, levels=levels))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in rows.select(names).collect()]


@pytest.mark.parametrize("levels", [1, 2, merkle.BLOCK_LEVELS])
def test_manifest_of_odd_rows(spark, levels):
    table = spark.createDataFrame(ODD, DOCS).repartition(3)
    assert sorted(manifest_rows(table, levels), key=key) == sorted(brute_manifest(ODD), key=key)


def test_manifest_of_all_documents_and_of_none(spark, sf_dir):
    rows = [tuple(r) for r in queries.op11_merkle_manifest(spark, sf_dir).collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert sorted(rows, key=key) == sorted(brute_manifest([tuple(r) for r in docs.collect()]), key=key)
    assert 0 < sum(not r[-1] for r in rows) < len(rows)
    assert manifest_rows(spark.createDataFrame([], DOCS)) == []
    (alone,) = manifest_rows(spark.createDataFrame(ODD[:1], DOCS))
    assert alone[1] == alone[2] == alone[3] and alone[4] == digest("")


def test_witnesses_grow_as_leaves_come():
    tree = merkle.Witnesses()
    tree.append("a")
    assert tree.paths == [[]]
    tree.append("b")
    assert tree.paths == [[{"left": None, "right": "b"}], [{"left": "a", "right": None}]]
    tree.append("c")
    assert [len(p) for p in tree.paths] == [1, 1, 0]
    assert tree.close() == digest(digest("ab") + digest("c"))


# language mixtures


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return language_mix.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries.op12_language_mix(spark, sf_dir).join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_counts_are_those_of_all_training_texts(spark, sf_dir, model):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = np.zeros_like(model.counts)
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5:
            found, n = language_mix.trigrams(r["text"])
            want[model.languages.index(r["lang"])][found] += n
    assert (want == model.counts).all()


def test_mixtures_find_both_languages(spark, sf_dir, model):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 800 and lang in ('de', 'es')").collect()
    parts = {lang: next(r["text"][:800] for r in rows if r["lang"] == lang) for lang in ("de", "es")}
    found = dict(model.infer(parts["de"] + " " + parts["es"]))
    assert set(found) >= {"de", "es"} and min(found["de"], found["es"]) > 0.3
    assert [x[0] for x in model.infer(parts["de"])] == ["de"]


def test_language_of_odd_rows(spark, model):
    rows = [(1, None, 1), (2, "", 2), (3, "12 !? 日本", 3), (4, "1234 --", 4), (None, "the thing", 5), (None, "the thing", 5)]
    rows += [(7, "ein " * 400_000, 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = language_mix.predicted(table, model, keep=["score", "text"]).collect()
    assert [(r["lang_pred"] == "und", r["score"] == 0) for r in found if r["doc_id"] in (1, 2, 4)] == [(True, True)] * 3
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [True, True]
    assert [(r["row"]["score"], r["row"]["text"]) for r in found] == [(r[2], r[1]) for r in rows]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = language_mix.fit(empty)
    assert nothing.languages == [] and language_mix.predicted(empty, nothing).count() == 0
    assert {r["lang_pred"] for r in language_mix.predicted(table, nothing).collect()} == {"und"}


def test_long_texts_are_counted_whole(monkeypatch):
    text = "alpha beta gamma " * 500
    want = language_mix.trigrams(text)
    monkeypatch.setattr(language_mix, "STRETCH", 100)
    found = language_mix.trigrams(text)
    assert (found[0] == want[0]).all() and (found[1] == want[1]).all()


# conversations


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", digest(text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own_saving = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own_saving + sum(saved[x] for x in children[node])
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        yield min(convs), len(node), above, len(convs), len(children[node]), leaves[node], saved[node], digest(ends)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(turns, shard=conversation_trie.SHARD):
    nodes = conversation_trie.prefix_trie(conversation_trie.rebuilt(turns), shard)
    return sorted((tuple(r) for r in nodes.select(NAMES).collect()), key=key)


def _drawn():
    draw = random.Random(1)
    return [(c, t, "ab"[t % 2], draw.choice("pq")) for c in range(200) for t in range(draw.randint(1, 12))]


ODD_TURNS = [
    (None, 1, "a", "b"), (7, None, "u", None), (7, None, "u", None), (7, 2, None, "é"), (5, 1, "u", "x"),
    (6, 1, "u", "x"), (8, 1, "u", "x"), (9, 1, "u", "x"), (9, 2, "u", "y"), (10, 0, "u", ""), (10, 1, "", "z" * 300_000),
]


@pytest.mark.parametrize("rows, shard", [(ODD_TURNS, 2), (_drawn(), 9)])
def test_trie_of_small_tables(spark, rows, shard):
    rows = [(*r, 7, "own") for r in rows]
    assert trie_rows(spark.createDataFrame(rows, TURNS).repartition(3), shard) == sorted(brute_trie(rows), key=key)


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "STRETCH_BITS", 3)
    rows = [(c, t, "u", str(t), 0, "") for c, n in ((3, 90), (20, 150), (21, 130), (22, 40)) for t in range(n)]
    assert trie_rows(spark.createDataFrame(rows, TURNS)) == sorted(brute_trie(rows), key=key)


def test_trie_of_all_conversations_and_of_none(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = sorted((tuple(r) for r in queries.op13_conversation_trie(spark, sf_dir).select(NAMES).collect()), key=key)
    assert found == sorted(brute_trie([tuple(r) for r in turns.collect()]), key=key)
    assert trie_rows(spark.createDataFrame([], TURNS)) == []


def test_closing_parentheses():
    draw = np.random.default_rng(4)
    for _ in range(20):
        opens, depth, left = [], 0, int(draw.integers(1, 400))
        while left or depth:
            up = left and (depth == 0 or draw.random() < 0.55)
            opens.append(bool(up))
            depth, left = (depth + 1, left - 1) if up else (depth - 1, left)
        stack, want = [], {}
        for i, up in enumerate(opens):
            if up:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = conversation_trie.Parentheses(np.array(opens))
        places = np.flatnonzero(opens)
        assert tree.find_close(places).tolist() == [want[i] for i in places.tolist()]
