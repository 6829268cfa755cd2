"""Near duplicates by n-gram Jaccard similarity, joined on parity sketches.

Every text becomes its set of word shingles. Sets of like size share a band, and in a band
every set is sketched in ``m`` cells: a cell holds the XOR of the hashes of its shingles.
Two sets that differ in ``d`` shingles differ in at most ``d`` cells, so the number of
differing cells is a lower bound of the symmetric difference. A pair of the asked
similarity differs in at most ``k`` shingles; with more than ``k`` cells at least one cell is
equal (pigeonhole), so joining equal cells loses no pair. ``m`` exceeds ``k + 1`` by some
spare cells, since a cell empty on both sides says nothing: a set with fewer than ``m - k``
empty cells shares a filled one with each partner. The few sets with more are also joined
by their least shingle hashes (prefix filter).

Copies are one class from the start. The sets in a cell are first compared with the least
of them only. Pairs that are still in different components, but met around the same
least set, are compared afterwards unless sizes or a parity sketch of the whole set, about a
bit per shingle, exclude them; so
links within a large group are never spelled out, and no component is missed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import discard, stored

WORDS = 5
SIMILARITY = (80, 100)  # linked when 100 * intersection >= 80 * union
REMEMBERED = 400_000
_U = np.uint64
_FACTORS = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHash(dict):
    """Hash of a word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_word_hash = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a whole text.

    A to Z are lower-cased; words are runs without ASCII white space. Fewer than five
    words are one shingle; no word, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_word_hash.__getitem__, words), _U, len(words))
    n = min(len(words), WORDS)
    total = np.full(len(words) - n + 1, n, _U)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * _FACTORS[j]
    return np.unique(_mixed(total))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def _bands(limit: int = 1 << 40) -> list[int]:
    """Smallest set size of each band; a band ends before 1.4 times its start."""
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, ceil(starts[-1] * 1.4)))
    return starts


_STARTS = _bands()


def cells_of_band(band: int) -> tuple[int, int]:
    """(k, m): differing shingles allowed when the smaller set is in the band, and cells."""
    k = (_STARTS[band + 1] - 1) // 4
    return k, k + 6 + ceil(0.12 * k)


def join_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys such that linked sets share at least one."""
    n = len(hashes)
    own = band = bisect_right(_STARTS, n) - 1
    keys, sparse = [], False
    # A set joins its own band, and smaller ones whose sets can have a partner of its size.
    while band >= 0 and (band == own or 4 * n <= 5 * (_STARTS[band + 1] - 1)):
        k, m = cells_of_band(band)
        cell = (hashes >> _U(20)) % _U(m)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        starts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
        parity = np.bitwise_xor.reduceat(hashes[order], starts)
        place = cell[starts] * _FACTORS[1] + _U((band + 1) * int(_FACTORS[2]) % (1 << 64))
        keys.append(_mixed(parity ^ _mixed(place)))
        sparse |= len(starts) <= k
        band -= 1
    if sparse:
        least = n - -(-SIMILARITY[0] * n // SIMILARITY[1]) + 1
        keys.append(_mixed(hashes[:least] ^ _FACTORS[3]))
    return np.concatenate(keys)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bits of a set, 512 or the power of two from its size on.

    Differing bits never exceed differing shingles. The two halves of a longer sketch give
    the next shorter one by XOR.
    """
    size = max(512, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 512
    odd = np.bincount((hashes & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """One row per document: set size, digest, sketch and join keys.

    Of copies read by one task only the first has join keys; so a text that fills the
    table adds its keys once per task.
    """
    fields = "doc_id long, n_shingles long, digest1 long, digest2 long, sketch array<long>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            sizes, digests, sketches, keys = [], [], [], []
            for doc_id, text in zip(ids.to_pylist(), batch.column("text").to_pylist()):
                hashes = shingle_hashes(text)
                digest = (
                    int(np.bitwise_xor.reduce(_mixed(hashes ^ _FACTORS[0])).view(np.int64)) if len(hashes) else 0,
                    int(_mixed(hashes ^ _FACTORS[4]).sum().astype(_U).view(np.int64)) if len(hashes) else 0,
                )
                sizes.append(len(hashes))
                digests.append(digest)
                sketches.append(parity_sketch(hashes))
                new = len(hashes) and doc_id is not None and (*digest, len(hashes)) not in seen
                if new:
                    seen.add((*digest, len(hashes)))
                keys.append(join_keys(hashes).view(np.int64) if new else None)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(sizes, pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(sketches, pa.list_(pa.int64())),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest1", "digest2", "sketch", "keys"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(make, fields + ", keys array<long>")


def _possible(a: str, b: str) -> Column:
    """Sizes and sketches of two rows allow the similarity."""
    n, other = F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")
    one, two = F.col(f"{a}sketch"), F.col(f"{b}sketch")
    size = F.least(F.size(one), F.size(two))

    def folded(sketch: Column) -> Column:
        halves = F.zip_with(
            F.slice(sketch, F.lit(1), size), F.slice(sketch, size + 1, size), lambda x, y: x.bitwiseXOR(y)
        )
        return F.when(F.size(sketch) > size, halves).otherwise(sketch)

    bits = F.zip_with(folded(one), folded(two), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    near = 9 * F.aggregate(bits, F.lit(0), lambda total, x: total + x) <= n + other
    return (5 * F.least(n, other) >= 4 * F.greatest(n, other)) & near


def _with_sets(pairs: DataFrame, sets: DataFrame, *ends: str) -> DataFrame:
    for end in ends:
        renamed = sets.select([F.col(c).alias(end if c == "rep" else f"{end}_{c}") for c in ["rep", "n_shingles", "sketch"]])
        pairs = pairs.join(renamed, end)
    return pairs


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts are linked."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[str | None, np.ndarray] = OrderedDict()

        def hashes(text: str | None) -> np.ndarray:
            if text not in recent:
                recent[text] = shingle_hashes(text)
                if len(recent) > 32:
                    recent.popitem(last=False)
            return recent[text]

        for batch in batches:
            texts = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
            mask = pa.array([linked(hashes(a), shingle_hashes(b)) for a, b in texts], pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(test, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Set size and component of every document: (doc_id, n_shingles, component_id).

    ``component_id`` is the least ``doc_id`` reachable by links. A text without words (or
    null) has an empty set and is its own component. Rows equal in ``doc_id`` are one node
    with one row each; a row without ``doc_id`` takes the component of its exact copies,
    null if there is none. An empty table gives no rows; further columns are left out.
    """
    with_keys = stored(shingle_sets(docs), "shingle-keys")
    sets = stored(with_keys.drop("keys"), "shingle-sets")
    same = ["n_shingles", "digest1", "digest2"]
    filled = sets.where("n_shingles > 0")
    classes = stored(
        filled.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")),
        "shingle-classes",
    )
    member = stored(
        filled.where("doc_id is not null").select("doc_id", *same)
        .join(classes.select(*same, "rep"), same).select("doc_id", "rep").distinct(),
        "shingle-members",
    )

    # Sets that share a key, each with the least set there.
    keyed = with_keys.where("keys is not null").select("doc_id", F.explode("keys").alias("key"))
    met = keyed.withColumn("least", F.min("doc_id").over(Window.partitionBy("key")))
    met = met.where("doc_id <> least").select("least", "doc_id").distinct()
    for end, out in (("least", "g"), ("doc_id", "x")):
        met = met.join(member.select(F.col("doc_id").alias(end), F.col("rep").alias(out)), end)
    around = stored(met.where("g <> x").select("g", "x").distinct(), "shingle-met")
    discard(with_keys)

    pairs = around.select(F.least("g", "x").alias("a"), F.greatest("g", "x").alias("b")).distinct()
    tested = _with_sets(pairs, classes, "a", "b").where(_possible("a_", "b_")).select("a", "b")
    links = stored(verified(tested, docs), "shingle-links")
    found = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "shingle-components")

    # Members around one least set that are in different components still.
    def root(df: DataFrame, end: str) -> DataFrame:
        named = found.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        return df.join(named, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))

    placed = stored(_with_sets(root(root(around, "g"), "x"), classes, "x"), "shingle-placed")
    apart = placed.where("x_root <> g_root")
    left = apart.select([F.col(c).alias(c.replace("x", "l", 1) if c.startswith("x") else c) for c in apart.columns])
    right = placed.drop("g_root")
    crossed = left.join(right, "g").where((F.col("l_root") != F.col("x_root")) & _possible("l_", "x_"))
    rest = crossed.select(F.least("l", "x").alias("a"), F.greatest("l", "x").alias("b")).distinct()
    rest = stored(rest.join(tested, ["a", "b"], "left_anti"), "shingle-rest")
    if rest.isEmpty():
        final = found
    else:
        more = stored(verified(rest, docs), "shingle-more-links")
        final = found
        if not more.isEmpty():
            every = links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
            final = stored(components(every), "shingle-components")
    discard(around, placed, rest)
    rows = sets.select("doc_id", *same).join(classes.select(*same, "rep"), same, "left")
    rows = rows.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return rows.select(
        "doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id")
    )
