"""Language-model scores by deleted interpolation.

A bigram model over all training words and the end of a text: maximum-likelihood estimates of
bigram, unigram and uniform distribution are mixed, with weights that depend on how often the
context was seen. The weights of each frequency bucket are learned by expectation-maximisation
on held-out counts: every training bigram is held out in turn, that is, judged by the counts
without its own occurrence.

Texts are read once and kept as blocks of word hashes, about ``BLOCK`` tokens each. A block asks
for the counts of its distinct words and bigrams: sorted keys, cut at the bounds of equal ranges
of hashes, with how often the block holds each in training. What all blocks ask of one range
meets in one task, which adds up and answers each block in the order of its question. So counts
are exact for every word and bigram, whatever their number, none goes through the driver, and
even the most frequent one takes at most one place in each block's question.

Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructType

from .storage import discard, stored

END = xxhash.xxh64_intdigest(b"\nend") - (1 << 63)  # no word holds a line break
DIGITS = 1_000_000_000  # scores are summed as whole billionths, so that order doesn't matter
BUCKETS = 24
STEPS = 4  # histogram cells per doubling of a probability
REMEMBERED = 400_000
BLOCK = 1 << 17
#: Tokens of the corpus per range of hashes, about: bounds what one task adds up.
RANGE = 2_000_000
ONCE = 1 << 63


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text; A to Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def remainder(doc_id) -> int:
    """crc32 of the id as text, modulo 5; a missing id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


class _Hashes(dict):
    """Hash of a word, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word) - ONCE
        return found


def bigram_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One hash for each pair of hashes."""
    a, b = contexts, words
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def packed(numbers: np.ndarray, kind: str = "<u8") -> bytes:
    """Unsigned numbers as all first bytes, all second ones and so on: small ones compress well."""
    rows = numbers.astype(kind, copy=False).view(np.uint8).reshape(len(numbers), -1)
    return np.ascontiguousarray(rows.T).tobytes()


def unpacked(raw: bytes, kind: str = "<u8") -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Block:
    """Pieces of texts, read back, as places in the block's list of words.

    ``words`` has the place of each token, ``contexts`` that of the word before, of the end
    before a text. ``known`` are the hashes in descending order of their occurrences.
    """

    def __init__(self, table: pa.RecordBatch, row: int):
        at = {name: table.column(name)[row] for name in ("length", "first", "held", "known", "words")}
        self.length = np.array(at["length"].as_py(), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.known = np.frombuffer(at["known"].as_buffer(), "<u8")
        self.words = unpacked(at["words"].as_buffer(), "<u4").astype(np.int64)
        self.contexts = np.concatenate([[0], self.words[:-1]])
        self.contexts[self.starts] = at["first"].as_py()
        self.trained = np.repeat(~np.array(at["held"].as_py(), bool), self.length)

    def asked_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted hashes, which of ``known`` each is, training occurrences).

        Words that only are a context here are asked too.
        """
        order = np.argsort(self.known)
        n = np.bincount(self.words[self.trained], minlength=len(self.known))
        return self.known[order], order, n[order]

    def pairs(self) -> np.ndarray:
        return self.contexts * len(self.known) + self.words

    def asked_pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes, which of the sorted distinct ``codes`` each is)."""
        keys = bigram_keys(self.known[codes // len(self.known)], self.known[codes % len(self.known)])
        order = np.argsort(keys)
        return keys[order], order

    def question(self, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of words or bigrams, and training occurrences of each."""
        if not pairs:
            keys, _, n = self.asked_words()
            return keys, n
        codes, where = np.unique(self.pairs(), return_inverse=True)
        keys, order = self.asked_pairs(codes)
        return keys, np.bincount(where[self.trained], minlength=len(codes))[order]


def _range_bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of hashes begins among sorted keys, and the end."""
    inner = (np.arange(1, ranges, dtype=np.uint64) * np.uint64(2**64 // ranges)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]])


def token_blocks(docs: DataFrame) -> DataFrame:
    """block, row, doc_id, held, length, first, known, words: pieces of texts, whole ones where they fit.

    ``known`` lists the block's word hashes, ``words`` the place there of every token, ``first``
    that of the word before each piece.
    """
    kind = docs.schema["doc_id"].dataType
    names = ["block", "row", "doc_id", "held", "length", "first", "known", "words"]

    def cut(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        hashes, row = _Hashes(), number
        pieces: list[tuple] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            nonlocal number
            rows, ids, held, lengths, firsts, words = zip(*pieces)
            both = np.concatenate([*words, np.array(firsts, np.int64)]).view(np.uint64)
            known, places, n = np.unique(both, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            places = rank[places]
            firsts = places[len(places) - len(rows) :]
            columns = [
                pa.array([number], pa.int64()), pa.array([rows], pa.list_(pa.int64())),
                pa.array([ids], pa.list_(id_kind)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([firsts.tolist()], pa.list_(pa.int64())),
                pa.array([known[order].tobytes()], pa.binary()),
                pa.array([packed(places[: len(places) - len(rows)], "<u4")], pa.binary()),
            ]
            number += 1
            return pa.RecordBatch.from_arrays(columns, names)

        for table in tables:
            id_kind = table.column("doc_id").type
            for place, doc_id in enumerate(table.column("doc_id").to_pylist()):
                found = words_of(table.column("text")[place].as_py())
                words = np.empty(len(found) + 1, np.int64)
                words[:-1] = np.fromiter(map(hashes.__getitem__, found), np.int64, len(found))
                words[-1] = END
                held = remainder(doc_id) == 1
                for at in range(0, len(words), BLOCK):
                    piece = words[at : at + BLOCK]
                    pieces.append((row, doc_id, held, len(piece), int(words[at - 1]) if at else END, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        yield flushed()
                        pieces, size = [], 0
                row += 1
        if pieces:
            yield flushed()

    of = {"row": LongType(), "doc_id": kind, "held": BooleanType(), "length": LongType(), "first": LongType()}
    schema = StructType().add("block", "long")
    for name, inner in of.items():
        schema = schema.add(name, ArrayType(inner))
    return docs.select("doc_id", "text").mapInArrow(cut, schema.add("known", "binary").add("words", "binary"))


def counted(blocks: DataFrame, ranges: int) -> DataFrame:
    """block, part, n: answers, training counts of the keys that a block asks of a range.

    Parts from 0 are ranges of words, those from ``ranges`` of bigrams. For block -1 a range of
    words answers with the numbers of its training tokens and distinct training words.
    """

    def ask(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for row, number in enumerate(table.column("block").to_pylist()):
                block = Block(table, row)
                for pairs in (False, True):
                    keys, n = block.question(pairs)
                    bounds = _range_bounds(keys, ranges)
                    parts = np.flatnonzero(np.diff(bounds))
                    cuts = list(zip(bounds[parts].tolist(), bounds[parts + 1].tolist()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(parts), number)), pa.array((parts + pairs * ranges).astype(np.int32)),
                            pa.array([packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in cuts], pa.binary()),
                            pa.array([packed(n[a:b]) for a, b in cuts], pa.binary()),
                        ],
                        ["block", "part", "keys", "n"],
                    )

    def summed(part: int, asked: list[tuple]) -> pa.RecordBatch:
        keys = np.concatenate([np.cumsum(unpacked(k), dtype=np.uint64) for _, k, _ in asked])
        n = np.concatenate([unpacked(x) for *_, x in asked]).astype(np.int64)
        found, where = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, where, n)
        back, at, answers = total[where], 0, []
        for _, k, _ in asked:
            answers.append(packed(back[at : at + len(k) // 8]))
            at += len(k) // 8
        numbers = [b for b, *_ in asked]
        if part < ranges:
            numbers.append(-1)
            answers.append(packed(np.array([total.sum(), (total > 0).sum()])))
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array([part] * len(numbers), pa.int32()), pa.array(answers, pa.binary())],
            ["block", "part", "n"],
        )

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for table in tables:
            for part, *question in zip(*[table.column(c).to_pylist() for c in ("part", "block", "keys", "n")]):
                if part != now:
                    if asked:
                        yield summed(now, asked)
                    now, asked = part, []
                asked.append(question)
        if asked:
            yield summed(now, asked)

    asked = blocks.select("block", "length", "first", "held", "known", "words")
    asked = asked.mapInArrow(ask, "block long, part int, keys binary, n binary")
    dealt = asked.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(add, "block long, part int, n binary")


def resolved(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with the answers to all they asked, in order."""
    whole = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("answers"))
    return blocks.join(whole, "block").withColumn("answers", F.col("answers.n"))


class Counts:
    """Training counts of a resolved block's words (by place) and of its distinct bigrams."""

    def __init__(self, table: pa.RecordBatch, row: int):
        self.block = Block(table, row)
        n = np.concatenate([unpacked(x) for x in table.column("answers")[row].as_py()]).astype(np.int64)
        _, order, _ = self.block.asked_words()
        self.word = np.empty(len(order), np.int64)
        self.word[order] = n[: len(order)]
        self._bigram = n[len(order) :]

    def bigram(self, codes: np.ndarray) -> np.ndarray:
        """Counts of the block's sorted distinct bigrams."""
        _, order = self.block.asked_pairs(codes)
        found = np.empty(len(order), np.int64)
        found[order] = self._bigram
        return found


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """Bucket of a context: one per doubling of its count; 0 for a context never seen."""
    return np.minimum(np.ceil(np.log2(count + 1.0)).astype(np.int64), BUCKETS - 1)


def held_out_histogram(blocks: DataFrame, total: int) -> np.ndarray:
    """Rows (bucket, bigram estimate, unigram estimate, weight) of held-out training bigrams.

    Estimates are those without the judged occurrence, to a quarter of a doubling; so their
    number has a bound that does not depend on the corpus but for the range of its counts.
    """

    def tally(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for row in range(table.num_rows):
                counts = Counts(table, row)
                block, pairs = counts.block, counts.block.pairs()
                codes = np.unique(pairs)
                trained, n = np.unique(pairs[block.trained], return_counts=True)
                bigram = counts.bigram(codes)[np.searchsorted(codes, trained)]
                context, word = counts.word[trained // len(block.known)], counts.word[trained % len(block.known)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    estimates = np.log2((bigram - 1) / np.maximum(context - 1, 1)), np.log2((word - 1) / max(total - 1, 1))
                p2, p1 = (np.where(np.isfinite(x), np.round(x * STEPS), -9_999).astype(np.int64) for x in estimates)
                cells = (frequency_bucket(context) * 10_000 - p2) * 10_000 - p1
                found, where = np.unique(cells, return_inverse=True)
                weight = np.bincount(where, n, len(found)).astype(np.int64)
                columns = [found // 10**8, -(found // 10**4 % 10**4), -(found % 10**4), weight]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["b", "p2", "p1", "w"])

    cells = blocks.mapInArrow(tally, "b long, p2 long, p1 long, w long")
    tallied = stored(cells.groupBy("b", "p2", "p1").agg(F.sum("w").alias("w")), "lm-held-out")
    rows = tallied.orderBy("b", "p2", "p1").collect()
    discard(tallied)
    return np.array([tuple(r) for r in rows], np.float64).reshape(-1, 4)


def learned_weights(histogram: np.ndarray, n_outcomes: int, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of every bucket, by expectation-maximisation.

    A bucket without held-out bigrams has the weights of all buckets together, and an
    empty histogram gives the uniform distribution alone.
    """

    def maximised(rows: np.ndarray) -> np.ndarray:
        p = np.stack(
            [*(np.where(rows[:, i] > -9_999, 2.0 ** (rows[:, i] / STEPS), 0.0) for i in (1, 2)),
             np.full(len(rows), 1 / n_outcomes)]
        )
        weights = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = weights[:, None] * p
            weights = (share / share.sum(0) * rows[:, 3]).sum(1) / rows[:, 3].sum()
        floor = 1e-6  # nothing is impossible
        return (weights + floor) / (1 + 3 * floor)

    if not len(histogram):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    pooled = maximised(histogram)
    by_bucket = [histogram[histogram[:, 0] == b] for b in range(BUCKETS)]
    return np.stack([maximised(rows) if len(rows) else pooled for rows in by_bucket])


def token_scores(
    context: np.ndarray, word: np.ndarray, bigram: np.ndarray, total: int, distinct: int, weights: np.ndarray
) -> np.ndarray:
    """log10 probability of each token given its context."""
    mix = weights[frequency_bucket(context)]
    p = mix[:, 0] * bigram / np.maximum(context, 1) + mix[:, 1] * word / max(total, 1) + mix[:, 2] / (distinct + 1)
    return np.log10(p)


def _summed_by_text(blocks: DataFrame, total: int, distinct: int, weights: np.ndarray) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base and score in billionths, by piece."""
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
    schema = StructType().add("row", "long").add("doc_id", blocks.schema["doc_id"].dataType.elementType)
    schema = schema.add("held_out", "boolean")
    for name in names[3:]:
        schema = schema.add(name, "long")

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for row in range(table.num_rows):
                counts = Counts(table, row)
                block, size = counts.block, len(counts.block.known)
                codes, where = np.unique(block.pairs(), return_inverse=True)
                context, word = counts.word[codes // size], counts.word[codes % size]
                score = token_scores(context, word, counts.bigram(codes), total, distinct, weights)
                base = np.log10((counts.word + 0.5) / (total + 0.5 * (distinct + 1)))
                whole = lambda x: np.rint(x * DIGITS).astype(np.int64)
                sums = [(counts.word > 0).astype(np.int64)[block.words], whole(base)[block.words], whole(score)[where]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[table.column(c)[row].values for c in ("row", "doc_id", "held")],
                        pa.array(block.length), *[pa.array(np.add.reduceat(x, block.starts)) for x in sums],
                    ],
                    names,
                )

    return blocks.mapInArrow(add, schema)


def scored(docs: DataFrame) -> DataFrame:
    """Base and model score of every document, trained on those that aren't held out.

    Output: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score`` (log10). A null or empty text is the end token alone. Repeated rows count and
    are scored each; rows are told apart by a number that is written with their tokens. An
    empty table gives no rows; without training documents every word is unknown and all
    outcomes are equally likely. Further columns are left out.
    """
    spark = docs.sparkSession
    blocks = stored(token_blocks(docs), "lm-tokens")
    tokens = blocks.agg(F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // RANGE))
    answers = stored(counted(blocks, ranges), "lm-answers")
    total = distinct = 0
    for part in answers.where("block = -1").select("n").toLocalIterator():
        a, b = unpacked(part["n"])
        total, distinct = total + int(a), distinct + int(b)
    # Joined again for each of the two passes: a stored join would take more room than its shuffle.
    known = resolved(blocks, answers)
    weights = learned_weights(held_out_histogram(known, total), distinct + 1)
    pieces = _summed_by_text(known, total, distinct, weights)
    texts = pieces.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")],
    )
    return texts.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / DIGITS).alias("base_score"), (F.col("score") / DIGITS).alias("score"),
    )
