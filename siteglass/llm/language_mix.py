"""Languages of a text, inferred as a mixture.

Every language has a distribution of character trigrams, hashed into buckets and smoothed
towards that of all languages together. A text is taken as a mixture: each of its trigrams
stems from one language with the mixture's proportions, which expectation-maximisation
finds. Languages join the set one at a time, the one of steepest likelihood first, and stay
only if the likelihood gains more than the penalty for a further proportion. The prediction
is the language of the largest proportion, the score that proportion.

Counting covers every training text: a task adds up its own counts, one sum per language
and bucket follows, so the shuffle does not depend on the texts' number. The model holds at
most ``CELLS`` numbers, whatever the corpus.

Odd rows: a text that is null or has no letter is ``und`` with score 0 and teaches nothing,
as do rows without ``lang``. A missing ``doc_id`` counts as empty text, whose remainder is 0.
Repeated rows count and are returned each; of equal proportions the first language by name is
taken. Without any training text all rows are ``und``. An empty table gives no rows. Columns
besides those of the parameters are not read, unless ``keep`` names them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import discard, stored

#: Numbers in a model at most: languages times buckets.
CELLS = 1 << 22
#: Trigram buckets of a language, fewer where there are more than 64 languages.
BUCKETS = 1 << 16
#: Characters of a text taken at a time.
STRETCH = 1 << 20
SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _stretch_trigrams(text: str) -> np.ndarray:
    """Hashes of the trigrams of words, each word between two blanks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    codes = np.where(letter, codes, SPACE)
    # Of a run of other characters one blank stays.
    stays = letter.copy()
    stays[1:] |= letter[:-1]
    codes = np.concatenate([[SPACE], codes[stays], [SPACE]]).astype(np.uint64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (c * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(32))[b != SPACE]


def trigrams(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's trigrams in ascending order, and how often each occurs.

    A text longer than ``STRETCH`` is cut at white space, or else anywhere, and summed up.
    """
    text, at, parts = text or "", 0, []
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            end = cut if cut > 0 else end
        parts.append(np.unique(_stretch_trigrams(text[at:end]) % np.uint64(buckets), return_counts=True))
        at = end
    if len(parts) == 1:
        return parts[0][0].astype(np.int64), parts[0][1]
    total = np.zeros(buckets, np.int64)
    for found, counts in parts:
        total[found.astype(np.int64)] += counts
    found = np.flatnonzero(total)
    return found, total[found]


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


@dataclass
class LanguageMixture:
    """Trigram distributions of languages and the inference of a text's mixture."""

    languages: list[str]
    counts: np.ndarray  # languages x buckets
    smoothing: float = 2000.0
    rounds: int = 25
    #: Consecutive trigrams overlap: this many count as one observation.
    dependence: float = 3.0
    likelihood: np.ndarray = field(init=False)

    def __post_init__(self):
        counts = self.counts.astype(np.float64)
        together = counts.sum(axis=0) + 1.0
        together /= together.sum()
        size = counts.sum(axis=1, keepdims=True)
        self.likelihood = ((counts + self.smoothing * together) / (size + self.smoothing)).T.astype(np.float32)

    def _proportions(self, rows: np.ndarray, counts: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Expectation-maximisation from ``start``."""
        shares, n = start, counts.sum()
        for _ in range(self.rounds):
            new = shares * (rows.T @ (counts / (rows @ shares))) / n
            if np.abs(new - shares).max() < 1e-4:
                return new
            shares = new
        return shares

    def infer(self, text: str | None) -> list[tuple[str, float]]:
        """Languages of a text with their proportions, largest first; none without letters."""
        found, counts = trigrams(text, self.counts.shape[1])
        if not len(found) or not self.languages:
            return []
        rows = self.likelihood[found].astype(np.float64)
        counts = counts.astype(np.float64)
        n = counts.sum()
        alone = counts @ np.log(rows)
        chosen = [int(alone.argmax())]
        shares, best = np.ones(1), alone[chosen[0]]
        penalty = 0.5 * np.log(max(n / self.dependence, 2.0))
        while len(chosen) < len(self.languages):
            # A language raises the likelihood only if its slope exceeds 1.
            slope = rows.T @ (counts / (rows[:, chosen] @ shares)) / n
            slope[chosen] = 0
            new = int(slope.argmax())
            if slope[new] <= 1 + 1e-9:
                break
            start = np.append(shares * 0.9, 0.1)
            mixed = self._proportions(rows[:, [*chosen, new]], counts, start)
            value = counts @ np.log(rows[:, [*chosen, new]] @ mixed)
            if (value - best) / self.dependence <= penalty:
                break
            chosen, shares, best = [*chosen, new], mixed, value
        shares = shares / shares.sum()
        return sorted(
            ((self.languages[i], float(s)) for i, s in zip(chosen, shares)), key=lambda x: (-x[1], x[0])
        )


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageMixture:
    """Learn from all texts with a language whose id is not held out."""
    slim = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )

    def flushed(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for language, counts in sums.items():
            found = np.flatnonzero(counts)
            names = pa.array([language], pa.string()).take(pa.array(np.zeros(len(found), np.int32)))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(found.astype(np.int32)), pa.array(counts[found])], ["lang", "bucket", "n"]
            )

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for table in tables:
            ids, languages = table["doc_id"].to_pylist(), table["lang"].to_pylist()
            for row, (number, language) in enumerate(zip(ids, languages)):
                if held_out(number):
                    continue
                found, counts = trigrams(table["text"][row].as_py())
                if not len(found):
                    continue
                if language not in sums:
                    if len(sums) * BUCKETS >= CELLS:
                        yield from flushed(sums)
                        sums = {}
                    sums[language] = np.zeros(BUCKETS, np.int64)
                sums[language][found] += counts
        yield from flushed(sums)

    counted = slim.mapInArrow(count, "lang string, bucket int, n long")
    total = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return _model(total)


def _model(total: DataFrame) -> LanguageMixture:
    """The model of summed counts, with as many buckets as ``CELLS`` allows."""
    total = stored(total, "language-counts")
    number = total.select("lang").distinct().limit(CELLS // 256 + 1).count()
    if number > CELLS // 256:
        raise ValueError(f"more than {CELLS // 256} languages")
    buckets = BUCKETS
    while buckets * number > CELLS:
        buckets //= 2
    # At most CELLS rows, whatever the corpus.
    sums = total.groupBy("lang", (F.col("bucket") % buckets).alias("bucket")).agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    discard(total)
    names = table["lang"].to_pylist()
    languages = sorted(set(names))
    counts = np.zeros((len(languages), buckets), np.int64)
    places = {name: i for i, name in enumerate(languages)}
    counts[[places[n] for n in names], table["bucket"].to_numpy()] = table["n"].to_numpy()
    return LanguageMixture(languages, counts)


def predicted(
    docs: DataFrame,
    model: LanguageMixture,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_languages, mixture (``en:0.7,fr:0.3``).

    Columns named by ``keep`` come back in a struct ``row``, so that no name can clash.
    """
    columns = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    columns += [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    slim = docs.select(*columns)
    known = docs.sparkSession.sparkContext.broadcast(model)
    carried = [f for f in slim.schema.fields if f.name != "text"]
    passed = [f.name for f in carried]

    def predict(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for table in tables:
            found = [model.infer(x.as_py()) for x in table["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    *[table[name] for name in passed],
                    pa.array([held_out(i) for i in table["doc_id"].to_pylist()], pa.bool_()),
                    pa.array([x[0][0] if x else "und" for x in found], pa.string()),
                    pa.array([x[0][1] if x else 0.0 for x in found], pa.float64()),
                    pa.array([len(x) for x in found], pa.int32()),
                    pa.array([",".join(f"{a}:{b:.3f}" for a, b in x) for x in found], pa.string()),
                ],
                [*passed, "held_out", "lang_pred", "score", "n_languages", "mixture"],
            )

    schema = StructType(carried)
    for name, kind in (
        ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"), ("n_languages", "integer"), ("mixture", "string"),
    ):
        schema = schema.add(name, kind)
    return slim.mapInArrow(predict, schema)
