"""Best-fit packing with a bounded number of open sequences.

Documents become token ids, an end id is added, and only documents longer than a sequence
are cut. Pieces go, as they come, into the fullest open sequence that still has room.
Open sequences are kept by free space: a bit set over the free space says which sizes
exist, so the best fit is one shift and one lowest bit. When too many are open, the
fullest is closed. Each task packs what it reads; nothing is exchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .storage import carried
from .word_bpe import batches, encoder

PIECE = {
    "piece": "integer", "start": "long", "length": "long", "ids_crc32": "long", "sequence_id": "long", "offset": "long"
}


class OpenSequences:
    """At most ``most`` open sequences of ``capacity`` tokens, found by free space."""

    def __init__(self, capacity: int, most: int, first_id: int = 0):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.sizes = 0  # bit f is set while a sequence with f free tokens is open
        self.by_free: dict[int, list[int]] = {}
        self.open = 0

    def _add(self, free: int, sequence: int) -> None:
        self.by_free.setdefault(free, []).append(sequence)
        self.sizes |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        sequence = stack.pop()
        if not stack:
            del self.by_free[free]
            self.sizes &= ~(1 << free)
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to ``capacity`` tokens."""
        fitting = self.sizes >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.sizes & -self.sizes).bit_length() - 1)
            free, sequence = self.capacity, self.next_id
            self.next_id += 1
        if free > length:
            self._add(free - length, sequence)
        return sequence, self.capacity - free


def packed(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    most_open: int = 4096,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per piece of a document, with its sequence and place there.

    ``docs`` has ``doc_id`` and ``text``. Columns named by ``keep`` come back in a struct ``row``
    in place of ``doc_id``, so that no name can clash. A null or empty
    text is the end id alone. Equal rows are packed each for itself. An empty table gives
    no piece. Sequences never span tasks: ``sequence_id`` holds the task's partition above
    32 bits. The result depends only on how the input is split, not on retries.
    """
    slim = docs.select(carried(keep), "text")
    name = slim.columns[0]
    schema = StructType([slim.schema[0]])
    for column, kind in PIECE.items():
        schema = schema.add(column, kind)
    end = int(end_id).to_bytes(4, "little")

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        sequences = OpenSequences(capacity, most_open, TaskContext.get().partitionId() << 32)
        for batch in rows:
            texts = batch.column("text").to_pylist()
            at, out = [], []
            for a, b in batches(texts):
                for row, ids in enumerate(encode(texts[a:b]), a):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        length = len(own) // 4
                        at.append(row)
                        out.append((piece, start, length, zlib.crc32(own), *sequences.place(length)))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int32()] + [pa.int64()] * 5
            kept = batch.select([name]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *[pa.array(c, t) for c, t in zip(columns, types)]],
                [name, *PIECE],
            )

    return slim.mapInArrow(pack, schema)
