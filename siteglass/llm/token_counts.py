"""Token counts of whole texts, most pre-tokens counted without merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import carried
from .word_bpe import batches, encoder


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 2048, keep: list[str] | None = None
) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens.

    Columns named by ``keep`` come back in a struct ``row`` in place of ``doc_id``, so that no
    name can clash. ``tokenizer`` is the path of a ``tokenizers`` file that every executor can open. A null
    or empty text has no tokens. Rows are counted where they are read; nothing is
    exchanged. Counts equal the library's without added begin or end tokens.
    """
    slim = docs.select(carried(keep), "text")
    schema = slim.drop("text").schema.add("n_bytes", "long").add("n_tokens", "long")

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in rows:
            texts = batch.column("text").to_pylist()
            tokens: list[int] = []
            for a, b in batches(texts):
                tokens += [len(x) // 4 for x in encode(texts[a:b])]
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                [*batch.schema.names[:-1], "n_bytes", "n_tokens"],
            )

    return slim.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
