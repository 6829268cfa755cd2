"""Run a stream over what is available and read its result back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_folder

__all__ = ["latest", "run_append", "run_updates", "work_folder"]


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Drain an append-mode stream into Parquet files and read them."""
    running = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/out")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
    rows.stored_in = f"{folder}/out"
    return rows


def run_updates(stream: DataFrame, folder: str) -> DataFrame:
    """Drain an update-mode stream; rows carry the batch that wrote them.

    A batch that is repeated after a failure overwrites its own folder. A stream that had
    no input gives no rows.
    """
    session, schema = stream.sparkSession, stream.schema
    # Without a batch there would be no table to read.
    session.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/out/batch_id=-1")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    running = (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    rows = session.read.schema(schema.add("batch_id", "long")).parquet(f"{folder}/out")
    rows.rows_read = [p.numInputRows for p in running.recentProgress if p.numInputRows]
    return rows


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    values = [c for c in updates.columns if c not in (*keys, "batch_id")]
    last = F.max_by(F.struct(*values), "batch_id").alias("u")
    return updates.groupBy(*keys).agg(last).select(*keys, "u.*")
