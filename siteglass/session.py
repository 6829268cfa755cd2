"""Session defaults and shared work folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that help every plan in this package; a cluster may override them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "siteglass", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a temporary one only in local runs."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix=f"siteglass-{name}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back.

    The folder is shared by all executors, so a lost executor costs nothing but its
    running tasks, and readers still prune columns.
    """
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    back = df.sparkSession.read.schema(df.schema).parquet(folder)
    back.stored_in = folder
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def by_key(df: DataFrame) -> DataFrame:
    """For a side of a join with a row per site or audit: both sides are dealt out by the key.

    Spark guesses sizes from compressed files and column types. For a table that compresses
    well, or whose rows are made from a narrow one, it would gather far more than it guessed
    on the driver to send it to every task, and adaptive execution doesn't take that back.
    """
    return df.hint("merge")


def spread_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal a stored table out by ``keys`` into tasks of about ``rows`` rows each.

    For narrow tables that become much wider: Spark splits a scan by bytes and row groups, so
    one task would make all the wide rows. Smaller and finer split tables stay as they are.
    """
    tasks = -(-df.count() // rows)
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks, *keys)


def spread_small(df: DataFrame) -> DataFrame:
    """Give a small scan one partition per core.

    Only for the supplied test tables, which are one file of one row group each. Readers
    of stored pages never call it: large tables are split by their files and row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
