"""Intermediate tables in the folder that the cluster shares.

A table that several steps read is written once under ``spark.checkpoint.dir`` and read
back. Executors may be lost at any time: what they had computed is in that folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Once the table is written, the exchanges that led to it are no longer needed.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, local runs only."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siteglass-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read back."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before else spark.conf.unset(_CLEAN_UP)
    back = spark.read.schema(df.schema).parquet(folder)
    back.stored_in = folder
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_in)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def carried(keep: list[str] | None) -> Column:
    """The columns ``keep`` as one struct ``row``; without any, ``doc_id`` alone."""
    if not keep:
        return F.col("doc_id")
    return F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
