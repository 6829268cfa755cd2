"""A training corpus from raw documents: quality, near duplicates, mixture, packing.

Each stage gets all that its predecessor kept, written as Parquet, and its decisions take
effect on the rows. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteglass.llm import jaccard, mixing, packing, quality
from siteglass.llm.storage import carried, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = quality.judged(docs, keep=docs.columns)
    return judged.where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates.

    Rows that repeat a ``doc_id`` are one document, of which one row stays. A row without
    ``doc_id`` can't be named as a duplicate and stays.
    """
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), carried(docs.columns))
    same = Window.partitionBy("doc_id").orderBy("hash")
    named = rows.join(first, "doc_id", "left_semi").withColumn("nth", F.row_number().over(same))
    return named.where("nth = 1").select("row.*").unionByName(rows.where("doc_id is null").select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of copies that the mix takes."""
    rows = mixing.mixed(docs, keep=docs.columns)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    repeated = rows.select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"))
    return repeated.select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

# The packing stage needs a tokenizer, which SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
