"""One registered query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_trie, jaccard, language_mix, licenses, merkle, mixing, neighbours, ngram_lm, packing, quality,
    revisits, token_counts, url_filter,
)
from .oracle_sql import ORACLES  # noqa: F401

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0)


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture in the history of the pages, revisits resolved."""
    done = revisits.resolved(revisits.captures_of_pages(table(spark, sf_dir, "pages")))
    lines = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return done.withColumn("headers", F.array_join(lines, "\n"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and interpolated log probability of every document."""
    return ngram_lm.scored(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judged(table(spark, sf_dir, "pages"), model)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document, one in seven with a changed length."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = merkle.verified(merkle.manifest(docs, claims={"n_chars": claimed}))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    return language_mix.predicted(docs, language_mix.fit(docs))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    turns = table(spark, sf_dir, "conversations")
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(turns))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_source_mix": op3_source_mix,
    "op4_token_counts": op4_token_counts,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_nn_descent": op7_nn_descent,
    "op8_revisits": op8_revisits,
    "op9_lm_scores": op9_lm_scores,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_mix": op12_language_mix,
    "op13_conversation_trie": op13_conversation_trie,
}
