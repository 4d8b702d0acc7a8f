"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import (
    chat,
    decontaminate,
    jaccard,
    licenses,
    mixing,
    periods,
    phrases,
    quality,
    repeats,
    sharding,
    simhash,
    sql,
    toxicity,
    urls,
)
from shelfmark.llm.text import documents

Query = Callable[[SparkSession, str], DataFrame]

OP1_COLUMNS = ("doc_id", *quality.BASE, "kept")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Adaptive quality cutoffs per language and source."""
    return quality.quality_measures(documents(spark, folder)).select(*OP1_COLUMNS)


def op2_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """16 shards of equal row counts along a Hilbert curve through source, language and size."""
    return sharding.shard_documents(documents(spark, folder))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of all documents from the labels that are not held out."""
    return toxicity.toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in documents."""
    return licenses.license_matches(documents(spark, folder))


def op5_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes left of every document without 50-byte strings of earlier documents."""
    return repeats.remove_repeats(documents(spark, folder))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, folder), items).drop("text_hash")


def op7_chat_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of maximal conversations as chat markup."""
    return chat.collapse_and_render(spark.read.parquet(f"{folder}/conversations.parquet"))


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents linked by a 3-word shingle similarity of 0.9."""
    return jaccard.near_duplicate_classes(documents(spark, folder))


def op9_flow_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix at target weights takes of each document."""
    out = mixing.mix(documents(spark, folder))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page by rules and listed URLs."""
    return urls.judge_pages(spark.read.parquet(f"{folder}/pages.parquet"))


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose fingerprints differ in four bits at most."""
    return simhash.near_fingerprints(documents(spark, folder))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, and digests of the texts without their repetitions."""
    return periods.run_digests(documents(spark, folder))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 strongest phrases of every language."""
    return phrases.collocations(documents(spark, folder))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_collapse": op7_chat_collapse,
    "op8_ngram_join": op8_ngram_join,
    "op9_flow_mix": op9_flow_mix,
    "op10_url_filter": op10_url_filter,
    "op11_simhash": op11_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": sql.OP1,
    "op6_decontaminate": sql.OP6,
    "op7_chat_collapse": sql.OP7,
    "op10_url_filter": sql.OP10,
    "op13_collocations": sql.OP13,
}
