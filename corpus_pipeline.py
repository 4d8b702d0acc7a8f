"""A corpus from raw documents: filtered, deduplicated, decontaminated, mixed and sharded.

Each stage reads what the one before wrote. Counts as part of the ``llm`` subpackage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import decontaminate, jaccard, mixing, quality, sharding
from shelfmark.operators import stage, staging_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs of their language and source.

    NULL and empty texts fail the base rules; repeated rows stay or go together.
    """
    return quality.quality_filter(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id.

    Near is a five-word shingle similarity of 0.8 or more; 3 words and 0.9 are op8's alone.
    """
    return jaccard.keep_one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; repeated rows stay or go together."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words go."""
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every document of the mix, with its text and other columns."""
    return sharding.shard_texts(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]

# Sketches, components, the flow and the curve are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All stages over the documents of a folder, each written and read again.

    The result is written to ``path`` (else the staging folder) by shard, files
    in the order of slots. Repeated documents of the mix have a slot each. With
    no documents, or none left, the result is empty.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    name, step = STAGES[-1]
    sharded = step(spark, docs, sf_dir)
    path = path or f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    sharding.write_shards(sharded, path)
    return spark.read.schema(sharded.schema).parquet(path)
