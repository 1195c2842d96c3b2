"""The corpus pipeline: documents go through the stages in order; each works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import decontamination, jaccard, mixing, quality, sharding
from tidegrid.llm.common import materialise, table

SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; the others lose the lines above their host's limit.

    Null and empty texts go. Repeated rows stay or go together.
    """
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest doc_id, null last.

    Null texts and texts without words are in no group and stay; of equal rows one stays.
    """
    return jaccard.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts hold none."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as often as the mix takes it. Null sources are one source; a source without words goes."""
    return mixing.apply(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mix; copies that the mix made stay together."""
    return sharding.shard(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", source_mix),
    ("sharding", shards),
]

#: Packing is a sequential choice that SQL can't express; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; an empty table gives an empty result. Extra columns are kept up to the last stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage-" + name.replace(" ", "-"))
    return docs
