"""A training corpus from ``documents`` in five stages; each writes Parquet in the shared folder and the next reads it.

``ORACLE_SQL`` is None: hashing, alignment and tokenising aren't SQL; ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterjobs.llm.language import keep_identified
from rasterjobs.llm.line_dedup import without_repeats
from rasterjobs.llm.minhash import keep_one_of_each
from rasterjobs.llm.mixing import mixed
from rasterjobs.llm.packing import digest, pack
from rasterjobs.llm.queries import tokenizer_path
from rasterjobs.runtime import drop, snapshot

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or mostly in none of the learned languages, go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; documents that lose all their words go."""
    return without_repeats(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix of sources takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return digest(pack(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept, before = snapshot(stage(spark, docs, sf_dir), name), docs
        drop(before)  # the next stage reads what this one wrote
        docs = kept
    return docs
