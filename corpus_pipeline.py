"""A training corpus from ``documents``: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import read, written
from tessella.llm.decontaminate import drop_contaminated
from tessella.llm.language import keep_identified
from tessella.llm.packing import pack_documents
from tessella.llm.simhash import drop_near_copies
from tessella.llm.suffixes import drop_repeats
from tessella.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence settles."""
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return drop_near_copies(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that stand earlier in the corpus; ``n_chars`` follows the text."""
    return drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item stand."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs, max_tokens=2048)


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship_package(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _shipped(language_id)),
    ("simhash_near_dedup", _shipped(near_copies)),
    ("suffix_array_dedup", _shipped(repeated_strings)),
    ("decontamination", _shipped(benchmark_leaks)),
    ("packing", _shipped(packed)),
]

# SimHash, suffix ranks and byte-pair encoding have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
