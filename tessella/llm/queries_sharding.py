"""Query of sharding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import read
from tessella.llm.sharding import assign_shards


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(read(spark, sf_dir, "documents", "doc_id", "text"), shards=24)
    return placed.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
