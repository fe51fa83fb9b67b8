"""Query of best-fit packing."""

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import read
from tessella.llm.packing import pack_documents


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), max_tokens=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
