"""Query of toxicity scores."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import read
from tessella.llm.toxicity import fit_toxicity, score_toxicity


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out)
    scored = score_toxicity(documents, fit_toxicity(documents, labels)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
