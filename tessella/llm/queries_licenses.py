"""Query of license scans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import read
from tessella.llm.licenses import scan_licenses


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    every = F.array_union(base, F.transform("detections", lambda d: d["label"]))
    doubt = F.aggregate(
        F.array_union(
            F.transform("detections", lambda d: d["strength"]),
            F.when(F.size("places") > 0, F.array(F.lit(0.7))).otherwise(F.array().cast("array<double>")),
        ),
        F.lit(1.0),
        lambda left, strength: left * (F.lit(1.0) - strength),
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.round(F.lit(1.0) - doubt, 6).alias("score"),
    )
