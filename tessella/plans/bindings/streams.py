"""Streams replayed from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.bindings.common import Bound
from tessella.plans.bindings.integrity import _LEAKAGE_SQL, _MANIFEST_SQL, document_manifest
from tessella.session import checkpoint_folder
from tessella.streaming.content import FINDINGS, content_findings, use_keyed_state
from tessella.streaming.modes import append_to_files


def content_stream(spark: SparkSession, directory: str) -> DataFrame:
    """Documents arriving in files by their hash, each an hour's events; what closing states say of their content."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    second = F.lit(1_700_000_000) + F.pmod(F.xxhash64("split_id"), F.lit(3600))
    rows = document_manifest(spark, directory).select("content_sha256", "role", F.timestamp_seconds(second).alias("at"))
    rows.repartition(4, F.xxhash64("content_sha256", "at")).write.parquet(f"{folder}/in")
    # A row far enough in the future lets the watermark close every state.
    closing = rows.limit(1).select(F.lit("").alias("content_sha256"), F.lit("train").alias("role"), F.to_timestamp(F.lit("2030-01-01")).alias("at"))
    closing.write.mode("append").parquet(f"{folder}/in")
    own = spark.newSession()
    use_keyed_state(own)
    arriving = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    findings = content_findings(arriving, "at", "2 hours")
    append_to_files(findings, f"{folder}/out", f"{folder}/state").awaitTermination()
    found = spark.read.schema(FINDINGS).parquet(f"{folder}/out")
    return found.filter("rule <> 'leakage_seen'")


BOUND = {
    "content_stream": Bound(
        content_stream,
        f"WITH {_MANIFEST_SQL} {_LEAKAGE_SQL} UNION ALL SELECT 'duplicate_content' AS rule, content_sha256 AS key, "
        "CAST(count(*) AS VARCHAR) AS detail FROM m GROUP BY content_sha256 HAVING count(*) > 1",
    ),
}
