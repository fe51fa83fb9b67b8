"""Text files written from the tables, read split by split."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.leakscan import scan_files
from tessella.plans.bindings.common import Bound, derive, derive_sql
from tessella.plans.bindings.governance import _PLANTED, _scan_sql
from tessella.session import checkpoint_folder, read_table
from tessella.sources.sinks import write_new
from tessella.sources.tables import CSV_DIALECT, read_csv_strict

# Every 20,000 order keys are one text file, in key order.
_LINES = {"file": "o_orderkey DIV 20000", "key": "o_orderkey", "text": _PLANTED["text"]}


def _folder(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_folder(spark)}/{what}-{uuid.uuid4().hex}"


def leak_scan_files(spark: SparkSession, directory: str) -> DataFrame:
    """Orders written as text files; findings with line numbers in the whole file."""
    texts = derive(read_table(spark, directory, "orders"), _LINES)
    folder = _folder(spark, "texts")
    ordered = texts.repartition("file").sortWithinPartitions("file", "key").select("file", "text")
    write_new(ordered, folder, "text", partition_by=["file"])
    found = scan_files(spark, folder, snippet_length=120)
    return found.withColumn("path", F.regexp_extract("path", r"(file=\d+)", 1))


_FILES_SQL = _scan_sql(
    "SELECT 'file=' || file AS path, string_agg(text || chr(10), '' ORDER BY key) AS text FROM "
    f"({derive_sql('orders', _LINES).replace(' DIV ', ' // ')}) GROUP BY file",
    (),
)


def csv_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Documents written as CSV, whose texts hold quotes and line breaks, and read again."""
    folder = _folder(spark, "csv")
    texts = read_table(spark, directory, "documents", "doc_id", "lang", "text")
    write_new(texts, folder, "csv", emptyValue="", lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **CSV_DIALECT)
    read = read_csv_strict(spark, folder, "doc_id bigint, lang string, text string")
    return read.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


# Line breaks of any kind are read as line feeds.
_CSV_SQL = """
SELECT doc_id, coalesce(lang, '') AS lang, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256
FROM (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t FROM documents)
"""

BOUND = {
    "leak_scan_files": Bound(leak_scan_files, _FILES_SQL),
    "csv_round_trip": Bound(csv_round_trip, _CSV_SQL),
}
