"""Query of vector code compression."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import read
from tessella.llm.vector_codes import compress, with_label_errors


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = compress(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return with_label_errors(coded.rows).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256")
    )


def _assigned(k: int, books: str) -> str:
    return f"""n{k} AS MATERIALIZED (SELECT p.vec_id, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.entry)) AS near
  FROM p JOIN {books} b USING (part) GROUP BY p.vec_id, p.part)"""


def _moved(k: int, books: str) -> str:
    return f"""s{k} AS (SELECT p.part, near.e AS entry, [{", ".join(f"CAST(floor(sum(v[{i}]) / count(*)) AS BIGINT)" for i in range(1, 9))}] AS v
  FROM n{k} JOIN p USING (vec_id, part) GROUP BY p.part, near.e),
b{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s{k}.v, b.v) AS v FROM {books} b LEFT JOIN s{k} ON s{k}.part = b.part AND s{k}.entry = b.entry)"""


_ROUNDS = ",\n".join(f"{_assigned(k, f'b{k - 1}')},\n{_moved(k, f'b{k - 1}')}" for k in range(1, 7))

SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[8 * part + 1:8 * part + 8] AS v FROM k, (SELECT unnest(range(0, 8)) AS part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 16),
b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN f USING (vec_id)),
{_ROUNDS},
{_assigned(7, "b6")},
c AS (SELECT vec_id, string_agg(printf('%02x', near.e), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM n7 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN k USING (vec_id), h
"""
