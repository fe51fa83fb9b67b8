import numpy as np
from rowsets import pairs
from pyspark.sql import functions as F

from tessella.operators.leakscan import scan_texts
from tessella.plans.representation import apply_representation, fit_representation
from tessella.streaming import modes


def run(stream, tmp_path, name, spark):
    out = str(tmp_path / f"{name}-out")
    modes.append_to_files(stream, out, str(tmp_path / f"{name}-ck")).awaitTermination()
    return spark.read.parquet(out)


def replay(spark, frame, tmp_path, name, parts=3):
    """The rows of a table as a file stream of several small batches."""
    path = str(tmp_path / f"{name}-in")
    frame.repartition(parts).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_leak_scan_on_a_stream_equals_batch(spark, tmp_path, data_dir):
    orders = spark.read.parquet(f"{data_dir}/orders.parquet")
    texts = orders.selectExpr(
        "concat('o/', o_orderkey, '.txt') AS path",
        "concat('ok\\n', IF(o_orderkey % 4 = 0, '/scratch/user', 'x'), o_custkey, '\\n') AS text",
    )
    got = run(modes.scan_stream(replay(spark, texts, tmp_path, "scan")), tmp_path, "scan", spark)
    want = pairs(scan_texts(texts))
    assert pairs(got) == want and len(want) > 300


def test_frozen_representation_on_a_stream_equals_batch(spark, tmp_path, data_dir):
    table = spark.read.parquet(f"{data_dir}/embeddings.parquet").select(
        "vec_id", F.when(F.col("label") < 7, "train").otherwise("test").alias("role"),
        F.slice(F.col("embedding").cast("array<double>"), 1, 48).alias("f"),
    )
    fitted = fit_representation(table, "f")
    stream = modes.represent_stream(replay(spark, table, tmp_path, "rep"), "f", fitted)
    got = run(stream, tmp_path, "rep", spark).orderBy("vec_id").collect()
    want = table.select("vec_id", apply_representation(F.col("f"), fitted).alias("z")).orderBy("vec_id").collect()
    np.testing.assert_allclose([r["features"] for r in got], [r["z"] for r in want], atol=1e-12)


def test_first_seen_content(spark, tmp_path, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").selectExpr(
        "doc_id", "sha2(text, 256) AS content_sha256", "timestamp'2026-01-01' + make_interval(0,0,0,0,0,0, doc_id) AS at"
    )
    doubled = docs.union(docs)
    stream = modes.first_seen_content(replay(spark, doubled, tmp_path, "seen"), "at", "1 day")
    got = run(stream, tmp_path, "seen", spark)
    assert got.count() == docs.select("content_sha256").distinct().count()
