"""Replays of tables as streams against the batch rules."""

from pyspark.sql import functions as F
from rowsets import pairs

from tessella.operators import manifest as m
from tessella.plans.bindings.integrity import document_manifest
from tessella.streaming import content, modes


def replayed(spark, rows, tmp_path, parts):
    """The rows in shuffled files of one micro-batch each, then one late enough to close every state."""
    path = tmp_path / "in"
    rows.withColumn("r", F.rand(4)).repartition(parts, "r").drop("r").write.parquet(str(path))
    closing = spark.createDataFrame([("closing", "train", "2030-01-01 00:00:00")], "content_sha256 string, role string, at string")
    closing.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(path))
    # Files are taken in the order of their time stamps.
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(path))


def test_replay_equals_the_batch_rules(spark, tmp_path, data_dir):
    content.use_keyed_state(spark)
    docs = document_manifest(spark, data_dir)
    rows = docs.select("content_sha256", "role", (F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("split_id"), F.lit(3000)))).alias("at"))
    stream = content.content_findings(replayed(spark, rows, tmp_path, 5), "at", "2 hours")
    out = str(tmp_path / "out")
    modes.append_to_files(stream, out, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema(content.FINDINGS).parquet(out)
    totals = m.key_totals(docs)
    want = m.split_leakage(totals).union(m.duplicate_content(totals))
    found = pairs(got.filter("rule <> 'leakage_seen'").select("rule", "key", "detail"))
    assert found == {tuple(str(v) for v in r) for r in want.select("rule", "key", "detail").collect()} and len(found) > 5
    seen = got.filter("rule = 'leakage_seen'")
    assert pairs(seen.select("key").distinct()) == pairs(m.split_leakage(totals).select("key"))
    assert pairs(seen.groupBy("key").agg(F.max_by("detail", F.length("detail")))) == pairs(m.split_leakage(totals).select("key", "detail"))


def test_state_travels_with_the_rows(spark):
    """Calls to the store for every digest made a digest cost milliseconds."""
    rows = spark.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS content_sha256", "'train' AS role", "timestamp AS at")
    plan = content.content_findings(rows, "at", "2 hours")._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
