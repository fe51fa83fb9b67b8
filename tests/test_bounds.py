import numpy as np
import pytest
from pyspark.sql import functions as F
from rowsets import pairs

from tessella import session
from tessella.errors import SizeBoundError
from tessella.functions.text import resolve_under_root
from tessella.operators.fingerprint import row_digest, table_digest, tree_digest
from tessella.sources import tables


def cells(spark, n, m):
    return spark.range(n * m).selectExpr(f"CAST(id DIV {m} AS INT) AS i", f"CAST(id % {m} AS INT) AS j", "CAST(id AS DOUBLE) AS w")


def test_matrices_are_bounded(spark):
    dense = session.bounded_matrix(cells(spark, 4, 3), "i", "j", "w")
    np.testing.assert_array_equal(dense, np.arange(12.0).reshape(4, 3))
    with pytest.raises(SizeBoundError):
        session.bounded_matrix(cells(spark, 4, 3), "i", "j", "w", max_cells=11)
    sparse = spark.createDataFrame([(0, 1_000_000, 1.0), (1_000_000, 0, 1.0)], "i int, j int, w double")
    with pytest.raises(SizeBoundError):
        session.bounded_matrix(sparse, "i", "j", "w")
    with pytest.raises(ValueError):
        session.bounded_matrix(sparse.filter("i < 0"), "i", "j", "w")
    with pytest.raises(SizeBoundError):
        session.bounded_rows(spark.range(5), 4, "rows")


def test_group_statistics_join_either_way(spark):
    big = spark.range(1000).selectExpr("id", "id % 7 AS g")
    stats = big.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    few = big.join(session.broadcast_if_small(stats), "g")
    many = big.join(session.broadcast_if_small(stats, max_rows=3), "g")
    assert pairs(few) == pairs(many)
    assert session.broadcast_if_small(stats, max_rows=3) is stats


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread_small(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 32)
    assert session.spread_small(wide) is wide


def test_table_digest(spark):
    frame = spark.range(500).selectExpr("id % 50 AS k", "IF(id % 50 = 3, NULL, CAST(id % 50 AS STRING)) AS v")
    base = table_digest(frame, row_digest("k", "v")).first()
    assert base["n_rows"] == 500
    assert table_digest(frame.repartition(9), row_digest("k", "v")).first() == base
    assert table_digest(frame.union(frame.limit(1)), row_digest("k", "v")).first()["digest"] != base["digest"]
    assert table_digest(frame.distinct(), row_digest("k", "v")).first()["digest"] != base["digest"]
    shifted = frame.withColumn("v", F.coalesce("v", F.lit("")))
    assert table_digest(shifted, row_digest("k", "v")).first()["digest"] != base["digest"]
    tree = spark.createDataFrame([("a", "1"), ("b", "2")], "rel string, sha256 string")
    assert tree_digest(tree).first() == tree_digest(tree.orderBy(F.desc("rel"))).first()


def test_paths_stay_under_the_root(spark):
    frame = spark.createDataFrame([("a/b.png",)], "p string")
    assert frame.select(resolve_under_root("/data/", F.col("p"))).first()[0] == "/data/a/b.png"
    with pytest.raises(Exception, match="unsafe"):
        frame.select(resolve_under_root("/data", F.concat(F.lit("../"), "p"))).collect()


def test_lineage_tables(spark, tmp_path):
    (tmp_path / "map.csv").write_text(
        "dissertation_file,derivation,source_2026_file,source_sha256,current_sha256,notes\n"
        'a.tex,translated-from,b.tex,s,c,"one, two"\n'
    )
    table = tables.read_file_map(spark, str(tmp_path / "map.csv"))
    assert table.first()["notes"] == "one, two" and table.first()["pos"]["row"] == 0
    (tmp_path / "expected.csv").write_text("source_2026_file,dissertation_file,derivation\nb.tex,a.tex,translated-from\n")
    expected = tables.read_expected_tuples(spark, str(tmp_path / "expected.csv"))
    assert pairs(expected) == pairs(tables.declared_tuples(table))
    (tmp_path / "inventory.csv").write_text("kind,latex_label\nfigure,fig:a\n")
    assert pairs(tables.read_inventory(spark, str(tmp_path / "inventory.csv"))) == {("fig:a",)}
    with pytest.raises(ValueError):
        tables.read_inventory(spark, str(tmp_path / "inventory.csv"), "label")
