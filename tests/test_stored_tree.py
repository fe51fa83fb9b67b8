import pytest
from pyspark.sql import functions as F
from rowsets import pairs

from tessella.errors import OutputExistsError
from tessella.operators import stored_tree as st
from tessella.operators.lineage import verify_tree


def tree(spark, n, changed=(), gone=(), new=()):
    rows = [(f"d/{k}.txt", f"h{k}" + ("x" if k in changed else "")) for k in range(n) if k not in gone]
    return spark.createDataFrame(rows + [(f"new/{k}", "n") for k in new], "rel string, sha256 string")


def stored(spark, frame, path):
    st.store_tree(frame, str(path))
    return st.read_tree(spark, str(path))


def test_report_equals_that_of_whole_trees(spark, tmp_path):
    old, now = tree(spark, 300), tree(spark, 300, changed={5, 77}, gone={8}, new={1, 2})
    now = now.union(spark.createDataFrame([("README.md", "r")], now.schema))
    a, b = stored(spark, old, tmp_path / "a"), stored(spark, now, tmp_path / "b")
    found = pairs(st.compare_trees(a, b))
    assert found == pairs(verify_tree(old, now)) and len(found) == 5
    left, right = st.changed_rows(a, b)
    assert left.count() < 10 and right.count() < 10
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan.split("PartitionFilters: [")[1][:400]
    assert len({r["folder"] for r in b.files.select("folder").distinct().collect()}) > 100


def test_equal_trees_open_nothing(spark, tmp_path):
    same = tree(spark, 40).union(tree(spark, 3))  # with copies
    a, b = stored(spark, same, tmp_path / "a"), stored(spark, same.orderBy(F.rand(1)), tmp_path / "b")
    assert pairs(a.nodes) == pairs(b.nodes) and st.compare_trees(a, b).isEmpty()
    assert a.level(0).first()["n"] == 43
    fewer = stored(spark, tree(spark, 40), tmp_path / "c")
    assert sum(r["n"] for r in st.changed_rows(a, fewer)[0].collect()) >= 6
    with pytest.raises(OutputExistsError):
        st.store_tree(same, str(tmp_path / "a"))


def test_empty_trees(spark, tmp_path):
    empty, some = stored(spark, tree(spark, 0), tmp_path / "e"), stored(spark, tree(spark, 2), tmp_path / "s")
    assert st.compare_trees(empty, empty).isEmpty()
    assert {r["rule"] for r in st.compare_trees(empty, some).collect()} == {"unlisted_file"}
