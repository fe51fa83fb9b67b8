import pytest
from rowsets import pairs

from tessella.operators import lineage
from tessella.plans.bindings import governance
from tessella.plans.bindings.reports import lineage_report

TUPLES = "source string, target string, derivation string"
COPY, TRANSLATED = lineage.DERIVATIONS


def rules(report):
    return sorted((r["rule"], r["key"]) for r in report.collect())


def world(spark, drop=(), change=None, extra=()):
    """One source with three targets, one byte-identical copy, all consistent."""
    entries = [
        ("book.tex", "main.tex", TRANSLATED, "s1", "t1"),
        ("book.tex", "pre/a.tex", TRANSLATED, "s1", "t2"),
        ("refs.bib", "refs.bib", COPY, "s2", "s2"),
    ]
    rows = [
        [p, tgt, drv, src, sha_s, sha_t, ""]
        for p, (src, tgt, drv, sha_s, sha_t) in enumerate(entries)
        if tgt not in drop
    ]
    for index, column, value in change or ():
        rows[index][column] = value
    rows += list(extra)
    file_map = spark.createDataFrame(
        [tuple(r) for r in rows],
        "pos int, dissertation_file string, derivation string, source_2026_file string, "
        "source_sha256 string, current_sha256 string, notes string",
    )
    tree = [(t, h) for _, t, _, _, h in entries if t not in drop]
    return {
        "file_map": file_map,
        "order": "pos",
        "derived": spark.createDataFrame([(t,) for t, _ in tree], "rel string"),
        "targets": spark.createDataFrame(tree, "rel string, sha256 string"),
        "sources": spark.createDataFrame([("book.tex", "s1"), ("refs.bib", "s2")], "rel string, sha256 string"),
    }


def test_clean_file_map(spark):
    assert lineage.check_file_map(**world(spark)).isEmpty()


def test_dropping_target_and_row_together_is_found_by_the_fanout(spark):
    state = world(spark, drop=("pre/a.tex",))
    assert lineage.check_file_map(**state).isEmpty()
    expected = spark.createDataFrame(
        [("book.tex", "main.tex", TRANSLATED), ("book.tex", "pre/a.tex", TRANSLATED), ("refs.bib", "refs.bib", COPY)],
        TUPLES,
    )
    declared = state["file_map"].selectExpr("source_2026_file AS source", "dissertation_file AS target", "derivation")
    report = lineage.check_fanout(expected, declared, state["sources"].select("rel"), state["targets"].select("rel"))
    assert rules(report) == [("missing_target", "pre/a.tex"), ("missing_tuple", "book.tex -> pre/a.tex")]
    extra = declared.union(spark.createDataFrame([("x", "y", COPY)], TUPLES))
    report = lineage.check_fanout(expected, extra, spark.createDataFrame([("refs.bib",)], "rel string"), state["targets"].select("rel"))
    assert ("extra_tuple", "x -> y") in rules(report) and ("missing_source", "book.tex") in rules(report)


def test_file_map_mutations(spark):
    def found(**kw):
        return rules(lineage.check_file_map(**world(spark, **kw)))

    again = (9, "main.tex", "nonsense", "x", "", "", "")
    assert found(extra=[again]) == [("duplicate_row", "main.tex")]
    assert found(change=[(0, 2, "guessed")]) == [("unknown_derivation", "main.tex")]
    assert found(change=[(0, 3, "gone.tex")]) == [("missing_source", "main.tex")]
    assert found(change=[(0, 4, "bad")]) == [("source_drift", "main.tex")]
    assert found(change=[(0, 5, "bad")]) == [("stale_hash", "main.tex")]
    assert found(change=[(2, 5, "bad")]) == [("copy_differs", "refs.bib"), ("stale_hash", "refs.bib")]
    stray = (7, "stray.tex", COPY, "refs.bib", "s2", "s2", "")
    assert found(extra=[stray]) == [("missing_target", "stray.tex"), ("unexpected_target", "stray.tex")]
    state = world(spark)
    state["file_map"] = state["file_map"].filter("pos <> 1")
    assert rules(lineage.check_file_map(**state)) == [("missing_row", "pre/a.tex")]


def test_labels(spark):
    texts = spark.createDataFrame([(r"\label{fig:a} \label{tab:b} \label{eq:c}\label{fig:a}",)], "text string")
    inventory = spark.createDataFrame([("tab:b",)], "label string")
    report = lineage.uncovered_labels(texts, "text", inventory)
    assert pairs(report) == {("label_not_in_inventory", "fig:a", "")}


def test_file_map_sends_no_table_through_the_driver(spark):
    plan = lineage.check_file_map(**world(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fanout_and_labels_send_no_table_through_the_driver(spark):
    state = world(spark)
    declared = state["file_map"].selectExpr("source_2026_file AS source", "dissertation_file AS target", "derivation")
    labels = spark.createDataFrame([(r"\label{fig:a}",)], "text string")
    reports = [
        lineage.check_fanout(declared, declared, state["sources"].select("rel"), state["targets"].select("rel")),
        lineage.uncovered_labels(labels, "text", spark.createDataFrame([("fig:b",)], "label string")),
    ]
    for report in reports:
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_whole_report_broadcasts_nothing_while_it_runs(spark, data_dir):
    """What is joined by sorting at first stays so when Spark learns how small a side is."""
    report = lineage_report(spark, data_dir)
    assert report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("query", [governance.file_map, governance.lineage_fanout, governance.label_coverage])
def test_queries_that_share_a_step_of_the_report_broadcast_nothing(spark, data_dir, query):
    """Over stored tables, whose sizes Spark knows; rows made in a test are never taken for small."""
    report = query(spark, data_dir)
    assert report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
