import pytest
from rowsets import pairs

from tessella.errors import PinConflictError
from tessella.operators import ledger
from tessella.plans import jobs
from tessella.sources import ledgers, registry

D1, D2 = "sha256:" + "1" * 64, "sha256:" + "2" * 64


def incoming(spark, digest, archive="a.zip"):
    return spark.createDataFrame([("div2k", archive, digest)], "dataset string, archive string, sha256 string")


def request(spark, **changes):
    row = {"dataset": "DIV2K", "token": "--accept-academic-research-terms", "terms_sha256": D1,
           "accepted_at_iso": "2026-01-02T03:04:05Z"} | changes
    return spark.createDataFrame(
        [tuple(row.values())], "dataset string, token string, terms_sha256 string, accepted_at_iso string"
    )


def test_pin_life_cycle(spark, tmp_path):
    root = str(tmp_path / "ledger")
    with pytest.raises(ValueError, match="terms"):
        ledgers.record_pins(incoming(spark, D1), root)
    jobs.accept_terms(request(spark), root)
    assert ledgers.read_terms(spark, root).first()["dataset"] == "div2k"
    ledgers.record_pins(incoming(spark, D1), root)
    ledgers.record_pins(incoming(spark, D1), root)  # idempotent
    assert ledgers.read_pin_ledger(spark, root).count() == 1
    with pytest.raises(PinConflictError):
        ledgers.record_pins(incoming(spark, D2), root)
    change = incoming(spark, D2).selectExpr("*", "'new release' AS reason")
    ledgers.rotate_pins(change, root)
    assert pairs(ledgers.read_pins(spark, root).select("sha256")) == {(D2,)}
    assert pairs(ledgers.read_rotation_log(spark, root)) == {("a.zip", D1, D2, "new release")}
    with pytest.raises(Exception, match="reason"):
        ledgers.rotate_pins(incoming(spark, D1).selectExpr("*", "' ' AS reason"), root)


def test_verify_pins(spark):
    pins = incoming(spark, D1)
    seen = incoming(spark, D2).union(incoming(spark, D1, "b.zip")).union(incoming(spark, D1))
    status = ledger.verify_pins(seen, pins).select("archive", "status")
    assert pairs(status) == {("a.zip", "mismatch"), ("b.zip", "unpinned"), ("a.zip", "ok")}


def test_conflict_inside_one_batch(spark):
    both = incoming(spark, D1).union(incoming(spark, D2))
    actions = ledger.pin_actions(both, incoming(spark, D1, "z.zip"))
    assert pairs(actions.select("archive", "action")) == {("a.zip", "conflict")}


@pytest.mark.parametrize(
    ("changes", "status"),
    [
        ({}, "accepted"),
        ({"token": "yes"}, "wrong_token"),
        ({"dataset": "mnist"}, "unknown_dataset"),
        ({"terms_sha256": None}, "missing_terms"),
        ({"accepted_at_iso": "yesterday"}, "bad_timestamp"),
        ({"accepted_at_iso": "2026-02-30"}, "bad_timestamp"),
        ({"accepted_at_iso": "2026-02-28"}, "accepted"),
        ({"accepted_at_iso": "2026-02-28T10"}, "accepted"),
        ({"accepted_at_iso": "2026-02-28 10:11+0200"}, "accepted"),
        ({"accepted_at_iso": "20260228T101112.5Z"}, "accepted"),
        ({"accepted_at_iso": "2026-02-28T24:11"}, "bad_timestamp"),
        ({"accepted_at_iso": "2026-02-28T10:11:12+25:00"}, "bad_timestamp"),
        ({"accepted_at_iso": ""}, "bad_timestamp"),
    ],
)
def test_terms_requests(spark, changes, status):
    judged = ledger.judge_terms(request(spark, **changes), registry.registry_table(spark))
    assert judged.first()["status"] == status


def test_archives_on_storage(spark, tmp_path):
    files, root = tmp_path / "files", str(tmp_path / "ledger")
    files.mkdir()
    (files / "DIV2K_train_HR.zip").write_bytes(b"archive")
    jobs.accept_terms(request(spark), root)
    jobs.record_archives(spark, "div2k", str(files), root)
    assert pairs(jobs.verify_archives(spark, "div2k", str(files), root).select("status")) == {("ok",)}
    (files / "DIV2K_train_HR.zip").write_bytes(b"changed")
    assert pairs(jobs.verify_archives(spark, "div2k", str(files), root).select("status")) == {("mismatch",)}
    (files / "other.zip").write_bytes(b"x")
    with pytest.raises(ValueError, match="archive names"):
        jobs.verify_archives(spark, "div2k", str(files), root)


def test_registry(spark):
    assert registry.dataset_names() == ("bsds500", "div2k")
    assert registry.roles_of("DIV2K") == {"train", "val", "test"}
    with pytest.raises(ValueError):
        registry.splits_of("mnist")
    ids = registry.dataset_ids(spark, "DIV2K")
    assert ids.count() == 900 and ids.agg({"split_id": "min"}).first()[0] == "0001"
    assert registry.dataset_ids(spark, "div2k", "train").count() == 720
    assert registry.predicted_ids(spark, "bsds500") is None
    wide = registry.splits_table(spark).filter("dataset = 'div2k'")
    assert registry.expand_ranges(wide, chunk=7).select("id").distinct().count() == 900
    located = registry.assign_roles(spark.range(1, 901).withColumnRenamed("id", "n"), "n", wide, chunk=64)
    counts = {r["role"]: r["count"] for r in located.groupBy("role").count().collect()}
    assert counts == {"train": 720, "val": 80, "test": 100}
    with pytest.raises(ValueError):
        registry.checked_splits((("d", "x", 2, 1, "train"),))
    assert jobs.list_datasets(spark).count() == 2


def chain(spark, *rows):
    return spark.createDataFrame([("d", "a", *r) for r in rows], ledger.PINS_SCHEMA)


def test_whole_chains_have_no_problems(spark):
    rows = [("h0", None, None, 0), *[(f"h{k}", f"h{k - 1}", "why", k) for k in range(1, 6)]]
    assert ledger.chain_problems(chain(spark, *rows)).isEmpty()
    assert ledger.chain_problems(chain(spark)).isEmpty()


def test_chain_faults(spark):
    rows = [
        ("h0", None, None, 0), ("h0", None, None, 0),  # the same entry twice
        ("h1", "h0", "why", 1), ("x1", "h0", "why", 1),  # two appends at the same time
        ("h2", "x1", " ", 2),  # follows one of them, without a reason
        ("h4", "h3", "why", 4),  # the third is gone
        ("h5", "other", "why", 5), ("h6", None, "why", 6), ("b", None, None, None), ("c", None, None, -2),
    ]
    found = ledger.chain_problems(chain(spark, *rows))
    assert pairs(found.select("seq", "rule", "detail")) == {
        (0, "repeated_entry", "2"), (1, "fork", "2"), (2, "no_reason", "h2"), (4, "gap", ""),
        (5, "broken_prior", "other"), (6, "broken_prior", ""), (None, "bad_number", "b"), (-2, "bad_number", "c"),
    }
    first = chain(spark, ("h0", "z", None, 0))
    assert pairs(ledger.chain_problems(first).select("rule", "detail")) == {("first_with_prior", "z")}


def test_divergent_pins_are_reported_not_chosen(spark, tmp_path):
    root = str(tmp_path / "ledger")
    for digest in (D1, D2):  # as two writers that read the empty ledger would leave it
        ledgers._append(chain(spark, (digest, None, None, 0)), root)
    pins = ledgers.read_pins(spark, root)
    assert pairs(pins) == {("d", "a", None, 0, True)}
    assert pairs(ledgers.verify_chains(spark, root).select("rule", "detail")) == {("fork", "2")}
    seen = spark.createDataFrame([("d", "a", D1)], "dataset string, archive string, sha256 string")
    assert pairs(ledger.verify_pins(seen, pins).select("status")) == {("divergent",)}
    with pytest.raises(PinConflictError):
        ledgers.record_pins(seen, root, require_acceptance=False)
    with pytest.raises(Exception, match="divergent pins of d/a"):
        ledgers.rotate_pins(seen.selectExpr("*", "'why' AS reason"), root)


def test_two_changes_of_an_archive_are_refused(spark):
    pins = ledger.current_pins(chain(spark, (D1, None, None, 0)))
    both = spark.createDataFrame([("d", "a", D2, "x"), ("d", "a", D1, "y")], "dataset string, archive string, sha256 string, reason string")
    with pytest.raises(Exception, match="more than one change of d/a"):
        ledger.rotation_entries(both, pins).collect()
    one = ledger.rotation_entries(both.limit(1), pins).first()
    assert (one["prior"], one["seq"]) == (D1, 1)
