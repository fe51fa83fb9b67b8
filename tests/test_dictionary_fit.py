import numpy as np
import pytest

from tessella.operators import inference
from tessella.plans import dictionary_fit as fits

GEN = np.random.default_rng(8)
X = GEN.standard_normal((60, 4))
PHI = np.linalg.qr(GEN.standard_normal((4, 4)))[0][:, :3]
LAM = np.full((2, 3), 0.5)
OPTIONS = {"rate": 0.4, "n_steps": 3, "eta": 0.3, "penalty_weight": 0.01, "batches": 2}


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(X)], "k int, x array<double>").repartition(3, "k")


def test_a_killed_run_resumes_where_it_stopped(spark, table, tmp_path, monkeypatch):
    whole = fits.fit_dictionary(table, "k", "x", PHI, LAM, root=str(tmp_path / "whole"), steps=4, **OPTIONS)
    move, calls = inference.dictionary_move, []

    def killed(*args, **kw):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return move(*args, **kw)

    root = str(tmp_path / "cut")
    monkeypatch.setattr(inference, "dictionary_move", killed)
    with pytest.raises(RuntimeError, match="killed"):
        fits.fit_dictionary(table, "k", "x", PHI, LAM, root=root, steps=4, **OPTIONS)
    assert sorted(r["version"] for r in fits.versions(spark, root).collect()) == [0, 1, 2]
    resumed = fits.fit_dictionary(table, "k", "x", PHI, LAM, root=root, steps=4, **OPTIONS)
    assert len(calls) == 5 and resumed.version == whole.version == 4
    np.testing.assert_allclose(resumed.phi, whole.phi, rtol=1e-12)
    again = fits.fit_dictionary(table, "k", "x", PHI, LAM, root=root, steps=4, **OPTIONS)
    assert len(calls) == 5 and (again.phi == resumed.phi).all()


def test_batches_follow_keys_and_the_stop_rule_ends_a_fit(spark, table, tmp_path):
    once = fits.fit_dictionary(table, "k", "x", PHI, LAM, root=str(tmp_path / "a"), steps=2, **OPTIONS)
    other = fits.fit_dictionary(table.repartition(7), "k", "x", PHI, LAM, root=str(tmp_path / "b"), steps=2, **OPTIONS)
    np.testing.assert_allclose(once.phi, other.phi, rtol=1e-10)
    sizes = {r["version"]: r["n_rows"] for r in fits.versions(spark, str(tmp_path / "a")).collect()}
    assert sizes[0] == 0 and sizes[1] + sizes[2] == 60 and min(sizes[1], sizes[2]) > 10
    ended = fits.fit_dictionary(table, "k", "x", PHI, LAM, root=str(tmp_path / "c"), steps=50, tolerance=0.9, **OPTIONS)
    assert ended.stopped and ended.version == 4


def test_foreign_and_broken_states_are_refused(spark, table, tmp_path):
    root = str(tmp_path / "s")
    fits.fit_dictionary(table, "k", "x", PHI, LAM, root=root, steps=1, **OPTIONS)
    with pytest.raises(ValueError, match="another fit"):
        fits.fit_dictionary(table, "k", "x", PHI, LAM, root=root, steps=1, **OPTIONS | {"rate": 0.5})
    config = fits.versions(spark, root).first()["config"]
    fits._store(spark, root, (3, config, 1.0, 1, PHI.tolist()))
    with pytest.raises(ValueError, match="lacks"):
        fits.fit_dictionary(table, "k", "x", PHI, LAM, root=root, steps=2, **OPTIONS)
    fits._store(spark, root, (1, config, 9.0, 1, PHI.tolist()))
    with pytest.raises(ValueError, match="same time"):
        fits.fit_dictionary(table, "k", "x", PHI, LAM, root=root, steps=2, **OPTIONS)
