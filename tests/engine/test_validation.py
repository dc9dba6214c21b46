import math

import numpy as np
import pytest

from confuscope.operators import resample as R
from confuscope.operators import validation as V
from confuscope.operators.counts import label_table, matrix_metrics

from .conftest import SIMPLE, by_script, tables


def test_resampling_functions():
    rng = R.rng_for(1, "a")
    s = R.subsample(SIMPLE, 0.5, rng)
    assert s.sum() == 254 and (s >= 0).all() and (R.subsample(np.zeros((2, 2)), 0.5, rng) == 0).all()
    with pytest.raises(ValueError):
        R.subsample(SIMPLE, 0, rng)
    for how in R.PERMUTATIONS:
        p = R.permute(SIMPLE, how, R.rng_for(1, how))
        assert sorted(p.ravel()) == sorted(SIMPLE.ravel())
    rows = R.permute(SIMPLE, "rows", rng)
    assert all(sorted(a) == sorted(b) for a, b in zip(rows, SIMPLE, strict=True))
    block = R.permute(SIMPLE, "block", rng)
    assert (block[4] == SIMPLE[4]).all() and (block[:, 4] == SIMPLE[:, 4]).all() and sorted(block[:2, 2:4].ravel()) == sorted(SIMPLE[:2, 2:4].ravel())
    with pytest.raises(ValueError):
        R.permute(SIMPLE, "other", rng)


def test_resampled_cells(spark):
    t = tables(spark, {"x": SIMPLE, "y": np.eye(3) * 10})
    got = R.resampled_cells(*t, fraction=0.5, replicates=2)
    sums = {(r["script"], r["rep"]): r["s"] for r in got.groupBy("script", "rep").sum("n").withColumnRenamed("sum(n)", "s").collect()}
    assert sums == {("x", 0): 254, ("x", 1): 254, ("y", 0): 15, ("y", 1): 15}
    again = R.resampled_cells(t[0].repartition(3), t[1], fraction=0.5, replicates=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert {r["script"] for r in R.resampled_cells(*t, how="rows").collect()} == {"x_permuted", "y_permuted"}
    with pytest.raises(ValueError):
        R.resampled_cells(*t, how="other")


@pytest.fixture(scope="module")
def pair(spark):
    return tables(spark, {"x": SIMPLE, "y": np.full((5, 5), 20.0)})


def test_bootstrap(pair):
    reps = R.bootstrap_replicates(*pair, replicates=60).cache()
    d = [r["d"] for r in reps.where("rep >= 0").collect()]
    assert len(d) == 60
    s = R.bootstrap_summary(reps).first()
    assert s["mean"] == pytest.approx(np.mean(d)) and s["std"] == pytest.approx(np.std(d))
    assert (s["ci_lower"], s["ci_upper"]) == pytest.approx(tuple(np.percentile(d, [2.5, 97.5])))
    assert s["observed"] == pytest.approx(R.spectral_distance(SIMPLE, np.full((5, 5), 20.0))) and s["ci_width"] > 0
    assert sorted(d) == sorted(r["d"] for r in R.bootstrap_replicates(pair[0].repartition(3), pair[1], replicates=60).where("rep >= 0").collect())
    assert R.significant_differences(R.bootstrap_summary(reps), ("y", "x")).count() == 0


def test_permutation(pair):
    reps = R.permutation_replicates(*pair, "full", replicates=40).cache()
    null = np.array([r["d"] for r in reps.where("rep >= 0").collect()])
    obs = reps.where("rep < 0").first()["d"]
    for alt, p in (("less", (null <= obs).mean()), ("greater", (null >= obs).mean()), ("two-sided", min(1, 2 * min((null <= obs).mean(), (null >= obs).mean())))):
        s = R.permutation_summary(reps, alt).first()
        assert s["p_value"] == pytest.approx(p) and s["significant"] == (p < 0.05) and s["null_std"] == pytest.approx(null.std())
    with pytest.raises(ValueError):
        R.permutation_summary(reps, "other")


def test_stability(pair):
    assert all(r["stable"] and r["max_distance"] >= 0 for r in R.stability(*pair, trials=3).collect())


def test_synthetic(spark):
    base = R.base_matrix(26, R.rng_for(1))
    assert np.trace(base) / base.sum() >= 0.849
    cells = R.synthetic_cells(spark, per_group=3, n_chars=12).cache()
    sims = {r["script"]: r for r in R.synthetic_similarities(cells).collect()}
    assert len(sims) == 9 and all(0.05 <= r["similarity_to_base"] <= 0.95 for r in sims.values())
    mean = lambda g: np.mean([r["similarity_to_base"] for r in sims.values() if r["grp"] == g])
    assert mean("A") > mean("B") > mean("C")
    m = by_script(matrix_metrics(cells, label_table(cells)))
    assert m["synthetic_A_0"]["size"] == 12 and m["synthetic_A_0"]["accuracy"] > m["synthetic_C_0"]["accuracy"]
    v = V.synthetic_validation(spark, per_group=3, n_chars=12).first()
    assert v["n_pairs"] == 36 and v["spearman_rho"] > 0.3 and 0 <= v["rank_preservation"] <= 1 and v["passed"] == (v["spearman_rho"] >= 0.7)
    p = V.p_values(v)
    assert 0 <= p["spearman_p"] < 0.05 and 0 <= p["kendall_p"] < 0.05


def test_method_comparison(spark):
    rows = V.method_comparison(spark, {"latin": 8}, per_group=2).collect()
    rho = {r["method"]: r["rho"] for r in rows}
    assert len(rows) == 4 and all(r["proposed_wins"] == (rho["spectral"] > max(rho["frobenius"], rho["accuracy"])) for r in rows)


def test_historical(spark):
    dist = spark.createDataFrame([("french", "latin", 0.1), ("arabic", "greek", 0.9), ("greek", "latin", 0.5), ("french", "greek", 0.3)], "a string, b string, d double")
    r = V.historical_validation(dist, V.relationships(spark)).first()
    assert (r["n_relationships"], r["n_correct"], r["n_ordered"], r["ordering_accuracy"], r["passed"]) == (3, 3, 3, 1.0, True)
    assert r["rho"] == pytest.approx(1)
    none = V.historical_validation(dist.where("a = 'zz'"), V.relationships(spark)).first()
    assert (none["n_relationships"], none["rho"], none["passed"]) == (0, 0, False)
    two = V.historical_validation(dist.where("d in (0.1, 0.5)"), V.relationships(spark)).first()
    assert two["n_relationships"] == 2 and two["rho"] == 0


def test_families(spark):
    dist = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 4.0), ("b", "c", 6.0)], "a string, b string, d double")
    fam = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "script string, family string")
    r = V.family_separation(dist, fam).first()
    assert (r["within_mean"], r["between_mean"], r["separation"], r["n_within"], r["n_between"]) == (1, 5, 0.2, 1, 2)
    assert V.family_separation(dist.where("c = 'x'") if "c" in dist.columns else dist.where("a = 'zz'"), fam).first()["separation"] == math.inf


def test_matrix_checks(literal):
    checks = V.validate_matrices(*literal).cache()
    got = {(r["script"], r["check_name"]): r for r in checks.collect()}
    assert len(got) == 42
    assert not got["uniform", "accuracy"]["passed"] and got["uniform", "accuracy"]["error"] == "accuracy too low"
    assert got["identity", "accuracy"]["warning"] == "suspiciously high accuracy" and got["one", "size"]["warning"] == "very small"
    assert not got["zero", "no_zero_rows_or_columns"]["passed"]
    s = by_script(V.validation_summary(checks))
    assert s["identity"]["overall_passed"] and not s["uniform"]["overall_passed"]
    a = V.all_validated(V.validation_summary(checks)).first()
    assert a["n_matrices"] == 6 and a["n_passed"] + a["n_failed"] == 6


def test_inputs(spark):
    names = lambda *x: spark.createDataFrame([(s, f"f{k}") for s, n in x for k in range(n)], "script string, filename string")
    r = by_script(V.validate_inputs(names(("a", 10), ("b", 10), ("c", 1)), names(("a", 10), ("b", 5), ("d", 2)), ["a", "b", "c", "d"]))
    assert r["a"]["passed"] and r["a"]["message"] is None and r["b"]["message"] == "low coverage" and r["b"]["passed"]
    assert not r["c"]["passed"] and r["c"]["message"] == "no labels" and r["d"]["message"] == "no images"
    o = spark.createDataFrame([("a", "t", None), ("a", None, None), ("a", "t", "bad")], "script string, text string, error string")
    s = V.run_statistics(o).first()
    assert (s["processed"], s["skipped"], s["errors"]) == (1, 1, 1)
