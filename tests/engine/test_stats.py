import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from confuscope.functions.scalar import incomplete_beta, student_t_two_sided
from confuscope.operators import stats as S

P = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04]


def adjusted(p, method):
    p = np.array(p)
    n, order = len(p), np.argsort(p, kind="stable")
    out = np.empty(n)
    if method == "bonferroni":
        return np.minimum(p * n, 1)
    if method == "holm":
        out[order] = np.maximum.accumulate(p[order] * (n - np.arange(n)))
    else:
        c = sum(1 / k for k in range(1, n + 1)) if method == "fdr-by" else 1
        out[order] = np.minimum.accumulate((p[order] * n * c / np.arange(1, n + 1))[::-1])[::-1]
    return np.minimum(out, 1)


@pytest.mark.parametrize("method", S.CORRECTIONS)
def test_corrections(spark, method):
    df = spark.createDataFrame([("f", f"t{k}", p) for k, p in enumerate(P)] + [("g", "t0", 0.04)], "family string, test_id string, p double")
    rows = {(r["family"], r["test_id"]): r for r in S.correct_pvalues(df, method).collect()}
    want = adjusted(P, method)
    for k in range(len(P)):
        assert rows["f", f"t{k}"]["p_adj"] == pytest.approx(want[k]) and rows["f", f"t{k}"]["significant"] == (want[k] < 0.05)
    assert rows["g", "t0"]["p_adj"] == pytest.approx(0.04)
    s = {r["family"]: r for r in S.correction_summary(S.correct_pvalues(df, method)).collect()}
    assert s["f"]["n_tests"] == 6 and s["f"]["n_significant"] == (want < 0.05).sum()


def test_levels_and_methods(spark):
    assert S.pairwise_alpha(4) == pytest.approx(0.05 / 6) and S.pairwise_alpha(4, "holm") == 0.05
    with pytest.raises(ZeroDivisionError):
        S.pairwise_alpha(1)
    with pytest.raises(ValueError):
        S.correct_pvalues(spark.range(1), "other")


def test_correlations(spark):
    x, y = [1, 2, 2, 4, 5, 6], [2, 1, 3, 3, 6, 5]
    rows = [("f", f"i{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [("c", "i0", 1.0, 1.0), ("c", "i1", 1.0, 2.0), ("one", "i", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "family string, id string, x double, y double")
    rank = lambda v: np.array([np.mean([i + 1 for i, z in enumerate(sorted(v)) if z == q]) for q in v])
    s = {r["family"]: r for r in S.spearman(df).collect()}
    assert s["f"]["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and s["c"]["rho"] is None and s["one"]["rho"] is None
    c = d = tx = ty = good = ordered = 0
    for i in range(6):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            c, d, tx, ty = c + (a * b > 0), d + (a * b < 0), tx + (a == 0 and b != 0), ty + (a != 0 and b == 0)
            ordered, good = ordered + (a != 0), good + (a != 0 and a == b)
    k = {r["family"]: r for r in S.kendall(df).collect()}
    assert k["f"]["tau"] == pytest.approx((c - d) / math.sqrt((c + d + ty) * (c + d + tx))) and k["f"]["rank_preservation"] == pytest.approx(good / ordered)
    assert k["c"]["tau"] is None and k["one"]["rank_preservation"] == 0


def test_tails():
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248) and incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)
    assert student_t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and student_t_two_sided(0, 5) == pytest.approx(1)
    assert S.spearman_p(1.0, 5) == 0 and S.spearman_p(None, 5) is None and S.spearman_p(0.5, 20) == pytest.approx(0.0249, abs=2e-4)
    assert S.kendall_p(0.0, 10) == 1 and S.kendall_p(0.6, 10) == pytest.approx(0.0158, abs=1e-3)


def test_effect_size(spark):
    e = lambda x, m, s: spark.range(1).select(S.effect_size(F.lit(x), F.lit(m), F.lit(s)).alias("e")).first()["e"]
    assert e(3.0, 1.0, 2.0) == 1 and e(1.0, 1.0, 0.0) == 0 and e(2.0, 1.0, 0.0) == math.inf


def test_resampling_queries_run_the_default_number_of_replicates(monkeypatch):
    from confuscope.plans import queries as Q

    for name, summary, run in (("bootstrap_replicates", "bootstrap_summary", Q._boot), ("permutation_replicates", "permutation_summary", Q._perm)):
        monkeypatch.setattr(Q.R, name, lambda c, n, **given: given)
        monkeypatch.setattr(Q.R, summary, lambda given: given)
        assert run(None, None) == {}


def test_exact_kendall_p_counts_orders():
    from itertools import combinations, permutations

    for n in (2, 3, 4, 6):
        orders = [sum(a > b for a, b in combinations(o, 2)) for o in permutations(range(n))]
        for wrong in range(n * (n - 1) // 2 + 1):
            tau = 1 - 4 * wrong / (n * (n - 1))
            far = min(wrong, n * (n - 1) // 2 - wrong)
            want = min(1.0, 2 * sum(x <= far for x in orders) / len(orders))
            assert S.kendall_p(tau, n, 0) == pytest.approx(want)
    assert S.kendall_p(1.0, 50, 0) < 1e-60 and S.kendall_p(0.5, 40, 0) == S.kendall_p(0.5, 40)
