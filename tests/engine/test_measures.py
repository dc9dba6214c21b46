import math

import numpy as np
import pytest

from confuscope.operators import interpret as I

from .conftest import MATRICES, by_script


def brute(m):
    n, t, d = len(m), m.sum(), np.trace(m)
    off = m[~np.eye(n, dtype=bool)]
    e = off.sum()
    x = np.sort(off)
    k = len(x)
    g = 2 * (np.arange(1, k + 1) * x).sum() / (k * x.sum()) - (k + 1) / k if k and x.sum() > 0 else 0.0
    half = n // 2
    case = (m[:half, half:].sum() + m[half:, :half].sum()) / max(e, 1) if n > 1 else 0.0
    norm = np.linalg.norm(m)
    ent = [-sum(p * math.log(p) for p in r / r.sum() if p > 0) if r.sum() else 0.0 for r in m]
    return {
        "accuracy": d / t if t else 0.0, "error_rate": 1 - (d / t if t else 0.0), "sparsity": (m == 0).mean(), "gini": g, "top_share": x[::-1][:10].sum() / e if e else 0.0,
        "case_rate": case, "dominance": d / e if e else (math.inf if d else 0.0), "symmetry": 1 - np.linalg.norm(m - m.T) / (2 * norm) if norm else 1.0, "mean_entropy": float(np.mean(ent)),
    }


def test_all_measures(literal):
    got = by_script(I.interpretable_features(*literal))
    assert set(got) == set(MATRICES)
    for script, m in MATRICES.items():
        for k, v in brute(m).items():
            assert got[script][k] == pytest.approx(v, abs=1e-9), (script, k)


def test_single_measures_agree_with_the_whole(literal):
    whole = by_script(I.interpretable_features(*literal))
    for f, k in ((I.gini, "gini"), (I.top_error_share, "top_share"), (I.case_confusion_rate, "case_rate"), (I.diagonal_dominance, "dominance"), (I.symmetry_score, "symmetry"), (I.mean_row_entropy, "mean_entropy")):
        for script, r in by_script(f(*literal)).items():
            assert r[k] == pytest.approx(whole[script][k], abs=1e-12)


def test_spread(dead, literal):
    r = by_script(I.row_column_spread(*dead))["dead"]
    assert (r["zero_rows"], r["zero_cols"]) == (1, 1)
    assert r["row_variance"] == pytest.approx(np.var([5, 0, 5])) and r["col_variance"] == pytest.approx(np.var([6, 4, 0]))
    assert by_script(I.row_column_spread(*literal))["uniform"]["row_variance"] == 0
