import numpy as np
import pytest
from pyspark.sql import functions as F

from confuscope.functions import arrays as A
from confuscope.operators import matrix as M
from confuscope.operators import profile as P

from .conftest import DEAD, LETTERS, MATRICES, SIMPLE, by_script, dense_of


@pytest.mark.parametrize("how", M.ZERO_ROWS)
def test_row_normalize(dead, how):
    got = dense_of(M.row_normalize(*dead, how), 3)
    want = np.array([[0.8, 0.2, 0], [0, 0, 0], [0.4, 0.6, 0]])
    want[1] = {"uniform": 1 / 3, "identity": np.array([0, 1, 0]), "zero": 0}[how]
    assert np.allclose(got, want)


def test_row_normalize_refuses(dead):
    with pytest.raises(ValueError):
        M.row_normalize(*dead, "other")


def test_symmetrize_and_laplacian(literal):
    cells, labels = (t.where("script = 'simple'") for t in literal)
    assert np.allclose(dense_of(M.symmetrize(cells), 5), (SIMPLE + SIMPLE.T) / 2)
    for normalized in (True, False):
        got = dense_of(M.laplacian(cells, labels, normalized), 5)
        assert np.allclose(got, M.dense_laplacian(SIMPLE, normalized))
    lam = np.linalg.eigvalsh(M.dense_laplacian(SIMPLE))
    assert abs(lam[0]) < 1e-12 and lam[-1] <= 2


def test_laplacian_of_isolated_labels(dead):
    got = dense_of(M.laplacian(*dead), 3)
    assert np.allclose(got, M.dense_laplacian(DEAD))


def test_sinkhorn():
    b, k, ok, row, col = M.sinkhorn(SIMPLE)
    assert ok and k < 1000 and np.allclose(b.sum(0), 1) and np.allclose(b.sum(1), 1) and max(row, col) < 1e-10
    assert not M.sinkhorn(DEAD, 3)[2]
    with pytest.raises(ValueError):
        M.sinkhorn(-SIMPLE)


def test_eigenvalues_and_verification():
    m = np.array([[0.9, 0.1], [0.4, 0.6]])
    lam = M.eigenvalues(m)
    assert lam.real.tolist() == pytest.approx([1.0, 0.5])
    M.verify(lam, "stochastic")
    for bad, kind in (([2.0, 1.0], "stochastic"), ([0.5, 0.1], "bistochastic"), ([1.0, 0.5], "laplacian"), ([1.0, -0.5, 0.0], "laplacian")):
        with pytest.raises(ValueError):
            M.verify(np.array(bad, dtype=complex), kind)
    rot = M.eigenvalues(np.array([[0.0, -1.0], [1.0, 0.0]]))
    assert np.allclose(np.abs(rot), 1) and np.abs(rot.imag).max() == pytest.approx(1)


def test_eigen_table(literal):
    cells, labels = (t.where("script in ('simple', 'one')") for t in literal)
    for kind, m in (("symmetric", (SIMPLE + SIMPLE.T) / 2), ("laplacian", M.dense_laplacian(SIMPLE)), ("stochastic", SIMPLE / SIMPLE.sum(1, keepdims=True)), ("bistochastic", M.sinkhorn(SIMPLE)[0])):
        rows = [r for r in M.eigen_table(cells, labels, kind, check=kind != "symmetric").orderBy("k").collect() if r["script"] == "simple"]
        assert sum(r["re"] for r in rows) == pytest.approx(np.trace(m))
        mags = [r["magnitude"] for r in rows]
        assert mags == sorted(mags, reverse=True)


def test_eigenvectors(literal):
    cells, labels = (t.where("script = 'simple'") for t in literal)
    for kind, m in (("laplacian", M.dense_laplacian(SIMPLE)), ("stochastic", SIMPLE / SIMPLE.sum(1, keepdims=True)), ("general", SIMPLE)):
        plain = [(r["re"], r["im"]) for r in M.eigen_table(cells, labels, kind).orderBy("k").collect()]
        rows = M.eigen_table(cells, labels, kind, vectors=True).orderBy("k").collect()
        assert np.allclose([(r["re"], r["im"]) for r in rows], plain)
        for r in rows:
            v = np.array(r["vector_re"]) + 1j * np.array(r["vector_im"])
            assert np.linalg.norm(v) == pytest.approx(1) and np.allclose(m @ v, (r["re"] + 1j * r["im"]) * v)


def test_spectral_features(literal):
    got = by_script(P.with_scalars(M.spectral_features(*literal)))
    assert set(got) == set(MATRICES)
    assert got["identity"]["bistochastic_gap"] == pytest.approx(0, abs=1e-6) and got["uniform"]["bistochastic_gap"] == pytest.approx(1, abs=1e-6)
    assert got["one"]["bistochastic_gap"] == got["one"]["fiedler_value"] == 0
    s = got["simple"]
    b = M.sinkhorn(SIMPLE)[0]
    lam = np.sort(np.abs(np.linalg.eigvals(b)))[::-1]
    assert np.allclose(s["bistochastic_spectrum"], lam)
    p = lam**2 / (lam**2).sum()
    assert s["bistochastic_entropy"] == pytest.approx(-(p * np.log(p)).sum()) and s["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    assert s["fiedler_value"] == pytest.approx(np.linalg.eigvalsh(M.dense_laplacian(SIMPLE))[1])
    assert len(M.spectral_features(*(t.where("script = 'sparse'") for t in literal), kept=7).first()["symmetric_spectrum"]) == 7


def test_spectra_do_not_depend_on_the_order_of_labels(spark):
    perm = [3, 1, 4, 0, 2]
    from .conftest import tables

    rows = by_script(M.spectral_features(*tables(spark, {"a": SIMPLE, "b": SIMPLE[np.ix_(perm, perm)]})))
    for k in ("bistochastic_spectrum", "symmetric_spectrum", "laplacian_spectrum"):
        assert np.allclose(rows["a"][k], rows["b"][k])


def test_profiles(literal):
    two = tuple(t.where("script in ('simple', 'uniform')") for t in literal)
    p = P.extract_profiles(*two).cache()
    rows = by_script(p)
    assert len(rows["simple"]["spectral_vec"]) == 6 and len(rows["simple"]["interpretable_vec"]) == 7 and len(rows["simple"]["vec"]) == 13
    c = P.compare_profiles(p).collect()[0]
    assert (c["a"], c["b"]) == ("simple", "uniform") and c["accuracy_diff"] == pytest.approx(457 / 508 - 0.1)
    assert '"script":"simple"' in P.profile_json(p).where("script = 'simple'").first()["json"]
    assert P.profile_summary(p).where("script = 'simple'").first()["summary"].startswith("simple: n=5")
    n = P.normalized_spectra(p).where("script = 'simple' and kind = 'laplacian'").first()
    assert sum(n["values"]) == pytest.approx(1) and n["cumulative"][-1] == pytest.approx(1)


def test_array_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x]) if x else F.array().cast("array<double>")
    assert val(A.wasserstein_1d(arr(1, 0), arr(0, 1))) == 0.5
    assert val(A.wasserstein_1d(arr(), arr())) == 0
    assert val(A.wasserstein_1d(arr(0, 0), arr(1, 1))) == pytest.approx(0.75)  # a zero vector stays as it is
    assert val(A.cumulative_wasserstein(arr(3, 1), arr(3, 1, 0), None)) == 0
    assert val(A.cumulative_wasserstein(arr(3, 1, 5), arr(3, 1, 9), 2)) == 0
    assert val(A.normalized_spectrum(arr(0, 0))) == [0.5, 0.5] and val(A.as_distribution(arr(0, 0))) == [0, 0]
    assert val(A.running(arr(1, 2, 3))) == [1, 3, 6] and val(A.running(arr())) == []
    assert val(A.spectral_entropy(arr(1, 1, 1))) == pytest.approx(np.log(3)) and val(A.spectral_entropy(arr())) == 0
    with pytest.raises(Exception, match="differ in length"):
        val(A.wasserstein_1d(arr(1), arr(1, 2)))
    assert LETTERS[0] == "a"
