import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from confuscope.operators import distance as D
from confuscope.operators import profile as P
from confuscope.operators.resample import spectral_distance as dense_distance

from .conftest import MATRICES, tables


def pairs_of(df):
    return {(r["a"], r["b"]): r["d"] for r in df.collect()}


def fro(x, y):
    n = max(len(x), len(y))
    p, q = (np.pad(m / m.sum() if m.sum() else m, (0, n - len(m))) for m in (x, y))
    return np.linalg.norm(p - q)


def test_frobenius(literal):
    got = pairs_of(D.frobenius(*literal))
    names = sorted(MATRICES)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    for (a, b), d in got.items():
        assert d == pytest.approx(fro(MATRICES[a], MATRICES[b]), abs=1e-9)


def test_frobenius_options(spark):
    m = np.array([[3.0, 1], [0, 2]])
    cells, labels = tables(spark, {"x": m, "y": 2 * m, "z": np.eye(3)})
    assert pairs_of(D.frobenius(cells, labels))["x", "y"] == pytest.approx(0)
    assert pairs_of(D.frobenius(cells, labels, normalize=False))["x", "y"] == pytest.approx(np.linalg.norm(m))
    assert pairs_of(D.frobenius(cells, labels, align="label")) == pytest.approx(pairs_of(D.frobenius(cells, labels)))
    with pytest.raises(Exception, match="differ in size"):
        D.frobenius(cells, labels, align="none").collect()
    with pytest.raises(ValueError):
        D.frobenius(cells, labels, align="other")


def test_label_and_pattern_distances(spark):
    cells = spark.createDataFrame([("x", "a", "b", 5.0), ("x", "b", "a", 2.0), ("x", "a", "a", 9.0), ("y", "a", "b", 1.0), ("y", "c", "c", 1.0)], "script string, true_char string, pred_char string, n double")
    labels = spark.createDataFrame([("x", 0, "a"), ("x", 1, "b"), ("y", 0, "a"), ("y", 1, "b"), ("y", 2, "c"), ("e", 0, "q"), ("f", 0, "q")], "script string, idx int, ch string")
    o = pairs_of(D.character_overlap_distance(labels))
    assert o["x", "y"] == pytest.approx(1 / 3) and o["e", "f"] == 0 and o["e", "x"] == 1
    p = pairs_of(D.confusion_pattern_distance(cells, labels))
    assert p["x", "y"] == 0.5 and p["e", "f"] == 0 and p["e", "x"] == 1
    assert pairs_of(D.confusion_pattern_distance(cells, labels, 1))["x", "y"] == 0
    b = {(r["a"], r["b"]): r for r in D.baselines(cells, labels).collect()}
    assert b["x", "y"]["accuracy"] == pytest.approx(abs(9 / 16 - 0.5))


@pytest.fixture(scope="module")
def profiles(literal):
    few = tuple(t.where("script in ('simple', 'uniform', 'sparse', 'identity')") for t in literal)
    return P.extract_profiles(*few).cache(), *few


def test_spectral_distances(profiles):
    p, cells, labels = profiles
    got = pairs_of(D.distances(p, "spectral"))
    for (a, b), d in got.items():
        assert d == pytest.approx(dense_distance(MATRICES[a], MATRICES[b]), abs=1e-7)
    multi = pairs_of(D.distances(p, "multi_spectrum"))
    doubled = pairs_of(D.distances(p, "multi_spectrum", weights={"bistochastic": 0.8, "symmetric": 0.4, "laplacian": 0.8}))
    assert multi == pytest.approx(doubled)
    only = pairs_of(D.distances(p, "multi_spectrum", weights={"laplacian": 1.0, "symmetric": 0.0}))
    lap = pairs_of(D.distances(p, "spectral", spectrum_type="laplacian", include_scalar=False))
    assert only == pytest.approx(lap)
    custom = pairs_of(D.distances(p, "custom", custom=lambda a, b: F.abs(F.col(a + "accuracy") - F.col(b + "accuracy"))))
    assert custom == pytest.approx(pairs_of(D.accuracy_distance(cells)))
    methods = {r["method"] for r in D.all_distances(p, cells, labels).select("method").distinct().collect()}
    assert methods == {"accuracy", "spectral", "multi_spectrum", "frobenius"}
    for bad in ({"method": "nope"}, {"method": "custom"}, {"method": "spectral", "spectrum_type": "other"}):
        with pytest.raises(ValueError):
            D.distances(p, **bad)


def dist(spark, rows):
    return spark.createDataFrame([(a, b, float(d), "m") for a, b, d in rows], "a string, b string, d double, method string")


def test_square_ranking_and_lookup(spark):
    d = dist(spark, [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)])
    assert D.square(d).count() == 9
    ranks = {(r["a"], r["b"]): r["rank"] for r in D.rank_by_distance(d).collect()}
    assert ranks["b", "a"] == 1 and ranks["b", "c"] == 2 and ranks["a", "b"] == 1
    near = {r["a"]: r["nearest"] for r in D.nearest(d).collect()}
    assert near == {"a": "b", "b": "a", "c": "b"}
    assert D.get_distance(d, "c", "a").first()["d"] == 2
    with pytest.raises(Exception, match="unknown script"):
        D.get_distance(d, "c", "z").collect()
    row = {r["a"]: r for r in D.square_pivot(d).collect()}
    assert row["a"]["c"] == 2 and row["c"]["c"] == 0
    assert any("b=1.0000" in r["line"] for r in D.summary_lines(d).collect())


@pytest.mark.parametrize(("rows", "broken"), [
    ([("a", "b", 1), ("b", "a", 1), ("a", "a", 0), ("b", "b", 0)], set()),
    ([("a", "b", -1), ("b", "a", -1), ("a", "a", 0), ("b", "b", 0)], {"non_negativity", "triangle_inequality", "self_minimum"}),
    ([("a", "b", 1), ("b", "a", 1), ("a", "a", 0.5), ("b", "b", 0)], {"identity", "self_minimum"} - {"self_minimum"}),
    ([("a", "b", 1), ("b", "a", 2), ("a", "a", 0), ("b", "b", 0)], {"symmetry"}),
])
def test_axioms(spark, rows, broken):
    r = D.sanity(dist(spark, rows)).first()
    assert {x for x in D.AXIOMS if not r[x]} == broken
    assert r["all_passed"] == (not broken)


def test_triangle(spark):
    sq = D.square(dist(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 5)]))
    v = [r for r in D.violations(sq).collect() if r["axiom"] == "triangle_inequality"]
    assert {(r["a"], r["b"], r["c"]) for r in v} == {("a", "c", "b"), ("c", "a", "b")} and v[0]["amount"] == pytest.approx(3)
    assert not D.sanity(sq).first()["is_metric"]


def test_average_linkage(spark):
    d = dist(spark, [("a", "b", 1), ("a", "c", 4), ("a", "d", 5), ("b", "c", 6), ("b", "d", 7), ("c", "d", 2)])
    rows = [(r["left"], r["right"], r["height"], r["size"]) for r in D.average_linkage(d).orderBy("step").collect()]
    assert rows == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 5.5, 4)]
    assert D.average_linkage(d, "single").orderBy("step").collect()[-1]["height"] == 4
    assert D.average_linkage(d, "complete").orderBy("step").collect()[-1]["height"] == 7
    assert math.isfinite(rows[-1][2])
