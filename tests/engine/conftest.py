"""Literal matrices with values that can be worked out by hand."""

import numpy as np
import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIMPLE = np.array([[100, 5, 2, 1, 0], [3, 90, 4, 2, 1], [1, 3, 85, 8, 3], [2, 1, 6, 88, 3], [0, 1, 3, 2, 94]], dtype=float)
SPARSE = 100 * np.eye(20)
SPARSE[0, 1], SPARSE[1, 0], SPARSE[5, 6], SPARSE[10, 11] = 5, 3, 8, 4
MATRICES = {"simple": SIMPLE, "identity": 100 * np.eye(10), "uniform": np.full((10, 10), 10.0), "sparse": SPARSE, "zero": np.zeros((3, 3)), "one": np.array([[7.0]])}
DEAD = np.array([[4.0, 1, 0], [0, 0, 0], [2, 3, 0]])


def tables(spark, matrices):
    cells, labels = [], []
    for script, m in matrices.items():
        labels += [(script, k, LETTERS[k]) for k in range(len(m))]
        cells += [(script, LETTERS[i], LETTERS[j], float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    return (spark.createDataFrame(cells, "script string, true_char string, pred_char string, n double").cache(),
            spark.createDataFrame(labels, "script string, idx int, ch string").cache())


@pytest.fixture(scope="session")
def literal(spark):
    return tables(spark, MATRICES)


@pytest.fixture(scope="session")
def dead(spark):
    return tables(spark, {"dead": DEAD})


def by_script(df):
    return {r["script"]: r for r in df.collect()}


def dense_of(df, n, value="n"):
    m = np.zeros((n, n))
    for r in df.collect():
        m[LETTERS.index(r["true_char"]), LETTERS.index(r["pred_char"])] = r[value]
    return m
