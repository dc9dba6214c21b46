"""Matrix operators on the long cell table, and dense algebra in one grouped map for each script.

What is a sum by key stays native. Sinkhorn's iteration and eigenvalues need the dense matrix; it is as
large as a label list squared (some hundreds), one script to a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import SPECTRUM_KEPT
from ..model import KEYS, SPECTRAL
from .counts import all_label_totals, sizes

ITERATIONS, TOLERANCE, REGULARIZATION = 1000, 1e-10, 1e-10
ZERO_ROWS = ("uniform", "identity", "zero")


def row_normalize(cells: DataFrame, labels: DataFrame, handle_zero_rows: str = "uniform") -> DataFrame:
    """cells divided by their row's sum; rows without counts become uniform, identity or stay zero."""
    if handle_zero_rows not in ZERO_ROWS:
        raise ValueError(f"handle_zero_rows must be one of {ZERO_ROWS}")
    sums = F.sum("n").over(W.partitionBy("script", "true_char"))
    out = cells.where("n > 0").select(*KEYS, (F.col("n") / sums).alias("n"))
    if handle_zero_rows == "zero":
        return out
    empty = all_label_totals(cells, labels).where("row_sum = 0").select("script", F.col("ch").alias("true_char"))
    if handle_zero_rows == "identity":
        return out.unionByName(empty.select("script", "true_char", F.col("true_char").alias("pred_char"), F.lit(1.0).alias("n")))
    wide = empty.join(labels.select("script", F.col("ch").alias("pred_char")), "script").join(sizes(labels), "script")
    return out.unionByName(wide.select(*KEYS, (1.0 / F.col("size")).alias("n")))


def symmetrize(cells: DataFrame) -> DataFrame:
    """(A + A') / 2 by summing each cell with its mirror."""
    half = cells.select("script", F.inline(F.array(
        F.struct(F.col("true_char"), F.col("pred_char"), (F.col("n") / 2).alias("n")),
        F.struct(F.col("pred_char").alias("true_char"), F.col("true_char").alias("pred_char"), (F.col("n") / 2).alias("n")))))
    return half.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def laplacian(cells: DataFrame, labels: DataFrame, normalized: bool = True) -> DataFrame:
    """Cells of D - W, or of I - D^-1/2 W D^-1/2 with 0 for a degree of zero, for the symmetrised W."""
    w = symmetrize(cells)
    degree = w.groupBy("script", F.col("true_char").alias("ch")).agg(F.sum("n").alias("deg"))
    own = labels.join(degree, ["script", "ch"], "left").select("script", F.col("ch").alias("true_char"), F.col("ch").alias("pred_char"),
                                                                (F.lit(1.0) if normalized else F.coalesce("deg", F.lit(0.0))).alias("n"))
    if normalized:
        d = lambda c, name: degree.where("deg > 0").select("script", F.col("ch").alias(c), F.col("deg").alias(name))
        w = w.join(d("true_char", "d1"), ["script", "true_char"]).join(d("pred_char", "d2"), ["script", "pred_char"])
        minus = w.select(*KEYS, (-F.col("n") / F.sqrt(F.col("d1") * F.col("d2"))).alias("n"))
    else:
        minus = w.select(*KEYS, (-F.col("n")).alias("n"))
    return own.unionByName(minus).groupBy(*KEYS).agg(F.sum("n").alias("n"))


# ----------------------------------------------------------------------------------------- dense algebra


def sinkhorn(m: np.ndarray, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, regularization: float = REGULARIZATION):
    """(doubly stochastic matrix, iterations, converged, row error, column error). Rows, then columns, are
    divided by their sums until both errors are below the tolerance; else the last iterate stands."""
    if (m < 0).any():
        raise ValueError("negative counts")
    b = m + regularization
    row_error = col_error = np.inf
    for k in range(1, iterations + 1):
        b = b / b.sum(axis=1, keepdims=True)
        b = b / b.sum(axis=0, keepdims=True)
        row_error, col_error = float(np.abs(b.sum(axis=1) - 1).max()), float(np.abs(b.sum(axis=0) - 1).max())
        if row_error < tolerance and col_error < tolerance:
            return b, k, True, row_error, col_error
    return b, iterations, False, row_error, col_error


def dense_laplacian(m: np.ndarray, normalized: bool = True) -> np.ndarray:
    w = (m + m.T) / 2
    d = w.sum(axis=1)
    if not normalized:
        return np.diag(d) - w
    inv = np.zeros_like(d)
    inv[d > 0] = d[d > 0] ** -0.5
    return np.eye(len(m)) - inv[:, None] * w * inv[None, :]


def _is_symmetric(m: np.ndarray, source_type: str) -> bool:
    return source_type in ("laplacian", "symmetric") or np.allclose(m, m.T, atol=1e-10)


def eigenvalues(m: np.ndarray, source_type: str = "general") -> np.ndarray:
    """Eigenvalues by descending magnitude; symmetric matrices get the symmetric solver."""
    lam = np.linalg.eigvalsh(m).astype(complex) if _is_symmetric(m, source_type) else np.linalg.eigvals(m)
    return lam[np.argsort(-np.abs(lam), kind="stable")]


def eigenpairs(m: np.ndarray, source_type: str = "general") -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues as above, and unit eigenvectors as columns in their order."""
    lam, vectors = np.linalg.eigh(m) if _is_symmetric(m, source_type) else np.linalg.eig(m)
    order = np.argsort(-np.abs(lam), kind="stable")
    return lam[order].astype(complex), vectors[:, order].astype(complex)


def verify(lam: np.ndarray, source_type: str) -> None:
    """Known properties of the spectrum; a violation raises."""
    mag = np.abs(lam)
    if source_type in ("stochastic", "bistochastic") and not np.isclose(mag[0], 1, atol=1e-6):
        raise ValueError("the leading eigenvalue is not 1")
    if source_type == "stochastic" and (mag > 1 + 1e-6).any():
        raise ValueError("an eigenvalue exceeds 1")
    if source_type == "laplacian" and (not np.isclose(lam.real.min(), 0, atol=1e-6) or (lam.real < -1e-6).any()):
        raise ValueError("not the spectrum of a Laplacian")


def spectral_row(m: np.ndarray, kept: int = SPECTRUM_KEPT) -> dict:
    """Spectra and gaps of one count matrix."""
    n = len(m)
    b, k, ok, row_error, col_error = sinkhorn(m)
    lam = eigenvalues(b, "bistochastic")
    verify(lam, "bistochastic")
    lam, sym = np.abs(lam), np.abs(eigenvalues((b + b.T) / 2, "symmetric"))
    lap = eigenvalues(dense_laplacian(m), "laplacian")
    if m.any():  # without counts all labels are isolated, and every eigenvalue is 1
        verify(lap, "laplacian")
    gap = lambda x: float(1 - x[1]) if n > 1 else 0.0
    return {
        "matrix_size": n, "bistochastic_spectrum": lam[:kept], "symmetric_spectrum": sym[:kept], "laplacian_spectrum": np.abs(lap)[:kept],
        "bistochastic_gap": gap(lam), "symmetric_gap": gap(sym), "fiedler_value": float(np.sort(lap.real)[1]) if n > 1 else 0.0,
        "iterations": k, "converged": ok, "row_error": row_error, "col_error": col_error,
    }


def dense_input(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, size, i, j, n): cells by label index, with one row at least for each script."""
    at = lambda c, name: labels.select("script", F.col("ch").alias(c), F.col("idx").alias(name))
    indexed = cells.join(at("true_char", "i"), ["script", "true_char"]).join(at("pred_char", "j"), ["script", "pred_char"])
    return sizes(labels).join(indexed.select("script", "i", "j", "n"), "script", "left")


def dense(pdf: pd.DataFrame) -> np.ndarray:
    n = int(pdf["size"].iloc[0])
    m = np.zeros((n, n))
    p = pdf.dropna(subset=["i"])
    np.add.at(m, (p["i"].astype(int).to_numpy(), p["j"].astype(int).to_numpy()), p["n"].to_numpy())
    return m


def per_script(cells: DataFrame, labels: DataFrame, f: Callable[[str, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``f(script, dense matrix)`` for each script, one task each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf["script"].iloc[0], dense(pdf))

    return dense_input(cells, labels).groupBy("script").applyInPandas(run, schema)


def spectral_features(cells: DataFrame, labels: DataFrame, kept: int = SPECTRUM_KEPT) -> DataFrame:
    """One row for each script: three spectra, gap, Fiedler value, and how Sinkhorn ended."""
    return per_script(cells, labels, lambda s, m: pd.DataFrame([{"script": s} | spectral_row(m, kept)]), SPECTRAL)


def bistochastic_cells(cells: DataFrame, labels: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(script, i, j, n) of the doubly stochastic matrix, all cells, by label index."""

    def f(script: str, m: np.ndarray) -> pd.DataFrame:
        b = sinkhorn(m, iterations)[0]
        i, j = np.indices(b.shape)
        return pd.DataFrame({"script": script, "i": i.ravel(), "j": j.ravel(), "n": b.ravel()})

    return per_script(cells, labels, f, "script string, i int, j int, n double")


def _source(m: np.ndarray, source_type: str) -> np.ndarray:
    """The matrix that is analysed, of a count matrix."""
    if source_type == "stochastic":
        s = m.sum(axis=1, keepdims=True)
        return np.where(s > 0, m / np.where(s > 0, s, 1), 1 / len(m))
    if source_type == "bistochastic":
        return sinkhorn(m)[0]
    if source_type == "symmetric":
        return (m + m.T) / 2
    return dense_laplacian(m) if source_type == "laplacian" else m


def eigen_table(cells: DataFrame, labels: DataFrame, source_type: str = "bistochastic", check: bool = True, vectors: bool = False) -> DataFrame:
    """(script, k, re, im, magnitude) of all eigenvalues by descending magnitude, of the matrix that
    ``source_type`` names: general, stochastic, bistochastic, symmetric or laplacian. ``vectors``: with the unit
    eigenvectors as arrays vector_re and vector_im by label index."""

    def f(script: str, m: np.ndarray) -> pd.DataFrame:
        m = _source(m, source_type)
        lam, v = eigenpairs(m, source_type) if vectors else (eigenvalues(m, source_type), None)
        if check:
            verify(lam, source_type)
        out = {"script": script, "k": range(len(lam)), "re": lam.real, "im": lam.imag, "magnitude": np.abs(lam)}
        if vectors:
            out |= {"vector_re": list(v.real.T), "vector_im": list(v.imag.T)}
        return pd.DataFrame(out)

    more = ", vector_re array<double>, vector_im array<double>" if vectors else ""
    return per_script(cells, labels, f, "script string, k int, re double, im double, magnitude double" + more)


def eigen_summary(eigen: DataFrame, laplacian: bool = False) -> DataFrame:
    """(script, is_real, spectral_gap, fiedler_value) of eigen_table: real if no imaginary part exceeds 1e-10; gap
    1 - second magnitude and Fiedler value (of a Laplacian, else null) second smallest real part, 0 below two values."""
    second = lambda xs: F.when(F.size(xs) > 1, F.element_at(xs, 2)).otherwise(F.lit(0.0))
    g = eigen.groupBy("script").agg(
        (F.max(F.abs("im")) <= 1e-10).alias("is_real"), F.sort_array(F.collect_list("magnitude"), asc=False).alias("mags"), F.sort_array(F.collect_list("re")).alias("res"))
    gap = F.when(F.size("mags") > 1, 1 - F.element_at("mags", 2)).otherwise(F.lit(0.0))
    fiedler = second(F.col("res")) if laplacian else F.lit(None).cast("double")
    return g.select("script", "is_real", gap.alias("spectral_gap"), fiedler.alias("fiedler_value"))


def top_eigenvalues(eigen: DataFrame, k: int) -> DataFrame:
    return eigen.where(F.col("k") < k)
