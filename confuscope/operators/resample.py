"""Resampling: subsamples, bootstrap, permutation and synthetic matrices, in grouped maps.

Every draw is seeded by (seed, names, replicate), so results do not depend on the partitioning.
Replicates run in chunks: a task holds a pair's two small matrices and a range of replicates.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import SCALAR_RANGES, SPECTRUM_COMPARED
from ..functions.scalar import INF
from ..model import CELLS
from .matrix import dense, dense_input, spectral_row
from .stats import effect_size

PERMUTATIONS = ("rows", "full", "block")
#: Replicates in a task.
CHUNK = 50

DenseDistance = Callable[[np.ndarray, np.ndarray], float]


def rng_for(seed: int, *names: object) -> np.random.Generator:
    return np.random.default_rng([seed, *[zlib.crc32(str(n).encode()) for n in names]])


def subsample(m: np.ndarray, fraction: float, rng: np.random.Generator) -> np.ndarray:
    """Multinomial draw of a share of the counts; a matrix without counts stays."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    total = m.sum()
    if total == 0:
        return m
    return rng.multinomial(int(total * fraction), (m / total).ravel()).reshape(m.shape).astype(float)


def permute(m: np.ndarray, how: str, rng: np.random.Generator) -> np.ndarray:
    """rows: each row shuffled; full: all cells; block: within aligned 2 x 2 blocks, an odd edge stays."""
    if how not in PERMUTATIONS:
        raise ValueError(f"method must be one of {PERMUTATIONS}")
    if how == "rows":
        return rng.permuted(m, axis=1)
    if how == "full":
        return rng.permutation(m.ravel()).reshape(m.shape)
    out, n = m.copy(), len(m) // 2 * 2
    if n:
        blocks = out[:n, :n].reshape(n // 2, 2, n // 2, 2).swapaxes(1, 2).reshape(-1, 4)
        out[:n, :n] = rng.permuted(blocks, axis=1).reshape(n // 2, n // 2, 2, 2).swapaxes(1, 2).reshape(n, n)
    return out


def _entropy(x: np.ndarray) -> float:
    p = x * x
    s = p.sum()
    p = p[p > 0] / s if s > 0 else p[:0]
    return float(-(p * np.log(p)).sum())


def spectral_distance(a: np.ndarray, b: np.ndarray, truncate_to: int = SPECTRUM_COMPARED, scalar_weight: float = 0.2) -> float:
    """The default distance between two count matrices, as in ``distance.spectral_distance``."""
    fa, fb = spectral_row(a), spectral_row(b)

    def vector(f: dict) -> np.ndarray:
        h = _entropy(f["bistochastic_spectrum"])
        return np.array([f["bistochastic_gap"], h, np.exp(h), f["symmetric_gap"], f["fiedler_value"], _entropy(f["laplacian_spectrum"])])

    x, y = fa["bistochastic_spectrum"][:truncate_to], fb["bistochastic_spectrum"][:truncate_to]
    n = max(len(x), len(y))
    p, q = (np.pad(v / v.sum() if v.sum() > 0 else v, (0, n - len(v))) for v in (x, y))
    w = float(np.abs(np.cumsum(p - q)).sum() / n) if n else 0.0
    s = float(np.sqrt((((vector(fa) - vector(fb)) / np.array(SCALAR_RANGES)) ** 2).mean()))
    return (1 - scalar_weight) * w + scalar_weight * s


def _cells(script: str, chars: list[str], m: np.ndarray) -> pd.DataFrame:
    i, j = np.nonzero(m)
    c = np.array(chars, dtype=object)
    return pd.DataFrame({"script": script, "true_char": c[i], "pred_char": c[j], "n": m[i, j]})


def resampled_cells(cells: DataFrame, labels: DataFrame, how: str = "subsample", fraction: float = 1.0, replicates: int = 1, seed: int = 42) -> DataFrame:
    """cells of resampled matrices with a column rep: how is subsample or one of PERMUTATIONS; permuted
    matrices get the script's name with _permuted."""
    if how != "subsample" and how not in PERMUTATIONS:
        raise ValueError(f"unknown method {how!r}")
    chars = labels.groupBy("script").agg(F.array_sort(F.collect_list(F.struct("idx", "ch"))).alias("ls")).select("script", F.col("ls.ch").alias("chars"))
    rows = dense_input(cells, labels).join(chars, "script")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        script, m = pdf["script"].iloc[0], dense(pdf)
        out = []
        for rep in range(replicates):
            rng = rng_for(seed, how, script, rep)
            made = subsample(m, fraction, rng) if how == "subsample" else permute(m, how, rng)
            name = script if how == "subsample" else f"{script}_permuted"
            out.append(_cells(name, list(pdf["chars"].iloc[0]), made).assign(rep=rep))
        return pd.concat(out)

    return rows.groupBy("script").applyInPandas(run, CELLS + ", rep int")


def _pair_replicates(cells: DataFrame, labels: DataFrame, replicates: int, f: Callable, include_observed: bool, names: list[tuple[str, str]] | None = None) -> DataFrame:
    """(a, b, rep, d) from ``f(a, b, matrix, matrix, rep)`` for every pair a < b, chunked over tasks; rep -1
    holds the distance of the matrices as they are."""
    packed = dense_input(cells, labels).groupBy("script", "size").agg(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "j", "n"))).alias("cells"))
    side = lambda p: packed.select(*[F.col(c).alias(p + c) for c in packed.columns])
    pairs = side("a_").join(side("b_"), F.col("a_script") < F.col("b_script"))
    if names is not None:
        wanted = pairs.sparkSession.createDataFrame([tuple(sorted(x)) for x in names], "a_script string, b_script string")
        pairs = pairs.join(wanted, ["a_script", "b_script"], "left_semi")
    chunks = pairs.withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(CHUNK))))

    def matrix(size: int, cs) -> np.ndarray:
        m = np.zeros((size, size))
        for c in cs:
            m[c["i"], c["j"]] += c["n"]
        return m

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                ma, mb = matrix(r["a_size"], r["a_cells"]), matrix(r["b_size"], r["b_cells"])
                if include_observed and r["from"] == 0:
                    out.append((r["a_script"], r["b_script"], -1, f(r["a_script"], r["b_script"], ma, mb, None)))
                for rep in range(r["from"], min(replicates, r["from"] + CHUNK)):
                    out.append((r["a_script"], r["b_script"], rep, f(r["a_script"], r["b_script"], ma, mb, rep)))
            yield pd.DataFrame(out, columns=["a", "b", "rep", "d"])

    return chunks.repartition("a_script", "b_script", "from").mapInPandas(run, "a string, b string, rep int, d double")


def bootstrap_replicates(cells: DataFrame, labels: DataFrame, replicates: int = 500, seed: int = 42, distance: DenseDistance = spectral_distance, names=None) -> DataFrame:
    """(a, b, rep, d) with both matrices redrawn for each replicate; rep -1 is the observed distance."""

    def f(a, b, ma, mb, rep):
        if rep is None:
            return distance(ma, mb)
        return distance(subsample(ma, 1.0, rng_for(seed, "boot", a, b, rep, 0)), subsample(mb, 1.0, rng_for(seed, "boot", a, b, rep, 1)))

    return _pair_replicates(cells, labels, replicates, f, True, names)


def bootstrap_summary(reps: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(a, b, observed, mean, std, ci_lower, ci_upper, ci_width, relative_uncertainty); population deviation,
    interpolated percentiles."""
    tail = (1 - confidence) / 2
    boot = F.when(F.col("rep") >= 0, F.col("d"))
    g = reps.groupBy("a", "b").agg(
        F.max(F.when(F.col("rep") < 0, F.col("d"))).alias("observed"), F.avg(boot).alias("mean"), F.stddev_pop(boot).alias("std"),
        F.percentile(boot, [tail, 1 - tail]).alias("ci"))
    rows = g.select("a", "b", "observed", "mean", "std", F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper"))
    spread = F.when(F.col("observed") != 0, F.col("std") / F.col("observed")).when(F.col("std") == 0, F.lit(0.0)).otherwise(F.lit(INF))
    return rows.withColumn("ci_width", F.col("ci_upper") - F.col("ci_lower")).withColumn("relative_uncertainty", spread)


def significant_differences(summary: DataFrame, reference: tuple[str, str]) -> DataFrame:
    """(a, b) of the pairs whose interval does not overlap that of the reference pair."""
    ref = summary.where((F.col("a") == min(reference)) & (F.col("b") == max(reference))).select(F.col("ci_lower").alias("lo"), F.col("ci_upper").alias("hi"))
    return summary.join(F.broadcast(ref), (F.col("ci_lower") > F.col("hi")) | (F.col("ci_upper") < F.col("lo"))).select("a", "b")


def permutation_replicates(cells: DataFrame, labels: DataFrame, how: str = "rows", replicates: int = 500, seed: int = 42, distance: DenseDistance = spectral_distance, names=None) -> DataFrame:
    """(a, b, rep, d) under the null: both matrices permuted; rep -1 is the observed distance."""
    if how not in PERMUTATIONS:
        raise ValueError(f"method must be one of {PERMUTATIONS}")

    def f(a, b, ma, mb, rep):
        if rep is None:
            return distance(ma, mb)
        return distance(permute(ma, how, rng_for(seed, "perm", a, b, rep, 0)), permute(mb, how, rng_for(seed, "perm", a, b, rep, 1)))

    return _pair_replicates(cells, labels, replicates, f, True, names)


def permutation_summary(reps: DataFrame, alternative: str = "less", alpha: float = 0.05) -> DataFrame:
    """(a, b, observed, null_mean, null_std, p_value, significant, effect_size) by the share of the null at
    or beyond the observed distance; two-sided doubles the smaller share."""
    if alternative not in ("less", "greater", "two-sided"):
        raise ValueError("alternative must be less, greater or two-sided")
    obs = reps.where("rep < 0").select("a", "b", F.col("d").alias("observed"))
    null = reps.where("rep >= 0").join(obs, ["a", "b"])
    share = lambda c: F.avg(c.cast("double"))
    low, high = share(F.col("d") <= F.col("observed")), share(F.col("d") >= F.col("observed"))
    p = {"less": low, "greater": high, "two-sided": F.least(2 * F.least(low, high), F.lit(1.0))}[alternative]
    g = null.groupBy("a", "b").agg(F.max("observed").alias("observed"), F.avg("d").alias("null_mean"), F.stddev_pop("d").alias("null_std"), p.alias("p_value"))
    return g.withColumn("significant", F.col("p_value") < alpha).withColumn("effect_size", effect_size(F.col("observed"), F.col("null_mean"), F.col("null_std")))


def stability(cells: DataFrame, labels: DataFrame, trials: int = 10, perturbation: float = 0.1, limit: float = 0.5, seed: int = 42, distance: DenseDistance = spectral_distance) -> DataFrame:
    """(script, max_distance, stable): distance of each matrix to its own subsamples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        script, m = pdf["script"].iloc[0], dense(pdf)
        worst = max(distance(m, subsample(m, 1 - perturbation, rng_for(seed, "stab", script, k))) for k in range(trials))
        return pd.DataFrame([(script, worst, bool(worst <= limit))], columns=["script", "max_distance", "stable"])

    return dense_input(cells, labels).groupBy("script").applyInPandas(run, "script string, max_distance double, stable boolean")


# ---------------------------------------------------------------------------------------- synthetic data

LEVELS = {"A": 0.9, "B": 0.5, "C": 0.1}


def base_matrix(n: int, rng: np.random.Generator, accuracy: float = 0.85, sparsity: float = 0.7) -> np.ndarray:
    """1000 on the diagonal; confusions of 10 to 99 counts, likelier between near labels; the diagonal
    is raised until the accuracy is reached."""
    m = np.eye(n) * 1000.0
    k = int((1 - sparsity) * n * (n - 1))
    i = rng.integers(0, n, k)
    step = (rng.exponential(3, k).astype(int) + 1) * np.where(rng.random(k) < 0.5, -1, 1)
    j, count = (i + step) % n, rng.integers(10, 100, k)
    off = i != j
    np.add.at(m, (i[off], j[off]), count[off])
    right, total = np.trace(m), m.sum()
    if right / total < accuracy:
        m[np.diag_indices(n)] *= 1 + (accuracy * total - right) / (right * (1 - accuracy))
    return m


def perturbed(base: np.ndarray, similarity: float, rng: np.random.Generator) -> np.ndarray:
    """Blend of the base and symmetric noise that is strong on its diagonal, scaled to the base's total."""
    noise = rng.exponential(50, base.shape)
    noise = noise + noise.T
    noise[np.diag_indices(len(base))] *= 5
    mixed = np.maximum(similarity * base + (1 - similarity) * noise, 0)
    return mixed * (base.sum() / mixed.sum())


SYNTHETIC = CELLS + ", grp string, similarity_to_base double"


def synthetic_cells(spark: SparkSession, per_group: int = 5, n_chars: int = 26, levels: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """cells of ``per_group`` matrices for each level of similarity, each made in its own task from the seed."""
    levels = dict(LEVELS if levels is None else levels)
    plan = spark.createDataFrame([(g, k, float(s)) for g, s in levels.items() for k in range(per_group)], "grp string, k int, level double")
    chars = [chr(ord("a") + i) for i in range(n_chars)]

    def run(batches):
        base = base_matrix(n_chars, rng_for(seed, "base"))
        for pdf in batches:
            out = [pd.DataFrame(columns=["script", "true_char", "pred_char", "n", "grp", "similarity_to_base"])]
            for r in pdf.to_dict("records"):
                rng = rng_for(seed, "matrix", r["grp"], r["k"])
                s = float(np.clip(r["level"] + rng.uniform(-0.05, 0.05), 0.05, 0.95))
                out.append(_cells(f"synthetic_{r['grp']}_{r['k']}", chars, perturbed(base, s, rng)).assign(grp=r["grp"], similarity_to_base=s))
            yield pd.concat(out)

    return plan.repartition("grp", "k").mapInPandas(run, SYNTHETIC)


def synthetic_similarities(cells: DataFrame) -> DataFrame:
    return cells.groupBy("script").agg(F.first("grp").alias("grp"), F.first("similarity_to_base").alias("similarity_to_base"))


