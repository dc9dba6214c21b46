"""Distances between matrices: on spectra, counts, labels and confusions.

Profiles are small rows, one for each matrix, so pairs i < j come from a join on the row's position;
everything after is an expression. Distances on cells are sums by key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from .counts import sizes, top_confusions
from .interpret import accuracy_row

SPECTRA = ("bistochastic", "symmetric", "laplacian")
#: Default shares of the spectra in the combined distance.
WEIGHTS = {"bistochastic": 0.4, "symmetric": 0.2, "laplacian": 0.4}
SCALAR_WEIGHT = 0.2
METHODS = ("spectral", "multi_spectrum", "frobenius", "custom")


def pairs(rows: DataFrame, key: str = "script") -> DataFrame:
    """Every unordered pair of rows once: columns prefixed a_ and b_, a before b by ``key``."""
    side = lambda p: rows.select(*[F.col(c).alias(p + c) for c in rows.columns])
    return side("a_").join(side("b_"), F.col(f"a_{key}") < F.col(f"b_{key}"))


def spectral_distance(a: str = "a_", b: str = "b_", spectrum_type: str = "bistochastic", truncate_to: int = A.SPECTRUM_COMPARED,
                      include_scalar: bool = True, scalar_weight: float = SCALAR_WEIGHT) -> Column:
    """Wasserstein distance of one spectrum, mixed with the scaled distance of the scalar features."""
    if spectrum_type not in SPECTRA:
        raise ValueError(f"spectrum_type must be one of {SPECTRA}")
    w = A.cumulative_wasserstein(F.col(f"{a}{spectrum_type}_spectrum"), F.col(f"{b}{spectrum_type}_spectrum"), truncate_to)
    if not include_scalar:
        return w
    return (1 - scalar_weight) * w + scalar_weight * A.scaled_norm(F.col(f"{a}spectral_vec"), F.col(f"{b}spectral_vec"))


def multi_spectrum_distance(a: str = "a_", b: str = "b_", weights: Mapping[str, float] | None = None, truncate_to: int = A.SPECTRUM_COMPARED) -> Column:
    """Weighted Wasserstein distances of several spectra; weights are scaled to sum to one, those that are
    missing or not positive leave their spectrum out."""
    weights = dict(WEIGHTS if weights is None else weights)
    total = sum(weights.values())
    if abs(total - 1) > 1e-8 + 1e-5:
        weights = {k: v / total for k, v in weights.items()}
    out = F.lit(0.0)
    for k in SPECTRA:
        if weights.get(k, 0) > 0:
            out = out + weights[k] * A.cumulative_wasserstein(F.col(f"{a}{k}_spectrum"), F.col(f"{b}{k}_spectrum"), truncate_to)
    return out


def frobenius(cells: DataFrame, labels: DataFrame, normalize: bool = True, align: str = "index") -> DataFrame:
    """(a, b, d) for every pair a < b: Frobenius norm of the difference of two matrices, each divided by its
    sum if ``normalize``, the smaller one padded with zeros.

    ``align``: cells correspond by "index" in the label lists, by "label", or "none", which refuses
    matrices of different size. |x|^2 + |y|^2 - 2 x.y needs one equi-join on the cell, whose size
    is the number of cells that two matrices share.
    """
    if align not in ("index", "label", "none"):
        raise ValueError("align must be index, label or none")
    total = F.sum("n").over(W.partitionBy("script"))
    at = lambda c, name: labels.select("script", F.col("ch").alias(c), F.col("idx").cast("string").alias(name))
    x = cells.withColumn("n", F.when(total > 0, F.col("n") / total).otherwise(F.col("n"))) if normalize else cells
    if align == "label":
        x = x.select("script", F.col("true_char").alias("i"), F.col("pred_char").alias("j"), "n")
    else:
        x = x.join(at("true_char", "i"), ["script", "true_char"]).join(at("pred_char", "j"), ["script", "pred_char"]).select("script", "i", "j", "n")
    own = sizes(labels).join(x.groupBy("script").agg(F.sum(F.col("n") * F.col("n")).alias("q")), "script", "left").na.fill(0.0, ["q"])
    dots = x.select(F.col("script").alias("a"), "i", "j", F.col("n").alias("x")).join(
        x.select(F.col("script").alias("b"), "i", "j", F.col("n").alias("y")), ["i", "j"]).where("a < b")
    dots = dots.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    both = pairs(own).select(F.col("a_script").alias("a"), F.col("b_script").alias("b"), "a_q", "b_q", "a_size", "b_size")
    d = F.sqrt(F.greatest(F.col("a_q") + F.col("b_q") - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0)))
    if align == "none":
        d = F.when(F.col("a_size") == F.col("b_size"), d).otherwise(F.raise_error(F.lit("matrices differ in size")).cast("double"))
    return both.join(dots, ["a", "b"], "left").select("a", "b", d.alias("d"))


def accuracy_distance(cells: DataFrame) -> DataFrame:
    p = pairs(accuracy_row(cells))
    return p.select(F.col("a_script").alias("a"), F.col("b_script").alias("b"), F.abs(F.col("a_accuracy") - F.col("b_accuracy")).alias("d"))


def character_overlap_distance(labels: DataFrame) -> DataFrame:
    """Jaccard distance of the label sets."""
    p = pairs(labels.groupBy("script").agg(F.collect_set("ch").alias("set")))
    return p.select(F.col("a_script").alias("a"), F.col("b_script").alias("b"), A.jaccard_distance(F.col("a_set"), F.col("b_set")).alias("d"))


def confusion_pattern_distance(cells: DataFrame, labels: DataFrame, top_k: int = 20) -> DataFrame:
    """Jaccard distance of the sets of the top_k largest confusions."""
    tops = top_confusions(cells, top_k).groupBy("script").agg(F.collect_set(F.struct("true_char", "pred_char")).alias("set"))
    empty = F.array().cast("array<struct<true_char:string,pred_char:string>>")
    p = pairs(sizes(labels).select("script").join(tops, "script", "left").select("script", F.coalesce("set", empty).alias("set")))
    return p.select(F.col("a_script").alias("a"), F.col("b_script").alias("b"), A.jaccard_distance(F.col("a_set"), F.col("b_set")).alias("d"))


def baselines(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, frobenius, accuracy, character_overlap, confusion_pattern) for every pair."""
    named = {"frobenius": frobenius(cells, labels), "accuracy": accuracy_distance(cells), "character_overlap": character_overlap_distance(labels),
             "confusion_pattern": confusion_pattern_distance(cells, labels)}
    out = None
    for k, d in named.items():
        d = d.withColumnRenamed("d", k)
        out = d if out is None else out.join(d, ["a", "b"], "left")
    return out


def distances(profiles: DataFrame, method: str = "spectral", cells: DataFrame | None = None, labels: DataFrame | None = None,
              custom: Callable[[str, str], Column] | None = None, **options) -> DataFrame:
    """(a, b, d, method) for every pair a < b. ``custom`` gets the prefixes of the two sides' columns
    and returns a column; it may call a pandas UDF. frobenius takes no options."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "custom" and custom is None:
        raise ValueError("custom needs a function")
    if method == "frobenius":
        return frobenius(cells, labels).withColumn("method", F.lit(method))
    value = {"spectral": spectral_distance, "multi_spectrum": multi_spectrum_distance, "custom": custom}[method]("a_", "b_", **options)
    return pairs(profiles).select(F.col("a_script").alias("a"), F.col("b_script").alias("b"), value.alias("d"), F.lit(method).alias("method"))


def all_distances(profiles: DataFrame, cells: DataFrame, labels: DataFrame) -> DataFrame:
    out = accuracy_distance(cells).withColumn("method", F.lit("accuracy"))
    for m in ("spectral", "multi_spectrum", "frobenius"):
        out = out.unionByName(distances(profiles, m, cells, labels))
    return out


def square(dist: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """Both directions and a zero diagonal, by method."""
    two = dist.select("method", F.inline(F.array(F.struct("a", "b", "d"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "d"))))
    names = two.select("method", "a").distinct()
    return two.unionByName(names.select("method", "a", F.col("a").alias("b"), F.lit(0.0).alias("d")))


def rank_by_distance(dist: DataFrame) -> DataFrame:
    """(method, a, b, d, rank) of the others by ascending distance, ties by name."""
    sq = square(dist).where("a <> b")
    return sq.withColumn("rank", F.row_number().over(W.partitionBy("method", "a").orderBy("d", "b")))


def nearest(dist: DataFrame) -> DataFrame:
    """(method, a, nearest, d)."""
    best = square(dist).where("a <> b").groupBy("method", "a").agg(F.min(F.struct("d", "b")).alias("m"))
    return best.select("method", "a", F.col("m.b").alias("nearest"), F.col("m.d").alias("d"))


def get_distance(dist: DataFrame, a: str, b: str) -> DataFrame:
    """(method, d) of one pair, in either order; an unknown name raises when it runs."""
    sq = square(dist)
    known = sq.groupBy("method").agg(F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("d"))).alias("d"))
    return known.select("method", F.coalesce("d", F.raise_error(F.lit(f"unknown script in {a}, {b}")).cast("double")).alias("d"))


def square_pivot(dist: DataFrame) -> DataFrame:
    """The square matrix as a table, a row and a column for each script."""
    return square(dist).groupBy("method", "a").pivot("b").agg(F.first("d"))


def violations(sq: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(method, axiom, a, b, c, amount) of a square table's breaches: negative, identity, asymmetric, triangle,
    self_minimum. The triangle check is two equi-joins."""
    at = lambda rows, axiom, c, amount: rows.select("method", F.lit(axiom).alias("axiom"), "a", "b", c.cast("string").alias("c"), amount.alias("amount"))
    none = F.lit(None)
    out = at(sq.where(F.col("d") < -tolerance), "non_negativity", none, F.col("d"))
    out = out.unionByName(at(sq.where((F.col("a") == F.col("b")) & (F.abs("d") > tolerance)), "identity", none, F.col("d")))
    back = sq.select("method", F.col("a").alias("b"), F.col("b").alias("a"), F.col("d").alias("e"))
    gap = F.abs(F.col("d") - F.col("e"))
    out = out.unionByName(at(sq.join(back, ["method", "a", "b"]).where((F.col("a") < F.col("b")) & (gap > tolerance + 1e-5 * F.abs("e"))), "symmetry", none, gap))
    ij = sq.select("method", "a", F.col("b").alias("c"), F.col("d").alias("ij"))
    jk = sq.select("method", F.col("a").alias("c"), "b", F.col("d").alias("jk"))
    over = F.col("d") - F.col("ij") - F.col("jk")
    tri = sq.join(ij, ["method", "a"]).join(jk, ["method", "b", "c"]).where(over > tolerance)
    out = out.unionByName(at(tri, "triangle_inequality", F.col("c"), over))
    low = F.min("d").over(W.partitionBy("method", "a"))
    own = sq.withColumn("low", low).where((F.col("a") == F.col("b")) & (F.col("d") > F.col("low") + tolerance))
    return out.unionByName(at(own, "self_minimum", none, F.col("d") - F.col("low")))


AXIOMS = ("non_negativity", "identity", "symmetry", "triangle_inequality", "self_minimum")


def sanity(sq: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """A row for each method: whether each axiom holds, is_metric and all_passed."""
    found = violations(sq, tolerance).groupBy("method").agg(*[F.max(F.when(F.col("axiom") == x, 1).otherwise(0)).alias(x) for x in AXIOMS])
    rows = sq.select("method").distinct().join(found, "method", "left")
    ok = {x: F.coalesce(F.col(x), F.lit(0)) == 0 for x in AXIOMS}
    metric = ok["non_negativity"] & ok["identity"] & ok["symmetry"] & ok["triangle_inequality"]
    return rows.select("method", *[c.alias(x) for x, c in ok.items()], metric.alias("is_metric"), (metric & ok["self_minimum"]).alias("all_passed"))


def average_linkage(dist: DataFrame, how: str = "average") -> DataFrame:
    """(method, step, left, right, height, size): agglomerative clustering of one small square table for
    each method. Clusters are numbered as leaves by name, then n, n + 1 ... ; ties take the lowest numbers.
    ``how``: average, single or complete."""
    if how not in ("average", "single", "complete"):
        raise ValueError("how must be average, single or complete")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {s: k for k, s in enumerate(names)}
        d = {(min(at[a], at[b]), max(at[a], at[b])): x for a, b, x in zip(pdf["a"], pdf["b"], pdf["d"], strict=True) if a != b}
        size, out = dict.fromkeys(range(len(names)), 1), []
        while len(size) > 1:
            (i, j), h = min(d.items(), key=lambda e: (e[1], e[0]))
            k = len(names) + len(out)
            out.append((pdf["method"].iloc[0], len(out), i, j, h, size[i] + size[j]))
            for o in size:
                if o not in (i, j):
                    x, y = d.pop((min(o, i), max(o, i))), d.pop((min(o, j), max(o, j)))
                    d[o, k] = min(x, y) if how == "single" else max(x, y) if how == "complete" else (size[i] * x + size[j] * y) / (size[i] + size[j])
            del d[i, j]
            size[k] = size.pop(i) + size.pop(j)
        return pd.DataFrame(out, columns=["method", "step", "left", "right", "height", "size"])

    return dist.groupBy("method").applyInPandas(run, "method string, step int, left int, right int, height double, size int")


def summary_lines(dist: DataFrame) -> DataFrame:
    """(method, a, line): the distances of each script as text, for reading."""
    cells = square(dist).groupBy("method", "a").agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("xs"))
    line = F.array_join(F.transform("xs", lambda x: F.format_string("%s=%.4f", x["b"], x["d"])), "  ")
    return cells.select("method", "a", F.concat(F.rpad("a", 16, " "), line).alias("line"))


def ground_truth(similarities: DataFrame) -> DataFrame:
    """(a, b, d): |similarity to the base - similarity to the base| of (script, similarity_to_base)."""
    p = pairs(similarities.select("script", "similarity_to_base"))
    return p.select(F.col("a_script").alias("a"), F.col("b_script").alias("b"), F.abs(F.col("a_similarity_to_base") - F.col("b_similarity_to_base")).alias("d"))


