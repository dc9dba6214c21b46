"""Interpretable measures of a matrix: concentration, entropy, symmetry, dominance. All native.

Zero cells are never made: they enter through their number, which follows from the size of the label list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import INF, ratio
from ..model import KEYS
from .counts import all_label_totals, diagonal, off_diagonal, sizes

TOP = 10


def gini(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, gini) over all off-diagonal cells, zeros included; 0 if there are none or all are zero.

    With z zero cells ahead of the sorted non-zero ones, the cell ranked r among these has rank z + r.
    """
    off = off_diagonal(cells)
    ranked = off.withColumn("r", F.row_number().over(W.partitionBy("script").orderBy("n", *KEYS[1:])))
    sums = ranked.groupBy("script").agg(F.sum("n").alias("s"), F.sum(F.col("r") * F.col("n")).alias("rs"), F.count("*").alias("nnz"))
    size = F.col("size").cast("double")
    cells_n = size * (size - 1)
    weighted = F.col("rs") + (cells_n - F.col("nnz")) * F.col("s")
    g = 2 * weighted / (cells_n * F.col("s")) - (cells_n + 1) / cells_n
    return sizes(labels).join(sums, "script", "left").select(
        "script", F.when((F.col("size") > 1) & (F.col("s") > 0), g).otherwise(F.lit(0.0)).alias("gini"))


def top_error_share(cells: DataFrame, labels: DataFrame, k: int = TOP) -> DataFrame:
    """(script, top_share): share of the k largest confusions in all errors; 0 without errors."""
    w = W.partitionBy("script").orderBy(F.desc("n"), *KEYS[1:])
    ranked = off_diagonal(cells).withColumn("r", F.row_number().over(w))
    shares = ranked.groupBy("script").agg((F.sum(F.when(F.col("r") <= k, F.col("n"))) / F.sum("n")).alias("x"))
    return sizes(labels).join(shares, "script", "left").select("script", F.coalesce("x", F.lit(0.0)).alias("top_share"))


def case_confusion_rate(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, case_rate): errors between the two halves of the label list, by index, over max(errors, 1)."""
    half = labels.join(sizes(labels), "script").select("script", "ch", (F.col("idx") < F.floor(F.col("size") / 2)).alias("low"))
    side = lambda c, name: half.select("script", F.col("ch").alias(c), F.col("low").alias(name))
    joined = off_diagonal(cells).join(side("true_char", "tl"), ["script", "true_char"]).join(side("pred_char", "pl"), ["script", "pred_char"])
    sums = joined.groupBy("script").agg(F.sum("n").alias("e"), F.sum(F.when(F.col("tl") != F.col("pl"), F.col("n")).otherwise(0.0)).alias("x"))
    rate = F.coalesce(F.col("x") / F.greatest(F.col("e"), F.lit(1.0)), F.lit(0.0))
    return sizes(labels).join(sums, "script", "left").select("script", F.when(F.col("size") < 2, 0.0).otherwise(rate).alias("case_rate"))


def diagonal_dominance(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, dominance): correct over wrong counts; infinite without errors, 0 without counts."""
    sums = cells.groupBy("script").agg(diagonal().alias("d"), F.sum("n").alias("t"))
    d, e = F.coalesce("d", F.lit(0.0)), F.coalesce(F.col("t") - F.col("d"), F.lit(0.0))
    value = F.when(e > 0, d / e).when(d > 0, F.lit(INF)).otherwise(F.lit(0.0))
    return sizes(labels).join(sums, "script", "left").select("script", value.alias("dominance"))


def symmetry_score(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, symmetry): 1 - |A - A'| / (2 |A|) in Frobenius norm; 1 for a zero matrix.

    A - A' is the sum by cell of the counts and the negated mirrored counts: one aggregation, no join.
    """
    signed = cells.select("script", "n", F.inline(F.array(
        F.struct(F.col("true_char").alias("i"), F.col("pred_char").alias("j"), F.col("n").alias("x"), (F.col("n") * F.col("n")).alias("q")),
        F.struct(F.col("pred_char").alias("i"), F.col("true_char").alias("j"), (-F.col("n")).alias("x"), F.lit(0.0).alias("q")))))
    diff = signed.groupBy("script", "i", "j").agg(F.sum("x").alias("x"), F.sum("q").alias("q"))
    sums = diff.groupBy("script").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("a"), F.sqrt(F.sum("q")).alias("b"))
    value = F.when(F.col("b") > 0, 1 - F.col("a") / (2 * F.col("b"))).otherwise(F.lit(1.0))
    return sizes(labels).join(sums, "script", "left").select("script", F.coalesce(value, F.lit(1.0)).alias("symmetry"))


def row_entropies(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, ch, entropy): Shannon entropy, in nats, of each label's row; 0 for an empty row.

    By sums alone: ln(s) - sum(n ln n) / s for a row of sum s.
    """
    rows = cells.where("n > 0").groupBy("script", F.col("true_char").alias("ch")).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.log("n")).alias("nl"))
    h = F.log("s") - F.col("nl") / F.col("s")
    return labels.join(rows, ["script", "ch"], "left").select("script", "ch", F.coalesce(F.greatest(h, F.lit(0.0)), F.lit(0.0)).alias("entropy"))


def mean_row_entropy(cells: DataFrame, labels: DataFrame) -> DataFrame:
    return row_entropies(cells, labels).groupBy("script").agg(F.avg("entropy").alias("mean_entropy"))


def interpretable_features(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each script with all nine measures.

    What is a sum over single cells comes from one aggregation, for which each confusion is ranked in its
    script once; symmetry and entropy need the mirrored cells and the rows, an aggregation each.
    """
    size = sizes(labels)
    half = labels.join(size, "script").select("script", "ch", (F.col("idx") < F.floor(F.col("size") / 2)).alias("low"))
    side = lambda c, name: half.select("script", F.col("ch").alias(c), F.col("low").alias(name))
    wrong = (F.col("true_char") != F.col("pred_char")) & (F.col("n") > 0)
    rank = F.row_number().over(W.partitionBy("script", wrong).orderBy(F.desc("n"), *KEYS[1:]))
    rows = cells.withColumn("wrong", wrong).withColumn("rank", rank)
    rows = rows.join(side("true_char", "tl"), ["script", "true_char"]).join(side("pred_char", "pl"), ["script", "pred_char"])
    on = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    w, n = F.col("wrong"), F.col("n")
    sums = rows.groupBy("script").agg(
        F.sum("n").alias("t"), diagonal().alias("d"), F.sum((n != 0).cast("int")).alias("nnz"), F.sum(w.cast("int")).alias("k"),
        on(w, n).alias("e"), on(w, F.col("rank") * n).alias("rs"), on(w & (F.col("rank") <= TOP), n).alias("top"), on(w & (F.col("tl") != F.col("pl")), n).alias("cross"))
    j = size.join(sums, "script", "left").na.fill(0)
    s, t, d, e = F.col("size").cast("double"), F.col("t"), F.col("d"), F.col("e")
    off = s * (s - 1)
    # The r-th largest of ``off`` cells has rank off + 1 - r from below.
    weighted = (off + 1) * e - F.col("rs")
    out = j.select(
        "script", ratio(d, t).alias("accuracy"), (1 - ratio(d, t)).alias("error_rate"), (1 - ratio(F.col("nnz").cast("double"), s * s)).alias("sparsity"),
        F.when((F.col("size") > 1) & (e > 0), 2 * weighted / (off * e) - (off + 1) / off).otherwise(F.lit(0.0)).alias("gini"),
        ratio(F.col("top"), e).alias("top_share"), F.when(F.col("size") < 2, F.lit(0.0)).otherwise(F.col("cross") / F.greatest(e, F.lit(1.0))).alias("case_rate"),
        F.when(e > 0, d / e).when(d > 0, F.lit(INF)).otherwise(F.lit(0.0)).alias("dominance"))
    return out.join(symmetry_score(cells, labels), "script").join(mean_row_entropy(cells, labels), "script")


#: Order of the feature vector; error_rate and case_rate are not part of it.
VECTOR = ("accuracy", "sparsity", "gini", "top_share", "dominance", "symmetry", "mean_entropy")


def row_column_spread(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, row_variance, col_variance, zero_rows, zero_cols): population variances over all labels."""
    t = all_label_totals(cells, labels)
    return t.groupBy("script").agg(
        F.var_pop("row_sum").alias("row_variance"), F.var_pop("col_sum").alias("col_variance"),
        F.sum((F.col("row_sum") == 0).cast("int")).alias("zero_rows"), F.sum((F.col("col_sum") == 0).cast("int")).alias("zero_cols"))


def accuracy_row(cells: DataFrame) -> DataFrame:
    """(script, accuracy) from cells alone."""
    return cells.groupBy("script").agg(ratio(diagonal(), F.sum("n")).alias("accuracy"))
