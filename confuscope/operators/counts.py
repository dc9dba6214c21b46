"""Counting label pairs into matrices, and what is read off the counts. All plans are native.

One shuffle on the cell key counts the pairs (with partial sums before it); everything after works
on the counted cells, whose number is bounded by the square of the label lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..model import KEYS



def count_pairs(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """cells of (script, true_char, pred_char) rows; ``weight`` names a column of repetitions."""
    n = F.count("*") if weight is None else F.sum(weight)
    return pairs.groupBy(*KEYS).agg(n.cast("double").alias("n"))


def label_table(cells: DataFrame, charset: DataFrame | None = None) -> DataFrame:
    """labels: all labels seen as truth or prediction, and those of ``charset`` (script, ch), in code
    point order; empty strings are no labels. A script's label list is an alphabet, so the window is small."""
    seen = cells.select("script", F.explode(F.array("true_char", "pred_char")).alias("ch"))
    if charset is not None:
        seen = seen.unionByName(charset.select("script", "ch"))
    distinct = seen.where("ch is not null and ch <> ''").distinct()
    idx = F.row_number().over(W.partitionBy("script").orderBy("ch")) - 1
    return distinct.select("script", idx.cast("int").alias("idx"), "ch")


def label_totals(cells: DataFrame) -> DataFrame:
    """(script, ch, row_sum, col_sum) of labels with a cell, by one aggregation of both roles."""
    both = cells.select("script", F.inline(F.array(
        F.struct(F.col("true_char").alias("ch"), F.col("n").alias("r"), F.lit(0.0).alias("c")),
        F.struct(F.col("pred_char").alias("ch"), F.lit(0.0).alias("r"), F.col("n").alias("c")))))
    return both.groupBy("script", "ch").agg(F.sum("r").alias("row_sum"), F.sum("c").alias("col_sum"))


def all_label_totals(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """label_totals for every label, zero where it has no cell."""
    joined = labels.join(label_totals(cells), ["script", "ch"], "left")
    return joined.select("script", "idx", "ch", F.coalesce("row_sum", F.lit(0.0)).alias("row_sum"), F.coalesce("col_sum", F.lit(0.0)).alias("col_sum"))


def prune_unused(cells: DataFrame, labels: DataFrame, min_total: float = 1) -> tuple[DataFrame, DataFrame]:
    """(cells, labels) without labels whose row and column sum to less than ``min_total``; one pass."""
    if min_total < 1:
        raise ValueError("min_total must be at least 1")
    keep = label_totals(cells).where(F.col("row_sum") + F.col("col_sum") >= min_total).select("script", "ch")
    kept = labels.join(keep, ["script", "ch"], "left_semi")
    idx = F.row_number().over(W.partitionBy("script").orderBy("idx")) - 1
    side = lambda c: keep.select("script", F.col("ch").alias(c))
    left = cells.join(side("true_char"), ["script", "true_char"], "left_semi").join(side("pred_char"), ["script", "pred_char"], "left_semi")
    return left.select(*KEYS, "n"), kept.select("script", idx.cast("int").alias("idx"), "ch")


def prune_report(cells: DataFrame, labels: DataFrame, min_total: float = 1) -> DataFrame:
    """(script, original_size, pruned_size, removed) as a matrix's metadata records it."""
    t = all_label_totals(cells, labels).groupBy("script")
    kept = F.sum(F.when(F.col("row_sum") + F.col("col_sum") >= min_total, 1).otherwise(0))
    return t.agg(F.count("*").alias("original_size"), kept.alias("pruned_size"), (F.count("*") - kept).alias("removed"))


def build_matrices(pairs: DataFrame, charset: DataFrame | None = None, scripts: list[str] | None = None, min_total: float = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs to pruned (cells, labels), all scripts at once; pairs of other than ``scripts`` are refused."""
    if scripts is not None:
        known = F.col("script").isin(scripts)
        pairs = pairs.withColumn("script", F.when(known, F.col("script")).otherwise(F.raise_error(F.concat(F.lit("unknown script: "), "script"))))
    cells = count_pairs(pairs.where("true_char <> '' and pred_char <> ''"))
    return prune_unused(cells, label_table(cells, charset), min_total)


def diagonal(n: Column | str = "n") -> Column:
    """Sum of the cells on the diagonal."""
    return F.coalesce(F.sum(F.when(F.col("true_char") == F.col("pred_char"), F.col(n) if isinstance(n, str) else n)), F.lit(0.0))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("script").agg(F.count("*").cast("int").alias("size"))


def matrix_metrics(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, size, total_observations, accuracy, error_rate, sparsity)."""
    sums = cells.groupBy("script").agg(F.sum("n").alias("t"), diagonal().alias("d"), F.sum(F.when(F.col("n") != 0, 1).otherwise(0)).alias("nnz"))
    t, d = F.coalesce("t", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    acc = ratio(d, t)
    square = F.col("size").cast("double") * F.col("size")
    return sizes(labels).join(sums, "script", "left").select(
        "script", "size", t.cast("long").alias("total_observations"), acc.alias("accuracy"), (1 - acc).alias("error_rate"),
        (1 - ratio(F.coalesce("nnz", F.lit(0)).cast("double"), square)).alias("sparsity"))


def builder_statistics(pairs: DataFrame) -> DataFrame:
    """(script, total_samples, unique_pairs, total_characters, accuracy) of pairs as they come in."""
    c = count_pairs(pairs)
    acc = ratio(diagonal(), F.sum("n"))
    return c.groupBy("script").agg(F.sum("n").cast("long").alias("total_samples"), F.count("*").alias("unique_pairs"),
                                   F.countDistinct("true_char").alias("total_characters"), acc.alias("accuracy"))


def label_accuracy(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, ch, accuracy): share of a label's row on the diagonal; 0 for an empty row."""
    rows = cells.groupBy("script", F.col("true_char").alias("ch")).agg(F.sum("n").alias("r"), diagonal().alias("d"))
    return labels.join(rows, ["script", "ch"], "left").select("script", "ch", ratio(F.coalesce("d", F.lit(0.0)), F.coalesce("r", F.lit(0.0))).alias("accuracy"))


def off_diagonal(cells: DataFrame) -> DataFrame:
    return cells.where("true_char <> pred_char and n > 0")


def top_confusions(cells: DataFrame, k: int = 10) -> DataFrame:
    """The k largest cells off the diagonal: (script, rank, true_char, pred_char, n). Ties go by true, then
    predicted label. The rank limit is pushed into the window, so a task keeps k rows a script."""
    w = W.partitionBy("script").orderBy(F.desc("n"), "true_char", "pred_char")
    return off_diagonal(cells).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("script", "rank", *KEYS[1:], "n")


def check_matrices(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Constructor checks: rows (script, problem) for negative or null counts, labels that are missing or
    listed twice. Empty if all is well."""
    bad = cells.where("n < 0 or n is null or isnan(n)").select("script", F.lit("negative or missing count").alias("problem"))
    seen = cells.select("script", F.explode(F.array("true_char", "pred_char")).alias("ch")).distinct()
    missing = seen.join(labels, ["script", "ch"], "left_anti").select("script", F.lit("label is not listed").alias("problem"))
    twice = labels.groupBy("script", "ch").count().where("count > 1").select("script", F.lit("label is listed twice").alias("problem"))
    return bad.unionByName(missing).unionByName(twice).distinct()
