"""Validation of inputs, matrices and distance tables; synthetic and historical ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import INF, ratio
from . import distance as D
from .counts import matrix_metrics
from .interpret import row_column_spread
from .profile import extract_profiles
from .resample import synthetic_cells, synthetic_similarities
from .stats import kendall, kendall_p, order_counts, spearman, spearman_p

SYNTHETIC_THRESHOLD, HISTORICAL_THRESHOLD = 0.7, 0.6

#: Known relations of writing systems, (a, b, relation, expected similarity).
RELATIONSHIPS = (
    ("latin", "italian", "derived", "high"),
    ("latin", "french", "derived", "high"),
    ("latin", "spanish", "derived", "high"),
    ("latin", "german", "derived", "high"),
    ("greek", "latin", "influenced", "medium"),
    ("greek", "cyrillic", "influenced", "medium"),
    ("cyrillic", "russian", "derived", "high"),
    ("cyrillic", "serbian", "derived", "high"),
    ("latin", "chinese", "unrelated", "low"),
    ("greek", "arabic", "unrelated", "low"),
    ("cyrillic", "hebrew", "unrelated", "low"),
)
_RELATIONSHIP = "a string, b string, relationship string, expected string"


# ----------------------------------------------------------------------------------------------- matrices


def matrix_facts(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each script with everything that the checks look at."""
    return matrix_metrics(cells, labels).join(row_column_spread(cells, labels), "script")


def validate_matrices(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, check_name, passed, error, warning): seven checks for each matrix; ``error`` makes the matrix
    fail whatever else, ``warning`` is for reading."""
    f = matrix_facts(cells, labels)
    acc, total, size = F.col("accuracy"), F.col("total_observations"), F.col("size")
    dead = (F.col("zero_rows") > 0) | (F.col("zero_cols") > 0)
    none = F.lit(None).cast("string")
    check = lambda name, passed, error=none, warning=none: F.struct(
        F.lit(name).alias("check_name"), passed.alias("passed"), error.alias("error"), warning.alias("warning"))
    checks = F.array(
        check("square", F.lit(True)),
        check("size", size.between(5, 500), none, F.when(size < 5, F.lit("very small")).when(size > 500, F.lit("very large"))),
        check("accuracy", acc > 0.5, F.when(acc < 0.3, F.lit("accuracy too low")),
              F.when((acc >= 0.3) & (acc < 0.5), F.lit("low accuracy")).when(acc > 0.99, F.lit("suspiciously high accuracy"))),
        check("sample_size", total >= 50, none, F.when(total < 50, F.lit("few observations"))),
        check("no_zero_rows_or_columns", ~dead, none, F.when(dead, F.lit("labels without counts"))),
        check("diagonal", acc > 0.3, none, F.when(acc < 0.3, F.lit("weak diagonal"))),
        check("consistency", (F.col("row_variance") < total) & (F.col("col_variance") < total), none,
              F.when(F.col("row_variance") > total, F.lit("row sums vary much"))),
    )
    return f.select("script", F.inline(checks))


def validation_summary(checks: DataFrame) -> DataFrame:
    """(script, n_passed, n_failed, errors, warnings, overall_passed)."""
    ok = F.sum(F.col("passed").cast("int"))
    return checks.groupBy("script").agg(
        ok.alias("n_passed"), (F.count("*") - ok).alias("n_failed"), F.count("error").alias("n_errors"), F.count("warning").alias("n_warnings"),
        (F.min("passed") & (F.count("error") == 0)).alias("overall_passed"))


def all_validated(summary: DataFrame) -> DataFrame:
    """One row: (n_matrices, n_passed, n_failed)."""
    ok = F.coalesce(F.sum(F.col("overall_passed").cast("int")), F.lit(0))
    return summary.agg(F.count("*").alias("n_matrices"), ok.alias("n_passed"), (F.count("*") - ok).alias("n_failed"))


def validate_inputs(images: DataFrame, truth: DataFrame, scripts: list[str]) -> DataFrame:
    """(script, n_images, n_labels, coverage, passed, message) of image names and labels of each script.

    Passes with images and labels; coverage below 0.8 is reported, and below 1 as well.
    """
    spark = images.sparkSession
    want = spark.createDataFrame([(s,) for s in scripts], "script string")
    n = lambda df, c: df.groupBy("script").agg(F.count("*").alias(c))
    rows = want.join(n(images, "n_images"), "script", "left").join(n(truth, "n_labels"), "script", "left").na.fill(0)
    cov = ratio(F.col("n_labels").cast("double"), F.col("n_images"))
    rows = rows.withColumn("coverage", cov).withColumn("passed", (F.col("n_images") > 0) & (F.col("n_labels") > 0))
    say = F.when(F.col("n_images") == 0, F.lit("no images")).when(F.col("n_labels") == 0, F.lit("no labels")).when(
        F.col("coverage") < 0.8, F.lit("low coverage")).when(F.col("coverage") < 1, F.lit("incomplete coverage"))
    return rows.withColumn("message", say)


def run_statistics(outcomes: DataFrame) -> DataFrame:
    """(script, processed, skipped, errors) of (script, text, error): no label means skipped."""
    skip, bad = F.col("text").isNull(), F.col("error").isNotNull()
    n = lambda c: F.sum(c.cast("int"))
    return outcomes.groupBy("script").agg(n(~skip & ~bad).alias("processed"), n(skip).alias("skipped"), n(~skip & bad).alias("errors"))


# ------------------------------------------------------------------------------------------ ground truth


def compare_with_truth(truth: DataFrame, computed: DataFrame, threshold: float = SYNTHETIC_THRESHOLD) -> DataFrame:
    """(family, n_pairs, spearman_rho, spearman_t, kendall_tau, rank_preservation, tied_pairs, mae, passed) of two tables
    (family, a, b, d) of the same pairs; distances are divided by their largest for the mean error."""
    t = truth.select("family", "a", "b", F.col("d").alias("x"))
    both = t.join(computed.select("family", "a", "b", F.col("d").alias("y")), ["family", "a", "b"])
    xy = both.select("family", F.concat_ws("\x1f", "a", "b").alias("id"), "x", "y")
    top = xy.groupBy("family").agg((F.max("x") + 1e-10).alias("mx"), (F.max("y") + 1e-10).alias("my"))
    mae = xy.join(top, "family").groupBy("family").agg(F.avg(F.abs(F.col("x") / F.col("mx") - F.col("y") / F.col("my"))).alias("mae"))
    s, k = spearman(xy), kendall(xy)
    out = s.select("family", F.col("n").alias("n_pairs"), F.col("rho").alias("spearman_rho"), F.col("t").alias("spearman_t"))
    out = out.join(k.select("family", F.col("tau").alias("kendall_tau"), "rank_preservation", F.col("tied").alias("tied_pairs")), "family").join(mae, "family")
    return out.withColumn("passed", F.coalesce(F.col("spearman_rho") >= threshold, F.lit(False)))


def synthetic_validation(spark: SparkSession, per_group: int = 5, n_chars: int = 26, method: str = "spectral", seed: int = 42, threshold: float = SYNTHETIC_THRESHOLD) -> DataFrame:
    """One row of compare_with_truth for generated matrices whose similarity is known."""
    from .counts import label_table

    cells = synthetic_cells(spark, per_group, n_chars, seed=seed)
    labels = label_table(cells)
    if method == "frobenius":
        computed = D.frobenius(cells, labels)
    elif method == "accuracy":
        computed = D.accuracy_distance(cells)
    else:
        computed = D.distances(extract_profiles(cells, labels), method).select("a", "b", "d")
    family = F.lit(method).alias("family")
    return compare_with_truth(D.ground_truth(synthetic_similarities(cells)).select(family, "a", "b", "d"), computed.select(family, "a", "b", "d"), threshold)


#: Label counts of the four scripts in the comparison of methods.
SCRIPT_SIZES = {"latin": 26, "greek": 24, "cyrillic": 33, "arabic": 28}


def method_comparison(spark: SparkSession, sizes: dict[str, int] | None = None, per_group: int = 5, seed: int = 42) -> DataFrame:
    """(script, method, rho, tau, passed, proposed_wins): for each label count the spectral methods against
    the baselines; the proposed one wins if its correlation exceeds both baselines'."""
    out = None
    for script, n in (sizes or SCRIPT_SIZES).items():
        for method in ("spectral", "multi_spectrum", "frobenius", "accuracy"):
            row = synthetic_validation(spark, per_group, n, method, seed).select(
                F.lit(script).alias("script"), F.lit(method).alias("method"), F.col("spearman_rho").alias("rho"), F.col("kendall_tau").alias("tau"), "passed")
            out = row if out is None else out.unionByName(row)
    best = out.groupBy("script").agg(
        F.max(F.when(F.col("method").isin("frobenius", "accuracy"), F.col("rho"))).alias("base"), F.max(F.when(F.col("method") == "spectral", F.col("rho"))).alias("own"))
    return out.join(best, "script").select("script", "method", "rho", "tau", "passed", (F.col("own") > F.col("base")).alias("proposed_wins"))


def similarity_rank(expected: Column) -> Column:
    return F.when(expected == "high", 3).when(expected == "medium", 2).when(expected == "low", 1).otherwise(0)


def relationships(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RELATIONSHIPS), _RELATIONSHIP)


def historical_details(dist: DataFrame, related: DataFrame) -> DataFrame:
    """Relations whose both scripts are in the distance table, with expected rank and distance."""
    sq = dist.select("a", "b", "d").unionByName(dist.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    names = sq.select("a").distinct()
    known = related.join(names, "a", "left_semi").join(names.select(F.col("a").alias("b")), "b", "left_semi")
    return known.join(sq, ["a", "b"]).select("a", "b", "relationship", "expected", similarity_rank(F.col("expected")).alias("expected_rank"), "d")


def historical_validation(dist: DataFrame, related: DataFrame, threshold: float = HISTORICAL_THRESHOLD) -> DataFrame:
    """One row (n_relationships, n_correct, n_ordered, ordering_accuracy, rho, passed): whether related
    scripts are nearer. Fewer than three relations have rho 0; none at all fails."""
    details = historical_details(dist, related)
    xy = details.select(F.lit("all").alias("family"), F.concat_ws("\x1f", "a", "b", "relationship").alias("id"), F.col("expected_rank").cast("double").alias("x"), (-F.col("d")).alias("y"))
    c = order_counts(xy).join(spearman(xy).select("family", "rho"), "family")
    one = dist.sparkSession.createDataFrame([("all",)], "family string").join(c, "family", "left")
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    acc = z("concordant") / F.greatest(z("ordered"), F.lit(1))
    return one.select(z("n").alias("n_relationships"), z("concordant").alias("n_correct"), z("ordered").alias("n_ordered"), acc.alias("ordering_accuracy"),
                      F.when(z("n") >= 3, F.col("rho")).otherwise(F.lit(0.0)).alias("rho"), ((z("n") > 0) & (acc >= threshold)).alias("passed"))


def family_separation(dist: DataFrame, families: DataFrame) -> DataFrame:
    """One row (within_mean, between_mean, separation, n_within, n_between) of (script, family);
    separation = within / between, infinite if between is 0."""
    f = lambda p: families.select(F.col("script").alias(p), F.col("family").alias("f" + p))
    j = dist.join(f("a"), "a").join(f("b"), "b")
    same = F.col("fa") == F.col("fb")
    g = j.agg(F.coalesce(F.avg(F.when(same, F.col("d"))), F.lit(0.0)).alias("within_mean"), F.coalesce(F.avg(F.when(~same, F.col("d"))), F.lit(0.0)).alias("between_mean"),
              F.count(F.when(same, 1)).alias("n_within"), F.count(F.when(~same, 1)).alias("n_between"))
    return g.select("within_mean", "between_mean", ratio(F.col("within_mean"), F.col("between_mean"), INF).alias("separation"), "n_within", "n_between")


def p_values(row) -> dict[str, float | None]:
    """p of one collected row of compare_with_truth."""
    return {"spearman_p": spearman_p(row["spearman_rho"], row["n_pairs"]), "kendall_p": kendall_p(row["kendall_tau"], row["n_pairs"], row["tied_pairs"])}

