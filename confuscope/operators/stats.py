"""Multiple testing, rank correlations and effect sizes as window plans.

Windows run over one family of tests or pairs (``family``); families are independent and parallel.
"""

from __future__ import annotations

from math import erfc, factorial, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import INF, average_rank, student_t_two_sided

CORRECTIONS = ("bonferroni", "holm", "fdr-bh", "fdr-by")


def correct_pvalues(tests: DataFrame, method: str = "fdr-bh", alpha: float = 0.05) -> DataFrame:
    """(family, test_id, p, p_adj, significant) of (family, test_id, p); significant strictly below alpha.

    Equal p values are ordered by test_id; their adjusted values are equal whatever the order.
    """
    if method not in CORRECTIONS:
        raise ValueError(f"method must be one of {CORRECTIONS}")
    family = W.partitionBy("family")
    up = family.orderBy("p", "test_id")
    n, rank = F.count("*").over(family), F.row_number().over(up)
    rows = tests.withColumn("n", n).withColumn("rank", rank)
    if method == "bonferroni":
        adj = F.col("p") * F.col("n")
    elif method == "holm":
        adj = F.max(F.col("p") * (F.col("n") - F.col("rank") + 1)).over(up.rowsBetween(W.unboundedPreceding, 0))
    else:
        harmonic = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, k: a + 1.0 / k)
        c = harmonic if method == "fdr-by" else F.lit(1.0)
        rows = rows.withColumn("step", F.col("p") * F.col("n") * c / F.col("rank"))
        adj = F.min("step").over(up.rowsBetween(0, W.unboundedFollowing))
    out = rows.withColumn("p_adj", F.least(adj, F.lit(1.0)))
    return out.select("family", "test_id", "p", "p_adj", (F.col("p_adj") < alpha).alias("significant"))


def correction_summary(corrected: DataFrame) -> DataFrame:
    """(family, n_tests, n_significant, proportion)."""
    k = F.sum(F.col("significant").cast("int"))
    return corrected.groupBy("family").agg(F.count("*").alias("n_tests"), k.alias("n_significant"), (k / F.count("*")).alias("proportion"))


def pairwise_alpha(n_scripts: int, method: str = "bonferroni", alpha: float = 0.05) -> float:
    """Level for each of the n (n - 1) / 2 comparisons; only bonferroni divides it."""
    if n_scripts < 2:
        raise ZeroDivisionError("no pair to compare")
    return alpha / (n_scripts * (n_scripts - 1) / 2) if method == "bonferroni" else alpha


def spearman(xy: DataFrame) -> DataFrame:
    """(family, n, rho, t) of (family, x, y) by average ranks; rho is null for constant input."""
    ranks = xy.select("family", average_rank(F.col("x"), ["family"], "x").alias("rx"), average_rank(F.col("y"), ["family"], "y").alias("ry"))
    g = ranks.groupBy("family").agg(
        F.count("*").alias("n"), F.covar_pop("rx", "ry").alias("c"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"))
    rho = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    t = F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))
    return g.select("family", "n", rho.alias("rho")).withColumn("t", t)


def order_counts(xy: DataFrame) -> DataFrame:
    """(family, n, concordant, discordant, ties_x, ties_y, ties_both, ordered) over all pairs of rows of
    (family, id, x, y); families are pairs of few matrices, so all pairs are few too."""
    side = lambda p: xy.select("family", *[F.col(c).alias(p + c) for c in ("id", "x", "y")])
    both = side("a_").join(side("b_"), "family").where("a_id < b_id")
    sx, sy = F.signum(F.col("a_x") - F.col("b_x")), F.signum(F.col("a_y") - F.col("b_y"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counted = both.groupBy("family").agg(
        count(sx * sy > 0).alias("concordant"), count(sx * sy < 0).alias("discordant"), count((sx == 0) & (sy != 0)).alias("ties_x"),
        count((sx != 0) & (sy == 0)).alias("ties_y"), count((sx == 0) & (sy == 0)).alias("ties_both"), count(sx != 0).alias("ordered"))
    return xy.groupBy("family").agg(F.count("*").alias("n")).join(counted, "family", "left").na.fill(0)


def kendall(xy: DataFrame) -> DataFrame:
    """(family, n, tau, rank_preservation, tied): tau-b, null for constant input; the share of ordered pairs in x
    that y orders alike, ties of y counting as wrong; the number of pairs that are tied in x or y."""
    c, d = F.col("concordant"), F.col("discordant")
    nx, ny = c + d + F.col("ties_y"), c + d + F.col("ties_x")
    tau = F.when((nx > 0) & (ny > 0), (c - d) / F.sqrt(nx.cast("double") * ny))
    return order_counts(xy).select("family", "n", tau.alias("tau"), (c / F.greatest(F.col("ordered"), F.lit(1))).alias("rank_preservation"),
                                     (F.col("ties_x") + F.col("ties_y") + F.col("ties_both")).alias("tied"))


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p by Student's t with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    return 0.0 if abs(rho) >= 1 else student_t_two_sided(rho * sqrt((n - 2) / (1 - rho * rho)), n - 2)


#: Sample size up to which tau without ties has an exact p.
EXACT = 33


def _orders_with(n: int, most: int) -> int:
    """Number of the n! orders with at most ``most`` inversions: coefficients of the product of 1 + x + ... + x^(k - 1)."""
    counts = [1] + [0] * most
    for k in range(2, n + 1):
        run, new = 0, []
        for i in range(most + 1):
            run += counts[i] - (counts[i - k] if i >= k else 0)
            new.append(run)
        counts = new
    return sum(counts)


def kendall_p(tau: float | None, n: int, tied: int | None = None) -> float | None:
    """Two-sided p. Exact up to EXACT values, and where at most one pair is out of order, if ``tied``, the number of
    tied pairs, is given as 0; else the normal approximation without ties."""
    if tau is None or n < 2:
        return None
    pairs = n * (n - 1) // 2
    wrong = round((1 - abs(tau)) * pairs / 2)
    if tied == 0 and (n <= EXACT or wrong <= 1):
        return min(1.0, 2 * _orders_with(n, wrong) / factorial(n))
    return erfc(abs(tau) / sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))) / sqrt(2))



def effect_size(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; with no spread 0 if they agree, else infinite."""
    return F.when(std > 0, (x - mean) / std).when(x == mean, F.lit(0.0)).otherwise(F.lit(INF))

