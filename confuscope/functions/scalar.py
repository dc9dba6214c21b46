"""Small column helpers that are safe under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where b is zero or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def r6(c: Column) -> Column:
    """Rounded to six digits, without negative zero."""
    return F.round(c + F.lit(0.0), 6) + F.lit(0.0)


def average_rank(order: Column, partition, count_over) -> Column:
    """Rank with ties averaged: rank of the first plus half of the ties after it."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*partition).orderBy(order)
    ties = W.partitionBy(*partition, order)
    return F.rank().over(w) + (F.count(count_over).over(ties) - 1) / 2.0


def student_t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the regularised incomplete beta function."""
    if df <= 0:
        return float("nan")
    if t in (INF, -INF):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    from math import exp, lgamma, log, log1p

    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + term * d or tiny)
        c = 1.0 + term / c or tiny
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * (f - 1.0)
