"""Spectra and distributions as arrays: higher-order functions, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import ratio

SPECTRUM_KEPT, SPECTRUM_COMPARED = 50, 30
#: Spreads by which the scalar features are divided before they are compared.
SCALAR_RANGES = (1.0, 5.0, 50.0, 1.0, 2.0, 5.0)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def running(xs: Column) -> Column:
    """Cumulative sums."""
    step = lambda a, x: F.struct(
        (a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out"))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(xs, start, step, lambda a: a["out"])


def as_distribution(xs: Column) -> Column:
    """Divided by the sum if that is positive, else as it is."""
    s = total(xs)
    return F.when(s > 0, F.transform(xs, lambda x: x / s)).otherwise(xs)


def normalized_spectrum(xs: Column) -> Column:
    """Divided by the sum; uniform if that is zero."""
    s = total(xs)
    return F.when(s != 0, F.transform(xs, lambda x: x / s)).otherwise(F.transform(xs, lambda x: F.lit(1.0) / F.size(xs)))


def padded(xs: Column, n: Column) -> Column:
    return F.concat(xs, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(xs), F.lit(0)).cast("int")))


def wasserstein_1d(p: Column, q: Column, normalize: bool = True) -> Column:
    """Mean absolute difference of the cumulative sums; lengths must match, empty arrays give 0."""
    if normalize:
        p, q = as_distribution(p), as_distribution(q)
    diffs = F.zip_with(p, q, lambda x, y: x - y)
    # Only the sum of absolute running differences is kept, so the fold stays linear.
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["t"] + F.abs(a["s"] + x)).alias("t"))
    even = F.aggregate(diffs, start, step, lambda a: a["t"])
    return F.when(F.size(p) != F.size(q), F.raise_error(F.lit("distributions differ in length")).cast("double")).when(F.size(p) == 0, F.lit(0.0)).otherwise(even / F.size(p))


def cumulative_wasserstein(s1: Column, s2: Column, truncate_to: int | None = SPECTRUM_COMPARED) -> Column:
    """Truncated to ``truncate_to``, the shorter padded with zeros, then compared."""
    if truncate_to is not None:
        s1, s2 = F.slice(s1, 1, truncate_to), F.slice(s2, 1, truncate_to)
    n = F.greatest(F.size(s1), F.size(s2))
    return wasserstein_1d(padded(s1, n), padded(s2, n))


def spectral_entropy(xs: Column) -> Column:
    """Shannon entropy, in nats, of the squared values as shares; 0 for an empty or zero spectrum."""
    power = F.transform(xs, lambda x: x * x)
    s = total(power)
    term = lambda a, x: a - F.when(x > 0, x / s * F.log(x / s)).otherwise(0.0)
    return F.when(s > 0, F.aggregate(power, F.lit(0.0), term)).otherwise(F.lit(0.0))


def effective_rank(xs: Column) -> Column:
    return F.exp(spectral_entropy(xs))


def scaled_norm(v1: Column, v2: Column) -> Column:
    """Root mean square of the differences of two scalar vectors, each divided by its range."""
    ranges = F.array(*[F.lit(r) for r in SCALAR_RANGES])
    diffs = F.zip_with(F.zip_with(v1, v2, lambda x, y: x - y), ranges, lambda d, r: d / r)
    return F.sqrt(total(F.transform(diffs, lambda d: d * d))) / F.sqrt(F.lit(float(len(SCALAR_RANGES))))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b| of arrays of distinct items; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(1 - both / either)
