"""Profiles: the spectral and the interpretable measures of each script in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .interpret import VECTOR, interpretable_features
from .matrix import spectral_features


def with_scalars(spectral: DataFrame) -> DataFrame:
    """Entropies and effective rank of the kept spectra, by expressions over the arrays."""
    return (
        spectral.withColumn("bistochastic_entropy", A.spectral_entropy(F.col("bistochastic_spectrum")))
        .withColumn("effective_rank", A.effective_rank(F.col("bistochastic_spectrum")))
        .withColumn("laplacian_entropy", A.spectral_entropy(F.col("laplacian_spectrum")))
    )


def spectral_vector() -> Column:
    """The six scalar features, in the order in which their ranges are fixed."""
    return F.array("bistochastic_gap", "bistochastic_entropy", "effective_rank", "symmetric_gap", "fiedler_value", "laplacian_entropy")


def normalized_spectra(spectral: DataFrame) -> DataFrame:
    """(script, kind, values, cumulative) of the doubly stochastic and the Laplacian spectrum."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_spectrum").alias("v")) for k in ("bistochastic", "laplacian")])
    rows = spectral.select("script", F.inline(kinds))
    values = A.normalized_spectrum(F.col("v"))
    return rows.select("script", "kind", values.alias("values"), A.running(values).alias("cumulative"))


def extract_profiles(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each script; spectral_vec has 6, interpretable_vec 7 and vec 13 numbers."""
    spectral = with_scalars(spectral_features(cells, labels)).withColumn("spectral_vec", spectral_vector())
    rows = spectral.join(interpretable_features(cells, labels), "script").withColumn("interpretable_vec", F.array(*VECTOR))
    return rows.withColumn("vec", F.concat("spectral_vec", "interpretable_vec"))


COMPARED = ("accuracy", "sparsity", "gini", "dominance", "symmetry", "mean_entropy", "bistochastic_gap", "fiedler_value")


def compare_profiles(profiles: DataFrame) -> DataFrame:
    """(a, b, eight absolute differences) of every pair a < b; a row for each pair of matrices."""
    side = lambda p: profiles.select(*[F.col(c).alias(p + c) for c in ("script", *COMPARED)])
    pairs = side("a_").join(side("b_"), F.col("a_script") < F.col("b_script"))
    return pairs.select(F.col("a_script").alias("a"), F.col("b_script").alias("b"),
                        *[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"{c}_diff") for c in COMPARED])


def profile_json(profiles: DataFrame) -> DataFrame:
    """(script, json): every number of the profile under its name."""
    return profiles.select("script", F.to_json(F.struct(*[c for c in profiles.columns])).alias("json"))


def profile_summary(profiles: DataFrame) -> DataFrame:
    """(script, summary): a line for reading."""
    line = F.format_string("%s: n=%d gap=%.4f rank=%.2f fiedler=%.4f accuracy=%.4f gini=%.4f", "script", "matrix_size", "bistochastic_gap",
                           "effective_rank", "fiedler_value", "accuracy", "gini")
    return profiles.select("script", line.alias("summary"))
