"""Statistics formulas on top of Spark's population aggregates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population skewness (needs n > 2).

    A constant column has no population skewness; its corrected value is 0.
    """
    n = n.cast("double")
    return F.when(n > 2, F.coalesce(g1, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis (needs n > 3), 0 for a constant column."""
    n = n.cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.coalesce(corrected, F.lit(0.0)))


def distribution_label(skew: Column, kurt: Column) -> Column:
    """Shape wording by skewness and kurtosis, first match wins."""
    near_zero = F.abs(skew) < 0.3
    light = F.coalesce(F.abs(kurt) < 0.5, F.lit(False))
    heavy = F.coalesce(kurt > 1, F.lit(False))
    return (
        F.when(skew.isNull(), "unknown")
        .when(near_zero & light, "roughly normal / symmetric")
        .when(near_zero & heavy, "symmetric with heavy tails")
        .when(near_zero, "symmetric")
        .when(skew > 1.0, "strongly skewed right (right tail)")
        .when(skew < -1.0, "strongly skewed left (left tail)")
        .when(skew > 0, "mildly skewed right")
        .otherwise("mildly skewed left")
    )


def histogram_bins(n: Column, spread: Column, iqr: Column) -> Column:
    """Freedman-Diaconis bin count held between 5 and 50; small samples use n // 5."""
    width = 2.0 * F.greatest(iqr, F.lit(1e-9)) / F.pow(n.cast("double"), F.lit(1.0 / 3.0))
    wide = F.greatest(F.lit(5.0), F.least(F.lit(50.0), F.ceil(spread / width).cast("double")))
    small = F.greatest(F.lit(5.0), F.floor(n / 5).cast("double"))
    return F.when(n < 30, small).otherwise(wide).cast("bigint")


def strength_word(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(a >= 0.85, "very strong")
        .when(a >= 0.65, "strong")
        .when(a >= 0.4, "moderate")
        .when(a >= 0.2, "weak")
        .otherwise("very weak")
    )


def sign_word(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")
