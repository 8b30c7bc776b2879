"""Kernel scores over factor arrays, and the rating bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, col

KERNELS = ("linear", "sigmoid", "rbf")


def clip(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col(value)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def kernel_score(
    kernel: str,
    mean: float,
    user_bias,
    item_bias,
    user_factors,
    item_factors,
    gamma: float,
    min_rating: float,
    max_rating: float,
) -> Column:
    """Predicted rating. The RBF kernel uses neither the mean nor the biases."""
    span = float(max_rating - min_rating)
    linear = F.lit(float(mean)) + col(user_bias) + col(item_bias) + dot(user_factors, item_factors)
    if kernel == "linear":
        return linear
    if kernel == "sigmoid":
        return F.lit(float(min_rating)) + F.lit(span) / (F.lit(1.0) + F.exp(-linear))
    if kernel == "rbf":
        near = F.exp(F.lit(-float(gamma)) * squared_distance(user_factors, item_factors))
        return F.lit(float(min_rating)) + F.lit(span) * near
    raise ValueError(f"kernel must be one of {KERNELS}")


def unit(vector: Column | str) -> Column:
    """L2-normalised copy; a zero vector stays zero."""
    values = F.transform(col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    return bind(norm, lambda n: F.transform(values, lambda x: F.when(n > 0, x / n).otherwise(x)))
