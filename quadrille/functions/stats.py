"""Scores, posteriors and divergences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def freshness(semantic: Column, spatial: Column, alpha: float = 0.5, rate_semantic: float = 1.0, rate_spatial: float = 1.0) -> Column:
    return alpha * F.exp(-rate_semantic * semantic) + (1 - alpha) * F.exp(-rate_spatial * spatial)


def presence(n_class: Column, n_total: Column, alpha: float = 1.0, beta: float = 4.0) -> Column:
    """Mean of the beta-binomial posterior of presence."""
    return (n_class + alpha) / (n_total + alpha + beta)


def presence_sd(n_class: Column, n_total: Column, alpha: float = 1.0, beta: float = 4.0) -> Column:
    a, b = n_class + alpha, n_total - n_class + beta
    return F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))


def band(value: Column, limits: tuple[float, float, float]) -> Column:
    low, medium, high = limits
    return F.when(value < low, "low").when(value < medium, "medium").when(value < high, "high").otherwise("extreme")


def finite(value: Column, default: float) -> Column:
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(ok, value).otherwise(F.lit(default))


def kl_term(p: Column, q: Column, epsilon: float = 1e-10) -> Column:
    return (p + epsilon) * F.log((p + epsilon) / (q + epsilon))


def weighted_available(pairs: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the values that aren't null."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for value, w in pairs:
        total = total + F.coalesce(value * w, F.lit(0.0))
        weights = weights + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(weights > 0, total / F.when(weights > 0, weights).otherwise(1.0))
