"""Unbiased estimators from counts (M-01, M-03, M-08, U-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product of at most c factors; 1 where n - c < k."""
    factors = F.sequence(n - c + 1, n)
    product = F.aggregate(factors, F.lit(1.0), lambda a, x: a * (1 - k / x))
    return F.when(n - c < k, 1.0).when(c <= 0, 0.0).otherwise(1 - product)


def pass_hat_k(n: Column, c: Column, k: Column) -> Column:
    """C(c, k) / C(n, k) as a product of k factors; needs n >= k."""
    steps = F.sequence(F.lit(0).cast("long"), (k - 1).cast("long"))
    product = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (c - i) / (n - i))
    return F.when(n < k, None).when(c < k, 0.0).otherwise(product)
