"""Column functions over candidate probabilities, kept per row so no exchange is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_logprobs(logprobs: Column, k: int) -> Column:
    """The k largest log-probabilities of an array, largest first."""
    return F.slice(F.sort_array(logprobs, asc=False), 1, k)


def renormalised(logprobs: Column, k: int = 20) -> Column:
    """E-02: probabilities of the top k, summing to one."""
    p = F.transform(top_logprobs(logprobs, k), F.exp)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: F.when(total > 0, x / total).otherwise(x))


def entropy(logprobs: Column, k: int = 20) -> Column:
    """E-01: entropy in nats over the renormalised top k; an empty list is 0, a null list is null."""
    h = F.aggregate(
        renormalised(logprobs, k), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0)
    )
    return F.when(logprobs.isNotNull(), h)


def confidence(logprobs: Column) -> Column:
    """C-04: minus the mean log-probability, rounded half-even to 3; empty gives null."""
    n = F.size(logprobs)
    return F.when(n > 0, F.bround(F.round(-F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / n, 9), 3))


def confidence_from_probs(probs: Column) -> Column:
    """C-05: the same from stored probabilities."""
    return confidence(F.transform(probs, lambda p: F.ln(p + F.lit(1e-30))))


def band(percentile: Column) -> Column:
    """E-03: colour band of a rank percentile (0 = highest entropy)."""
    return (
        F.when(percentile < 1.0, "red").when(percentile < 3.0, "pink").when(percentile < 5.0, "purple").otherwise("black")
    )
