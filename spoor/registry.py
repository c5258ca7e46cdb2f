"""Extension points by name: scores, selectors, adapters, extractors, post-processors (U-01 .. U-07)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import table_functions, text
from .operators import centroid, metrics, phases, voting
from .operators.corpus import ngrams
from .sources.adapters import ADAPTERS

SCORES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "entropy_mean": centroid.score_entropy_mean,
    "entropy_min": centroid.score_entropy_min,
    "early_high_entropy": centroid.score_early_entropy,
}
SELECTORS: dict[str, Callable[..., DataFrame]] = {
    "best_score": voting.best_by_score,
    "entropy_centroid": voting.lowest_centroid,
    "majority_voting": voting.majority,
    "judged_majority": voting.judged_majority,
    "random": voting.random_pick,
    "centroid_voting": voting.centroid_vote,
    "centroid_weighted_voting": voting.weighted_centroid_vote,
    "confidence_weighted": voting.weighted_majority,
    "borda": voting.borda,
}
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "math": lambda c: text.answer_with_metadata(c)["answer"],
    "headed": text.header_answer,
    "logic": text.logic_answer,
    "code": text.code_block,
}


POST_PROCESSORS: dict[str, Callable[..., DataFrame]] = {}


def post_processor(*names: str) -> Callable:
    """U-05: register a step `DataFrame -> DataFrame` behind grading under one or more names; a name is given once."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for name in names:
            if name in POST_PROCESSORS:
                raise ValueError(f"post-processor {name} is there already")
            POST_PROCESSORS[name] = fn
        return fn

    return add


@post_processor("self-correction", "self-correction-with-needle")
def self_correction(samples: DataFrame, max_rounds: int = 15) -> DataFrame:
    """Graded samples with error, is_correct and round: the status that decides about another round."""
    return metrics.routed(samples, max_rounds)


@post_processor("normalised")
def normalised(samples: DataFrame, column: str = "extracted_answer") -> DataFrame:
    return samples.withColumn(column, text.normalise_answer(F.col(column)))


@post_processor("answer_key")
def keyed(samples: DataFrame, column: str = "extracted_answer") -> DataFrame:
    return samples.withColumn("key", voting.answer_key(F.col(column)))


def process(rows: DataFrame, name: str | None, **params) -> DataFrame:
    """U-05: a post-processor by name; rows of a mode that has none pass through unchanged."""
    if name is not None and not isinstance(name, str):
        raise TypeError(f"a post-processor is named by a string, not {name!r}")
    fn = POST_PROCESSORS.get(name)
    return rows if fn is None else fn(rows, **params)


def select(rows: DataFrame, name: str, **params) -> DataFrame:
    """Run a selector by name: `rows.transform(select, "majority_voting")`."""
    return SELECTORS[name](rows, **params)


def score(tokens: DataFrame, name: str, **params) -> DataFrame:
    return SCORES[name](tokens, **params)


def extract(column: Column, task_type: str) -> Column:
    return EXTRACTORS.get(task_type, EXTRACTORS["math"])(column)


def register_sql(spark: SparkSession) -> None:
    """U-06/U-07: the estimators as SQL functions, n-grams as a SQL function over built-in expressions, phases and steps as table functions."""
    table_functions.register(spark)
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION pass_at_k(n BIGINT, c BIGINT, k BIGINT) RETURNS DOUBLE RETURN
        CASE WHEN n - c < k THEN 1D WHEN c <= 0 THEN 0D
        ELSE 1D - aggregate(sequence(n - c + 1, n), 1D, (a, x) -> a * (1D - k / x)) END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION pass_hat_k(n BIGINT, c BIGINT, k BIGINT) RETURNS DOUBLE RETURN
        CASE WHEN n < k THEN NULL WHEN c < k THEN 0D
        ELSE aggregate(sequence(0L, k - 1), 1D, (a, i) -> a * (c - i) / (n - i)) END"""
    )
    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION word_ngrams(t STRING, n INT) RETURNS TABLE (ngram STRING) RETURN
        SELECT explode(CASE WHEN size(w) >= n THEN array_distinct(transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' ')))
        ELSE cast(array() AS array<string>) END) FROM (SELECT filter(split(t, '[\\s\\p{Z}]+'), x -> x <> '') AS w)"""
    )


__all__ = [
    "ADAPTERS", "EXTRACTORS", "POST_PROCESSORS", "SCORES", "SELECTORS", "extract", "ngrams", "phases", "post_processor", "process", "register_sql", "score", "select",
]
