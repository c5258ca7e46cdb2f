"""Joins between trajectory tables by id (J-01, J-02, J-04 .. J-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(centroids: DataFrame, evals: DataFrame) -> DataFrame:
    """J-01: centroids with evaluations; the evaluation wins for correctness and answer."""
    e = evals.select("traj_id", F.col("is_correct").alias("e_ok"), F.col("extracted_answer").alias("e_answer"))
    return (
        centroids.join(e, "traj_id", "left")
        .withColumn("is_correct", F.coalesce("e_ok", "is_correct", F.lit(False)))
        .withColumn("extracted_answer", F.coalesce("e_answer", "extracted_answer"))
        .drop("e_ok", "e_answer")
    )


def lookup(rows: DataFrame, *tables: DataFrame, key: str = "traj_id") -> DataFrame:
    """J-02: left joins of per-trajectory tables."""
    for t in tables:
        rows = rows.join(t, key, "left")
    return rows


def pending(every: DataFrame, done: DataFrame, key: str = "traj_id") -> DataFrame:
    """J-04: rows whose id is not completed."""
    return every.join(done.select(key).distinct(), key, "left_anti")


def matched_and_skipped(rows: DataFrame, problems: DataFrame, key: str = "problem_id") -> tuple[DataFrame, DataFrame]:
    """J-05: rows with a known problem, and the ids without one."""
    return rows.join(problems, key), rows.select(key).distinct().join(problems.select(key), key, "left_anti")


def within(rows: DataFrame, ids: DataFrame, key: str = "task_id") -> DataFrame:
    """J-06."""
    return rows.join(ids.select(key), key, "left_semi")
