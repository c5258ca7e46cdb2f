"""Batch grading over mixed task types (X-20)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


class Rule(NamedTuple):
    """How a task type is graded: the answer in a text, and (truth, answer) to right or wrong."""

    answer: Callable[[Column], Column]
    equal: Callable[[Column, Column], Column]


MATH = "math"
# Types beside `math`; their method is named by type and subtype, as no rule below tells how it decided.
RULES: dict[str, Rule] = {
    "choice": Rule(tx.bracketed, lambda truth, a: tx.math_equal(a, truth)),
    "logic": Rule(tx.logic_answer, lambda truth, a: tx.structured_key(a) == tx.structured_key(truth)),
}


def truth_of(columns: Sequence[Column]) -> Column:
    """The first truth that is neither null nor empty; of a whole solution the content of its last box."""
    first = F.coalesce(*[F.when(c != "", c) for c in columns])
    return F.when(first.contains("\\boxed"), F.coalesce(tx.boxed(first), first)).otherwise(first)


def compared(rows: DataFrame, truth: str, answer: str, out: str = "method", rtol: float = 1e-6, atol: float = 1e-9) -> DataFrame:
    """X-15 in steps: `out` is exact, numeric, either on the cleaned answer, failed, or null where a side is null.

    Equal to `text.compare_answers`, but the three numbers are read by one expression
    and each value has a name, so the generated code stays small.
    """
    steps = rows.withColumn("__clean", tx.clean_latex(F.col(answer)))
    steps = steps.withColumn("__x", F.transform(F.array(truth, answer, "__clean"), tx.parse_number))
    near = lambda k: F.abs(F.col("__x")[0] - F.col("__x")[k]) <= atol + rtol * F.abs(F.col("__x")[k])
    again = (F.col("__clean") != F.col(answer)) & (F.col("__clean") != "")
    method = F.when(F.col(truth).isNull() | F.col(answer).isNull(), None).when(F.col(truth) == F.col(answer), "exact").when(near(1), "numeric")
    method = method.when(again & (F.col(truth) == F.col("__clean")), "exact_cleaned").when(again & near(2), "numeric_cleaned").otherwise("failed")
    return steps.withColumn(out, method).drop("__clean", "__x")


def graded(samples: DataFrame, truths: Sequence[str] = ("solution", "answer", "final_answer"), normalise: bool = False) -> DataFrame:
    """X-20: traj_id, original_id, task_type, extracted_answer, ground_truth, is_correct, comparison_method.

    `samples` has traj_id, original_id, generated_text, task_type, subtype and the
    columns of truths. Each row goes by the rule of its own type, unknown or null
    types by that of `math`; a null original_id is the part of traj_id before its
    marker. Without answer or truth a row is wrong by method `none`. `normalise`
    compares normalised answers and truths; what is reported stays as extracted.
    Each step names what the next one reads more than once, so no pattern runs
    twice and no expression outgrows generated code. There is no exchange.
    """
    text, kind = F.col("generated_text"), F.coalesce("task_type", F.lit(MATH))
    own = kind.isin(list(RULES))
    answer, equal = tx.answer_with_metadata(text)["answer"], F.lit(False)
    for name, rule in RULES.items():
        answer = F.when(kind == name, rule.answer(text)).otherwise(answer)
        equal = F.when(kind == name, rule.equal(F.col("truth"), F.col("got"))).otherwise(equal)
    rows = samples.select(
        "traj_id", F.coalesce("original_id", F.substring_index("traj_id", "_traj_", 1)).alias("original_id"), "task_type", "subtype",
        answer.alias("extracted_answer"), truth_of([F.col(c) for c in truths]).alias("ground_truth"),
    )
    plain = tx.normalise_answer if normalise else lambda c: c
    both = F.col("extracted_answer").isNotNull() & F.col("ground_truth").isNotNull()
    rows = rows.withColumns({"truth": F.when(both, plain(F.col("ground_truth"))), "got": F.when(both, plain(F.col("extracted_answer")))})
    rows = compared(rows, "truth", "got", "__method")
    right = F.when(~both, False).when(own, F.coalesce(equal, F.lit(False))).otherwise(F.col("__method") != "failed")
    method = F.when(~both, "none").when(own, F.concat_ws("_", "task_type", F.coalesce(F.nullif("subtype", F.lit("")), F.lit("unknown")))).otherwise(F.col("__method"))
    return rows.select("traj_id", "original_id", "task_type", "extracted_answer", "ground_truth", right.alias("is_correct"), method.alias("comparison_method"))
