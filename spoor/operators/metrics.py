"""Metrics and roll-ups over evaluation tables (M-01 .. M-35)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counting import pass_at_k, pass_hat_k
from .spread import CHUNK, group_percentiles, numbered


def _n() -> Column:
    return F.col("n")


def _c() -> Column:
    return F.col("c")


def _flag() -> Column:
    """A missing verdict is a wrong answer."""
    return F.coalesce(F.col("is_correct"), F.lit(False)).cast("double")


def counts(evals: DataFrame, keys: Sequence[str] = ("problem_id",), ok: Column | None = None) -> DataFrame:
    """Trials n and successes c per key."""
    ok = F.col("is_correct") if ok is None else ok
    return evals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("c"))


def _ks(ks: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(int(k)) for k in ks]))


def pass_at_k_skipping(evals: DataFrame, ks: Sequence[int]) -> DataFrame:
    """M-01: problems with n <= k are left out, mean over the rest."""
    per = counts(evals).withColumn("k", _ks(ks)).filter("n > k")
    return per.groupBy("k").agg(
        F.avg(pass_at_k(_n(), _c(), F.col("k"))).alias("pass_at_k"),
        F.count(F.lit(1)).alias("num_problems"),
        F.avg("n").alias("mean_trajectories"),
    )


def available_ks(evals: DataFrame) -> DataFrame:
    """M-02: 1 .. max(n) - 1."""
    top = counts(evals).agg(F.max("n").alias("m")).filter("m > 1")
    return top.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("m") - 1)).alias("k"))


def pass_at_k_strict(per: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """M-03/M-06: a k is reported only where every problem has at least k generations. Rows: n, c."""
    rows = per.withColumn("k", _ks(ks))
    return (
        rows.groupBy(*by, "k")
        .agg(F.min("n").alias("least"), F.avg(pass_at_k(_n(), _c(), F.col("k"))).alias("pass_at_k"))
        .filter("least >= k")
        .drop("least")
    )


def generation_correct(outcomes: DataFrame, keys: Sequence[str] = ("problem_id", "generation")) -> DataFrame:
    """M-04: a generation is correct when every test outcome is positive."""
    return outcomes.groupBy(*keys).agg((F.min("outcome") > 0).alias("is_correct"))


def pass_at_k_by(per: DataFrame, by: str, ks: Sequence[int]) -> DataFrame:
    """M-05: one roll-up per k: overall (`all`) and per difficulty; a missing difficulty is `unknown`."""
    rows = per.withColumn("k", _ks(ks)).withColumn("p", pass_at_k(_n(), _c(), F.col("k")))
    return rows.groupingSets([[F.col("k"), F.col(by)], [F.col("k")]], "k", by).agg(F.grouping(by).alias("whole"), F.avg("p").alias("pass_at_k")).select(
        "k", F.when(F.col("whole") == 1, "all").otherwise(F.coalesce(by, F.lit("unknown"))).alias(by), "pass_at_k"
    )


def pass_at_1_percent(evals: DataFrame) -> DataFrame:
    """M-07."""
    return counts(evals).agg((F.avg(_c() / _n()) * 100).alias("pass_at_1"))


def task_pass_hat_k(runs: DataFrame, task: Sequence[str], max_k: int, ok: Column) -> DataFrame:
    """M-08/M-09: pass^k per task for k = 1 .. max_k, one column per k; null where a task has fewer than k runs."""
    per = counts(runs, task, ok)
    k = lambda i: pass_hat_k(_n(), _c(), F.lit(i))
    return per.select(*task, "n", "c", *[k(i).alias(f"pass_hat_{i}") for i in range(1, max_k + 1)])


def max_trials(per: DataFrame) -> DataFrame:
    """M-09: one row max_k, the runs of the smallest task; larger k are not reported."""
    return per.agg(F.min("n").alias("max_k"))


def agent_metrics(runs: DataFrame, task: Sequence[str], max_k: int, ok: Column, by: Sequence[str] = ()) -> DataFrame:
    """M-10: mean reward and cost over runs, mean pass^k over tasks; null for k above the smallest task's runs."""
    g = runs.groupBy(*by).agg(F.avg("reward").alias("avg_reward"), F.avg("agent_cost").alias("avg_agent_cost"))
    per = task_pass_hat_k(runs, [*by, *task], max_k, ok)
    p = per.groupBy(*by).agg(*[F.when(F.min("n") >= i, F.avg(f"pass_hat_{i}")).alias(f"pass_hat_{i}") for i in range(1, max_k + 1)])
    return g.join(p, list(by)) if by else g.crossJoin(p)  # one row each


def accuracy(results: DataFrame) -> DataFrame:
    """M-11. A missing verdict is wrong; a missing error flag is none."""
    ok, bad = F.coalesce("is_correct", F.lit(False)), F.coalesce("error", F.lit(False))
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("correct"),
        F.count_if(~ok & ~bad).alias("incorrect"),
        F.count_if(bad).alias("failed_extraction"),
        F.avg(_flag()).alias("accuracy"),
    )


def breakdown(results: DataFrame, dims: Sequence[str]) -> DataFrame:
    """M-12: counts and accuracy per value of each dimension, all dimensions in one scan; a missing value is `unknown`."""
    results = results.withColumns({d: F.coalesce(d, F.lit("unknown")) for d in dims})
    sets = [[F.col(d)] for d in dims]
    which = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    g = results.groupingSets(sets, *dims).agg(
        which.alias("dimension"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_correct").alias("correct"),
        F.avg(_flag()).alias("accuracy"),
    )
    return g.select("dimension", F.coalesce(*dims).alias("value"), "total", "correct", "accuracy")


def low_confidence(results: DataFrame, below: float = 0.8) -> DataFrame:
    """M-13."""
    c = lambda n: F.coalesce(n, F.lit(1.0)) < below
    return results.filter(c("comparison_confidence") | c("extraction_confidence"))


def trajectory_counts(evals: DataFrame) -> DataFrame:
    """M-14."""
    return counts(evals).agg(F.count_if(_n() > 1).alias("multi_trajectory"), F.count_if(_n() <= 1).alias("single_trajectory"))


def accuracy_by(results: DataFrame, *by: str) -> DataFrame:
    """M-15, M-20, M-29 and the like."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), F.avg(_flag()).alias("accuracy"))


def mixed_pass_rate(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """M-16: samples(idx, question_list) against answers(idx, q_idx, is_correct); missing answers are wrong."""
    q = samples.select("idx", F.posexplode("question_list").alias("q_idx", "question"))
    per = q.join(answers, ["idx", "q_idx"], "left").groupBy("idx").agg(
        (F.count_if(F.coalesce("is_correct", F.lit(False))) / F.count(F.lit(1))).alias("pass_rate")
    )
    return per.withColumn("is_correct", F.col("pass_rate") == 1.0)


def score_sheet(results: DataFrame, types: Sequence[str]) -> DataFrame:
    """M-18: model x mode rows, a column per question type, overall = sum correct / sum total."""
    c = lambda t: F.count_if((F.col("question_type") == t) & F.col("is_correct"))
    n = lambda t: F.count_if(F.col("question_type") == t)
    cols = [F.when(n(t) > 0, c(t) / n(t) * 100).alias(t) for t in types]
    every = F.count_if("is_correct") / F.count(F.lit(1)) * 100
    return results.groupBy("model", "mode").agg(*cols, every.alias("overall"))


def counterfactual_rates(results: DataFrame) -> DataFrame:
    """M-17: accuracy beside the share that gave the real-life answer instead."""
    return results.groupBy("question_type", "mode").agg(
        F.avg(_flag()).alias("accuracy"), F.avg(F.col("is_real_life").cast("double")).alias("real_life_rate")
    )


def variant_table(results: DataFrame, variants: Sequence[str]) -> DataFrame:
    """M-19: pass@1 per model and variant; a calibrated run overrides the original."""
    g = results.groupBy("model", "variant").agg(
        F.avg(F.when(F.col("calibrated"), _flag())).alias("cal"), F.avg(F.when(~F.col("calibrated"), _flag())).alias("orig")
    )
    score = F.coalesce("cal", "orig") * 100
    return g.groupBy("model").agg(*[F.max(F.when(F.col("variant") == v, score)).alias(v) for v in variants])


def domain_performance(results: DataFrame, domains: Sequence[str]) -> DataFrame:
    """M-21: a task counts in each of its domains."""
    rows = results.withColumn("domain", F.explode("domains"))
    return rows.groupBy("model").agg(*[F.avg(F.when(F.col("domain") == d, _flag())).alias(d) for d in domains])


# Cumulative Poisson(1) probabilities for 0, 1, 2, ... events, to below the steps of the 32-bit hash.
POISSON = [round(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)), 12) for i in range(13)]


def bootstrap(results: DataFrame, by: str, id_col: str, reps: int = 100) -> DataFrame:
    """M-22: 2.5/50/97.5 quantiles of resampled accuracy.

    A row's weight in a replicate is Poisson(1) from a hash of (replicate, id):
    reproducible in any partitioning, and summed map-side.
    """
    rows = results.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    h = F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col(id_col).cast("string")))
    u = F.conv(F.substr(h, F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    rows = rows.withColumn("u", u)
    w = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    rows = rows.withColumn("w", w)
    per = rows.groupBy(by, "rep").agg((F.sum(F.when(F.col("is_correct"), F.col("w")).otherwise(0)) / F.nullif(F.sum("w"), F.lit(0))).alias("acc"))
    at = lambda p: F.percentile("acc", F.lit(p))  # noqa: E731 - `reps` values per group
    q = per.groupBy(by).agg(at(0.025).alias("lower"), at(0.5).alias("median"), at(0.975).alias("upper"))
    return q.withColumn("error_low", F.col("median") - F.col("lower")).withColumn("error_high", F.col("upper") - F.col("median"))


def domain_termination_counts(runs: DataFrame) -> DataFrame:
    """M-23: counts by domain, by reason, by both, and in all, in one pass."""
    lab = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c))
    g = runs.cube("domain", "termination_reason").agg(
        lab("domain").alias("d"), lab("termination_reason").alias("t"), F.count(F.lit(1)).alias("n")
    )
    return g.select(F.col("d").alias("domain"), F.col("t").alias("termination_reason"), "n")


def voting_accuracy(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """M-24."""
    ok = F.coalesce(F.col("answer") == F.col("ground_truth"), F.lit(False)).cast("double")
    return votes.join(truth, "problem_id").groupBy("method").agg(
        F.avg(ok).alias("accuracy"), F.avg("num_votes").alias("mean_votes"), F.avg("confidence").alias("mean_confidence")
    )


def stop_groups(online: DataFrame, measure: str) -> DataFrame:
    """M-25: accuracy of warm-up above the bar, warm-up below it, completed and stopped traces."""
    g = (
        F.when((F.col("phase") == "warmup") & (F.col(measure) >= F.col("conf_bar")), "warmup_above")
        .when(F.col("phase") == "warmup", "warmup_below")
        .when(F.col("stopped"), "early_stopped")
        .otherwise("completed")
    )
    return online.groupBy(g.alias("trace_group")).agg(F.count(F.lit(1)).alias("n"), F.avg(_flag()).alias("accuracy"))


def token_usage(questions: DataFrame) -> DataFrame:
    """M-26: rows are questions with total_tokens and n_traces."""
    t = F.col("total_tokens")
    med = group_percentiles(questions, [], "total_tokens", {"median_tokens": 0.5})
    return questions.agg(
        F.avg(t).alias("mean_tokens"),
        F.stddev_pop(t).alias("std_tokens"),
        F.min(t).alias("min_tokens"),
        F.max(t).alias("max_tokens"),
        F.sum(t).alias("sum_tokens"),
        (F.sum(t) / F.sum("n_traces")).alias("tokens_per_trace"),
    ).crossJoin(med)  # one row each


def timing(questions: DataFrame, phases: Sequence[str]) -> DataFrame:
    """M-27: statistics per timing column with zeros left out, and tokens per second."""
    long = questions.select(
        "total_tokens", F.inline(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).cast("double").alias("seconds")) for p in phases]))
    ).filter("seconds > 0")
    s = F.col("seconds")
    base = long.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"),
        (F.sum("total_tokens") / F.sum(s)).alias("tokens_per_second"),
    )
    return base.join(group_percentiles(long, ["phase"], "seconds", {"median": 0.5}), "phase")


def missing_pairs(done: DataFrame, max_question: int, runs: Sequence[int]) -> DataFrame:
    """M-28: the declared question x run grid minus what exists."""
    grid = done.sparkSession.range(max_question).withColumnRenamed("id", "question_id")
    grid = grid.withColumn("run", F.explode(F.array(*[F.lit(int(r)) for r in runs])))
    return grid.join(done.select("question_id", "run"), ["question_id", "run"], "left_anti")


def question_accuracy(results: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """M-29: mean per question, answer types optionally left out."""
    return accuracy_by(results.filter(~F.col("answer_type").isin(list(exclude))) if exclude else results, "problem_id")


def reasoning_summary(results: DataFrame) -> DataFrame:
    """M-30."""
    return results.agg(
        F.avg("reasoning_length").alias("mean_length"),
        F.avg(F.col("extracted_answer").isNull().cast("double")).alias("no_answer_rate"),
        F.avg(_flag()).alias("accuracy"),
    )


def expected_count(rows: DataFrame) -> DataFrame:
    """M-31: one row with the most common trajectory count; equal frequencies take the smaller."""
    per = rows.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"))
    freq = per.groupBy("n").agg(F.count(F.lit(1)).alias("f"))
    return freq.agg(F.min(F.struct((-F.col("f")).alias("f"), "n")).alias("b")).select(F.col("b.n").alias("expected"))


def truncated(rows: DataFrame) -> DataFrame:
    """M-31: each problem cut to the expected count, in trajectory order."""
    r = numbered(rows, ["problem_id"], [F.col("traj_idx")], F.floor(F.col("traj_idx") / CHUNK).cast("long"), "rank")
    return r.crossJoin(F.broadcast(expected_count(rows))).filter("rank < expected").drop("rank", "expected")  # one row


def count_anomalies(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(expected_count(rows))).filter("n <> expected")  # one row


def evaluation_table(order: DataFrame, results: DataFrame) -> DataFrame:
    """M-32: trajectory ids and per-test outcomes of a problem joined by place in their lists."""
    ids = order.select("problem_id", F.posexplode("traj_ids").alias("i", "traj_id"))
    res = results.select("problem_id", F.posexplode("outcomes").alias("i", "tests"))
    return ids.join(res, ["problem_id", "i"]).select(
        "traj_id", "problem_id", F.forall("tests", lambda t: t > 0).alias("is_correct")
    )


def failed_tasks(evals: DataFrame) -> DataFrame:
    """M-33: every sample of the tasks that have a failing one, a missing status included."""
    failing = F.coalesce(F.col("status") != "pass", F.lit(True))
    bad = evals.groupBy("task_id").agg(F.max(failing).alias("any")).filter("any").select("task_id")
    return evals.join(bad, "task_id", "left_semi").select("task_id", "sample", "status", "details")


def stored_check(stored: DataFrame, evals: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """M-34: stored against recomputed pass@1 per problem."""
    now = evals.groupBy("problem_id").agg(F.avg(_flag()).alias("recomputed"))
    return stored.join(now, "problem_id").withColumn("agrees", F.abs(F.col("stored") - F.col("recomputed")) < tolerance)


def routed(samples: DataFrame, max_rounds: int) -> DataFrame:
    """M-35: status after a round: correct, error, max_rounds, or processing for the next round."""
    status = (
        F.when(F.col("error"), "error")
        .when(F.col("is_correct"), "correct")
        .when(F.col("round") >= max_rounds, "max_rounds")
        .otherwise("processing")
    )
    return samples.withColumn("status", status)


