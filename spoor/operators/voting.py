"""Selecting one trajectory or answer per problem (V-01 .. V-30).

Rows: problem_id, traj_idx, plus what each rule needs (answer key, centroid,
score, is_correct). Choices are two-level aggregations with map-side combine:
per (problem, answer), then per problem. Where a rule needs a group value on
each row it is joined back. No window holds a whole problem.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .spread import group_percentiles, ranked, with_group

P = ["problem_id"]


def answer_key(answer: Column) -> Column:
    """V-06: trimmed, lower-case, single blanks; null and empty get names of their own."""
    key = F.regexp_replace(F.lower(F.regexp_replace(answer, r"^\s+|\s+$", "")), r"\s+", " ")
    return F.when(answer.isNull(), "__none__").when(key == "", "__empty__").otherwise(key)


def _best(*order: Column) -> Column:
    return F.min(F.struct(*order))


# --- by score -----------------------------------------------------------------------------


def best_by_score(rows: DataFrame, score: str) -> DataFrame:
    """V-01: highest score, the earlier trajectory on ties."""
    b = rows.groupBy(*P).agg(_best((-F.col(score)).alias("s"), "traj_idx").alias("b"))
    return b.select(*P, F.col("b.traj_idx").alias("selected_idx"), (-F.col("b.s")).alias("selected_score"))


def outliers(rows: DataFrame, method: str = "none", threshold: float = 0.1, num_std: float = 1.0, keys: Sequence[str] = P) -> DataFrame:
    """V-02: flag by distance from the mean of the problem's centroids (population deviation)."""
    rows = with_group(rows, keys, mean_centroid=F.avg("centroid"), std_centroid=F.stddev_pop("centroid"))
    d, s = F.col("centroid") - F.col("mean_centroid"), F.col("std_centroid")
    rules = {
        "none": F.lit(False),
        "threshold": F.abs(d) > threshold,
        "below_mean_threshold": F.col("centroid") < F.col("mean_centroid") - threshold,
        "std": (s > 0)
        & (
            (F.col("centroid") < F.col("mean_centroid") - num_std * s)
            | (F.col("centroid") > F.col("mean_centroid") + num_std * s)
        ),
    }
    return rows.withColumn("is_outlier", rules[method])


def lowest_centroid(rows: DataFrame, method: str = "none", threshold: float = 0.1, num_std: float = 1.0) -> DataFrame:
    """V-03: lowest centroid after the outlier filter; all filtered: unfiltered; none valid: first trajectory."""
    flagged = outliers(rows.filter("centroid IS NOT NULL"), method, threshold, num_std)
    pick = flagged.groupBy(*P).agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.count_if("is_outlier").alias("n_outliers"),
        _best("is_outlier", "centroid", "traj_idx").alias("b"),
    )
    first = rows.groupBy(*P).agg(F.count(F.lit(1)).alias("n_trajectories"), F.min("traj_idx").alias("first_idx"))
    return first.join(pick, P, "left").select(
        *P,
        "n_trajectories",
        F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
        F.when(F.col("n_valid") == F.col("n_outliers"), 0).otherwise(F.coalesce("n_outliers", F.lit(0))).cast("long").alias("n_excluded"),
        F.coalesce("b.traj_idx", "first_idx").alias("selected_idx"),
        F.col("b.centroid").alias("selected_centroid"),
    )


def threshold_picks(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """V-04/V-05: per threshold and problem, the lowest centroid with mean - centroid <= threshold."""
    rows = with_group(rows.filter("centroid IS NOT NULL"), P, mean_centroid=F.avg("centroid"), n=F.count(F.lit(1)))
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = rows.withColumn("threshold", F.explode(grid))
    cut = (F.col("n") > 1) & (F.col("mean_centroid") - F.col("centroid") > F.col("threshold"))
    b = rows.groupBy("threshold", *P).agg(
        F.count_if(cut).alias("n_cut"),
        F.count(F.lit(1)).alias("n"),
        _best(cut.alias("cut"), "centroid", "traj_idx", "is_correct").alias("b"),
    )
    return b.select(
        "threshold",
        *P,
        F.col("b.traj_idx").alias("selected_idx"),
        F.col("b.centroid").alias("selected_centroid"),
        F.col("b.is_correct").alias("is_correct"),
        ((F.col("n_cut") > 0) & (F.col("n_cut") < F.col("n"))).alias("used_filter"),
    )


THRESHOLDS = [i / 100 for i in range(1, 31)]


def threshold_search(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """V-04: accuracy per threshold, best first (smaller threshold on ties).

    The first row tunes on the labels it reports; `held_out_search` does not.
    """
    acc = threshold_picks(rows, thresholds).groupBy("threshold").agg(
        F.avg(F.coalesce("is_correct", F.lit(False)).cast("double")).alias("accuracy"),  # a missing verdict is wrong
        F.count_if("is_correct").alias("correct_count"),
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if("used_filter").alias("filtered_problems"),
    )
    return acc.orderBy(F.col("accuracy").desc(), "threshold")


def held_out_search(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Threshold chosen on one half of the problems, accuracy reported on the other."""
    half = F.pmod(F.xxhash64("problem_id"), F.lit(2)) == 0
    picks = threshold_picks(rows, thresholds)
    best = (
        picks.filter(half)
        .groupBy("threshold")
        .agg(F.avg(F.col("is_correct").cast("double")).alias("a"))
        .agg(F.max(F.struct("a", (-F.col("threshold")).alias("t"))).alias("b"))
        .select((-F.col("b.t")).alias("threshold"))
    )
    return picks.filter(~half).join(F.broadcast(best), "threshold").groupBy("threshold").agg(
        F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("problems")
    )


# --- by answer ----------------------------------------------------------------------------


def tally(rows: DataFrame, weight: Column | None = None, keys: Sequence[str] = P) -> DataFrame:
    """Votes or weight per (problem, answer key), with the first appearance."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return rows.groupBy(*keys, "key").agg(w.alias("votes"), F.min("traj_idx").alias("first_idx"))


def _winner(votes: DataFrame, keys: Sequence[str] = P) -> DataFrame:
    return votes.groupBy(*keys).agg(_best((-F.col("votes")).alias("v"), "first_idx", "key").alias("b"), F.count(F.lit(1)).alias("n_unique"))


def majority(rows: DataFrame, count_nulls: bool = False) -> DataFrame:
    """V-07 / V-15: most votes, ties to the first seen; problems without answers take the first trajectory."""
    keyed = rows.withColumn("key", answer_key(F.col("extracted_answer")))
    votes = tally(keyed if count_nulls else keyed.filter("extracted_answer IS NOT NULL"))
    win = _winner(votes)
    base = rows.groupBy(*P).agg(F.count(F.lit(1)).alias("n_trajectories"), F.min("traj_idx").alias("i0"))
    return base.join(win, P, "left").select(
        *P,
        "n_trajectories",
        F.coalesce("n_unique", F.lit(0)).alias("n_unique_answers"),
        F.col("b.key").alias("winning_key"),
        (-F.col("b.v")).alias("winning_votes"),
        (-F.col("b.v") / F.col("n_trajectories") * 100).alias("winning_percentage"),
        F.coalesce("b.first_idx", "i0").alias("selected_idx"),
    )


def vote_distribution(rows: DataFrame) -> DataFrame:
    """V-08: votes and share per answer, with tie marks."""
    keyed = rows.withColumn("key", answer_key(F.col("extracted_answer")))
    votes = tally(keyed.filter("extracted_answer IS NOT NULL"))
    votes = with_group(votes, P, top=F.max("votes"), n_unique=F.count(F.lit(1)))
    votes = votes.join(rows.groupBy(*P).agg(F.count(F.lit(1)).alias("n")), P)
    votes = with_group(votes, P, n_top=F.count_if(F.col("votes") == F.col("top")))
    return votes.select(
        *P,
        "key",
        "votes",
        (F.col("votes") / F.col("n") * 100).alias("percentage"),
        "n_unique",
        (F.col("n_top") > 1).alias("had_tie"),
        ((F.col("n_top") > 1) & (F.col("votes") == F.col("top"))).alias("is_tied_answer"),
    )


def judged_majority(rows: DataFrame, judgments: DataFrame) -> DataFrame:
    """V-09: majority among answers judged correct (problem_id, key, judged), else over all; nulls vote."""
    votes = tally(rows.withColumn("key", answer_key(F.col("extracted_answer"))))
    votes = votes.join(judgments.select(*P, "key", "judged"), [*P, "key"], "left")
    bad = ~F.coalesce("judged", F.lit(False))
    b = votes.groupBy(*P).agg(_best(bad.alias("bad"), (-F.col("votes")).alias("v"), "first_idx", "key").alias("b"))
    return b.select(
        *P,
        F.col("b.key").alias("winning_key"),
        (-F.col("b.v")).alias("winning_votes"),
        F.col("b.first_idx").alias("selected_idx"),
        (~F.col("b.bad")).alias("judgment_used"),
    )


def random_pick(rows: DataFrame, seed: int = 42, samples: int | None = None) -> DataFrame:
    """V-10: reproducible pick by a hash of seed and id; optionally among the first `samples` of that order."""
    from pyspark.sql import Window as W

    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("traj_id")))
    if samples is None:
        b = rows.groupBy(*P).agg(F.min(F.struct(h.alias("h"), "traj_idx")).alias("b"))
        return b.select(*P, F.col("b.traj_idx").alias("selected_idx"))
    w = W.partitionBy(*P).orderBy("h", "traj_idx")
    return rows.withColumn("h", h).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= samples).select(*P, "traj_idx")


def centroid_vote(rows: DataFrame, percent: float = 30.0) -> DataFrame:
    """V-11/V-12: the lowest max(1, floor(n X / 100)) centroids vote, nulls included; ties to the smallest
    centroid, then its trajectory. Problems without any centroid fall back to a majority of all rows."""
    keyed = rows.withColumn("key", answer_key(F.col("extracted_answer")))
    valid = ranked(keyed.filter("centroid IS NOT NULL"), P, "centroid", [F.col("traj_idx")], "r", total="n")
    voters = valid.filter(F.col("r") < F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(percent) / 100)))
    per = voters.groupBy(*P, "key").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("centroid", "traj_idx")).alias("m"))
    win = per.groupBy(*P).agg(_best((-F.col("votes")).alias("v"), "m", "key").alias("b"))
    got = win.select(
        *P,
        F.col("b.key").alias("winning_key"),
        (-F.col("b.v")).alias("winning_votes"),
        F.col("b.m.centroid").alias("winning_centroid"),
        F.col("b.m.traj_idx").alias("selected_idx"),
    )
    none = keyed.join(got.select(*P), P, "left_anti")
    back = _winner(tally(none)).select(
        *P,
        F.col("b.key").alias("winning_key"),
        (-F.col("b.v")).alias("winning_votes"),
        F.lit(None).cast("double").alias("winning_centroid"),
        F.col("b.first_idx").alias("selected_idx"),
    )
    return got.unionByName(back)


def vote_weights(
    rows: DataFrame, weight_method: str = "linear", penalty: float = -1.0, temperature: float = 1.0, keys: Sequence[str] = P
) -> DataFrame:
    """V-13: weights from flagged centroids (`is_outlier`), positives normalised to one per problem."""
    keys = list(keys)
    ok = ~F.col("is_outlier")
    c = F.col("centroid")
    rows = with_group(rows, keys, lo=F.min(F.when(ok, c)), hi=F.max(F.when(ok, c)), n=F.count(F.lit(1)))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    raw = {
        "linear": 1.0 - (c - F.col("lo")) / span,
        "inverse": 1.0 / (c + 0.01),
        "exponential": F.exp(-c * temperature),
    }.get(weight_method, F.lit(1.0))
    rows = rows.withColumn("w0", F.when(F.col("lo").isNull(), 1.0 / F.col("n")).when(ok, raw).otherwise(float(penalty)))
    rows = with_group(rows, keys, pos=F.sum(F.when(F.col("w0") > 0, F.col("w0")).otherwise(0.0)))
    norm = F.when((F.col("w0") > 0) & (F.col("pos") > 0) & F.col("lo").isNotNull(), F.col("w0") / F.col("pos"))
    return rows.withColumn("weight", F.coalesce(norm, F.col("w0"))).drop("lo", "hi", "n", "w0", "pos")


def weighted_centroid_vote(
    rows: DataFrame,
    outlier_method: str = "none",
    threshold: float = 0.1,
    num_std: float = 1.0,
    weight_method: str = "linear",
    penalty: float = -1.0,
    temperature: float = 1.0,
) -> DataFrame:
    """V-14: largest total weight (first seen on ties), then the winner's smallest centroid."""
    valid = rows.filter("centroid IS NOT NULL").withColumn("key", answer_key(F.col("extracted_answer")))
    flagged = stage(outliers(valid, outlier_method, threshold, num_std))  # read once per pass of the weights
    valid = vote_weights(flagged, weight_method, penalty, temperature)
    per = valid.groupBy(*P, "key").agg(
        F.round(F.sum("weight"), 12).alias("w"), F.min("traj_idx").alias("f"), F.min(F.struct("centroid", "traj_idx")).alias("m")
    )
    win = per.groupBy(*P).agg(_best((-F.col("w")).alias("w"), "f", "key", "m").alias("b"))
    first = rows.groupBy(*P).agg(F.min("traj_idx").alias("i0"))
    return first.join(win, P, "left").select(
        *P,
        F.col("b.key").alias("winning_key"),
        (-F.col("b.w")).alias("winning_weight"),
        F.coalesce("b.m.traj_idx", "i0").alias("selected_idx"),
    )


# --- by confidence ------------------------------------------------------------------------


def weighted_majority(rows: DataFrame, weight: str, keys: Sequence[str] = P) -> DataFrame:
    """V-16: raw answers (null never votes) by summed weight; ties to the first seen."""
    keyed = rows.filter("extracted_answer IS NOT NULL").withColumn("key", F.col("extracted_answer"))
    votes = tally(keyed, F.col(weight), keys).withColumn("votes", F.round("votes", 12))
    return _winner(votes, keys).select(*keys, F.col("b.key").alias("answer"), (-F.col("b.v")).alias("weight"))


def seven_votes(traces: DataFrame, share: float = 0.1) -> DataFrame:
    """V-17: seven voting methods as one grouped vote over (method, weight) rows."""
    valid = traces.filter("extracted_answer <> ''")
    cut = group_percentiles(valid, P, "tail_confidence", {"tail_cut": 1 - share}).join(
        group_percentiles(valid, P, "bottom_window_confidence", {"bottom_cut": 1 - share}), P
    )
    c = F.col
    t, b = c("tail_confidence"), c("bottom_window_confidence")
    options = F.array(
        F.struct(F.lit("majority").alias("method"), F.lit(1.0).alias("w"), F.lit(None).cast("double").alias("conf")),
        *[
            F.struct(F.lit(n).alias("method"), m.alias("w"), m.alias("conf"))
            for n, m in [
                ("mean_confidence_weighted", c("mean_confidence")),
                ("tail_confidence_weighted", t),
                ("bottom_window_weighted", b),
                ("min_window_weighted", c("min_window_confidence")),
                ("top10_tail_filtered", F.when(t >= c("tail_cut"), t)),
                ("top10_bottom_window_filtered", F.when(b >= c("bottom_cut"), b)),
            ]
        ],
    )
    rows = valid.join(cut, P).select(*P, "traj_idx", "extracted_answer", F.inline(options)).filter("w IS NOT NULL")
    key = [*P, "method"]
    stats = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("num_votes"), F.avg("conf").alias("confidence"), F.max("w").alias("top"))
    return stats.filter("top > 0").join(weighted_majority(rows, "w", key), key).select(*key, "answer", "num_votes", "confidence")


def online_vote(traces: DataFrame, measure: str = "min_conf") -> DataFrame:
    """V-18 on the rows of C-13: warm-up at or above the bar plus final traces not stopped, weighted."""
    keep = F.when(F.col("phase") == "warmup", F.col(measure) >= F.col("conf_bar")).otherwise(~F.col("stopped"))
    return weighted_majority(traces.filter(keep & (F.col("extracted_answer") != "")), measure)


def confidence_report(rows: DataFrame, measure: str, n: int = 5) -> DataFrame:
    """V-19: best and top-n by confidence, spread of the problem's confidences, number correct."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*P).orderBy(F.col(measure).desc(), "traj_idx")
    top = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    tops = top.groupBy(*P).agg(
        F.min_by("traj_idx", "r").alias("selected_idx"),
        F.min_by("is_correct", "r").alias("selected_correct"),
        F.count_if("is_correct").alias("top_n_correct"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "traj_idx"))), lambda x: x["traj_idx"].cast("string")), ",").alias("top_n"),
    )
    stats = rows.groupBy(*P).agg(
        F.avg(measure).alias("mean_conf"),
        F.stddev_pop(measure).alias("std_conf"),
        F.min(measure).alias("min_conf"),
        F.max(measure).alias("max_conf"),
        F.count_if("is_correct").alias("n_correct"),
        F.count(F.lit(1)).alias("n_total"),
    )
    return stats.join(tops, P)


def best_of_n(rows: DataFrame, measure: str, ns: Sequence[int], labelled: DataFrame | None = None) -> DataFrame:
    """V-20: for each N, the most confident of the first N (first on ties) and its correctness."""
    grid = F.filter(F.array(*[F.lit(int(n)) for n in ns]), lambda n: F.col("traj_idx") < n)
    src = rows if labelled is None else rows.join(labelled.select(*P).distinct(), P, "left_semi")
    per = src.withColumn("n", F.explode(grid)).groupBy("n", *P).agg(
        _best((-F.col(measure)).alias("c"), "traj_idx", "is_correct").alias("b")
    )
    ok = F.coalesce("b.is_correct", F.lit(False))
    return per.groupBy("n").agg(
        F.avg(ok.cast("double")).alias("pass_at_1"), F.count_if(ok).alias("correct"), F.count(F.lit(1)).alias("total")
    )


def best_answered(rows: DataFrame, measure: str, n: int) -> DataFrame:
    """V-21: trajectories without an answer score -1e9."""
    c = F.when(F.col("extracted_answer").isNull(), -1e9).otherwise(F.col(measure))
    b = rows.filter(F.col("traj_idx") < n).groupBy(*P).agg(_best((-c).alias("c"), "traj_idx").alias("b"))
    return b.select(*P, F.col("b.traj_idx").alias("selected_idx"), (-F.col("b.c")).alias("confidence"))


def borda(rows: DataFrame, measure: str, n: int, power: float = 0.5) -> DataFrame:
    """V-22: points (N - rank)^power by confidence rank, summed per answer onto its first appearance."""
    src = ranked(rows.filter(F.col("traj_idx") < n), P, measure, [F.col("traj_idx")], "r", True, "m")
    src = src.withColumn("points", F.pow(F.col("m") - F.col("r"), F.lit(float(power))))
    votes = tally(src.filter("extracted_answer IS NOT NULL").withColumn("key", F.col("extracted_answer")), F.col("points"))
    win = _winner(votes.withColumn("votes", F.round("votes", 9)))
    first = src.groupBy(*P).agg(F.min("traj_idx").alias("i0"))
    return first.join(win, P, "left").select(
        *P, F.coalesce("b.first_idx", "i0").alias("selected_idx"), F.coalesce(-F.col("b.v"), F.lit(0.0)).alias("borda_votes")
    )


def last_response_index(judge_text: Column, n: Column) -> Column:
    """V-23: the last `Response k` in a judge's text; missing or out of range is 0."""
    k = F.try_element_at(F.regexp_extract_all(judge_text, F.lit(r"Response (\d+)"), F.lit(1)), F.lit(-1)).try_cast("int")
    return F.when((k >= 0) & (k < n), k).otherwise(0)


def answerable_pick(picks: DataFrame, rows: DataFrame) -> DataFrame:
    """V-24: a pick without answer is replaced by the first trajectory that has one."""
    has = F.col("extracted_answer").isNotNull()
    agg = rows.join(picks, P).groupBy(*P, "pick").agg(
        F.max((F.col("traj_idx") == F.col("pick")) & has).alias("ok"), F.min(F.when(has, F.col("traj_idx"))).alias("first_ok")
    )
    return agg.select(*P, F.when(F.col("ok"), F.col("pick")).otherwise(F.coalesce("first_ok", "pick")).alias("selected_idx"))


def random_expectation(evals: DataFrame) -> DataFrame:
    """V-25: mean over problems of the share correct."""
    per = evals.groupBy(*P).agg(F.avg(F.col("is_correct").cast("double")).alias("a"))
    return per.agg(F.avg("a").alias("random_pass_at_1"), F.count(F.lit(1)).alias("problems"))


def oracle_expectation(evals: DataFrame) -> DataFrame:
    """V-26: share of problems with any correct trajectory."""
    per = evals.groupBy(*P).agg(F.max("is_correct").alias("any_ok"))
    return per.agg(F.avg(F.col("any_ok").cast("double")).alias("oracle_pass_at_1"), F.count_if("any_ok").alias("correct"), F.count(F.lit(1)).alias("problems"))


def first_answered(rows: DataFrame, n: int) -> DataFrame:
    """V-27: first of the first N trajectories that yields an answer."""
    a = F.when(F.col("extracted_answer").isNotNull(), F.col("traj_idx"))
    b = rows.filter(F.col("traj_idx") < n).groupBy(*P).agg(
        F.min(a).alias("selected_idx"), F.min_by("extracted_answer", a).alias("answer"), F.min_by("is_correct", a).alias("ok")
    )
    return b.withColumn("is_correct", F.coalesce("ok", F.lit(False))).drop("ok")


def any_of_n(rows: DataFrame, n: int) -> DataFrame:
    """V-28: best-of-N by any match."""
    per = rows.filter(F.col("traj_idx") < n).groupBy(*P).agg(F.max("is_correct").alias("ok"))
    return per.agg(F.avg(F.col("ok").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("problems"))


def parameter_grid(spark, **lists: Sequence) -> DataFrame:
    """V-29: every combination of the given parameter lists as a small table."""
    df = None
    for name, values in lists.items():
        col = spark.createDataFrame([(v,) for v in values], [name])
        df = col if df is None else df.crossJoin(F.broadcast(col))  # literal lists of a few values
    return df


def most_confident_output(rows: DataFrame, measure: str, n: int, output: str) -> DataFrame:
    """V-30: the output text of the most confident of the first N."""
    b = rows.filter(F.col("traj_idx") < n).groupBy(*P).agg(
        F.min_by(F.struct("traj_idx", output), F.struct((-F.col(measure)).alias("c"), "traj_idx")).alias("b")
    )
    return b.select(*P, F.col("b.traj_idx").alias("selected_idx"), F.col(f"b.{output}").alias(output))
