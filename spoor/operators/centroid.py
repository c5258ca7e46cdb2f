"""Centroids, phase statistics and their comparison by correctness (H-03 .. H-20)."""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phases import Combo, phases
from .spread import CHUNK, group_percentiles

METHODS = ("moment", "weighted_average", "weighted_average_center")


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("traj_id").agg(F.count(F.lit(1)).alias("trajectory_length"))


def phase_summary(found: DataFrame, lens: DataFrame, keys: Sequence[str] = ("traj_id",)) -> DataFrame:
    """H-03..H-05 and H-07 from one pass over the phases."""
    keys = list(keys)
    L = F.col("trajectory_length")
    centre = (F.col("start") + F.col("duration") / 2.0) / L
    w = F.sum("duration")
    rows = found.join(lens, "traj_id").withColumn("centre", centre)
    many = F.count(F.lit(1)) > 1
    return rows.groupBy(*keys, "trajectory_length").agg(
        (F.sum(F.col("duration") * F.col("start")) / L).alias("moment"),
        (F.sum(F.col("duration") * F.col("start")) / w / L).alias("weighted_average"),
        (F.sum(F.col("duration") * (F.col("start") + F.col("duration") / 2.0)) / w / L).alias("weighted_average_center"),
        F.count(F.lit(1)).alias("num_heps"),
        w.alias("total_hep_weight"),
        F.avg("duration").alias("avg_hep_duration"),
        F.min("start").alias("first_hep_position"),
        F.max("start").alias("last_hep_position"),
        F.var_pop("duration").alias("hep_duration_variance"),
        F.stddev_pop("duration").alias("hep_duration_std"),
        F.var_pop("centre").alias("hep_position_variance"),
        F.stddev_pop("centre").alias("hep_position_std"),
        F.when(many, F.max_by("centre", "start") - F.min_by("centre", "start")).otherwise(0.0).alias("hep_spread"),
    )


def raw_centroid(tokens: DataFrame) -> DataFrame:
    """H-06: entropy-weighted mean position, negatives and nulls skipped."""
    e = F.when(F.col("entropy") >= 0, F.col("entropy"))
    total = F.sum(e)
    agg = tokens.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("trajectory_length"),
        F.sum(e * F.col("position")).alias("m"),
        total.alias("total_entropy"),
        F.avg(e).alias("mean_entropy"),
        F.stddev_pop(e).alias("std_entropy"),
        F.min(e).alias("min_entropy"),
        F.max(e).alias("max_entropy"),
        F.count(e).alias("num_valid_tokens"),
    )
    med = group_percentiles(tokens.filter("entropy >= 0"), ["traj_id"], "entropy", {"median_entropy": 0.5})
    return (
        agg.filter("total_entropy > 0")
        .join(med, "traj_id")
        .withColumn("centroid", F.col("m") / F.col("total_entropy") / F.col("trajectory_length"))
        .drop("m")
    )


def centroid_table(
    tokens: DataFrame, combos: Sequence[Combo] = ((5.0, 50.0, 3),), method: str = "weighted_average_center", chunk: int = CHUNK
) -> DataFrame:
    """H-10/H-11: one row per trajectory and parameter set; trajectories without phases keep a null centroid."""
    if method == "raw_entropy":
        got = raw_centroid(tokens).select("traj_id", "centroid", F.lit(0).cast("long").alias("num_heps"))
        keys = lengths(tokens)
        return keys.join(got, "traj_id", "left").withColumn("num_heps", F.lit(0).cast("long"))
    lens = lengths(tokens)
    key = ["traj_id", "top", "bottom", "cons"]
    got = phase_summary(phases(tokens, combos, chunk), lens, key).withColumn("centroid", F.col(method))
    grid = tokens.sparkSession.createDataFrame(
        [(float(t), float(b), int(c)) for t, b, c in combos], "top double, bottom double, cons int"
    )
    every = lens.crossJoin(F.broadcast(grid))  # a few dozen parameter rows
    return every.join(got.drop("trajectory_length"), key, "left").fillna(0, ["num_heps"])


def analysed(centroids: DataFrame, evals: DataFrame) -> DataFrame:
    """H-08: trajectories with a centroid and their correctness; unknown counts as wrong."""
    e = evals.select("traj_id", "problem_id", "traj_idx", "extracted_answer", "is_correct")
    return (
        centroids.filter("centroid IS NOT NULL")
        .join(e, "traj_id", "left")
        .withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))
    )


def summary_counts(rows: DataFrame) -> DataFrame:
    """H-09."""
    ok = F.col("is_correct")
    per = rows.groupBy("problem_id").agg(F.count_if(ok).alias("c"), F.count_if(~ok).alias("w"))
    return per.agg(
        F.sum("c").alias("n_correct_trajectories"),
        F.sum("w").alias("n_incorrect_trajectories"),
        F.count(F.lit(1)).alias("n_problems"),
        F.count_if(F.col("c") > 0).alias("n_problems_with_correct"),
        F.count_if(F.col("w") > 0).alias("n_problems_with_incorrect"),
    )


def compare_groups(rows: DataFrame, measures: Sequence[str], by: str = "is_correct") -> DataFrame:
    """H-16..H-18: count, mean, deviation, extremes and quartiles of each measure per group."""
    long = rows.select(
        by, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures]))
    )
    key = [by, "measure"]
    base = long.groupBy(*key).agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    q = group_percentiles(long, key, "x", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return base.join(q, key, "left")


def group_differences(groups: DataFrame, by: str = "is_correct") -> DataFrame:
    """Correct minus incorrect, means and medians per measure."""
    val = lambda c, ok: F.max(F.when(F.col(by) == ok, F.col(c)))
    return groups.groupBy("measure").agg(
        (val("mean", True) - val("mean", False)).alias("mean_difference"),
        (val("median", True) - val("median", False)).alias("median_difference"),
    )


def problem_categories(rows: DataFrame) -> DataFrame:
    """H-19: for problems with both outcomes. The three smallest centroids come from a bounded top-3."""
    from pyspark.sql import Window as W

    ok = F.col("is_correct")
    stats = rows.groupBy("problem_id").agg(
        F.avg(F.when(ok, F.col("centroid"))).alias("mean_correct"),
        F.avg(F.when(~ok, F.col("centroid"))).alias("mean_incorrect"),
    )
    w = W.partitionBy("problem_id").orderBy("centroid", F.col("is_correct").desc(), "traj_idx")
    top = (
        rows.withColumn("r", F.row_number().over(w))
        .filter(F.col("r") <= 3)
        .groupBy("problem_id")
        .agg(
            F.count_if(~ok).alias("wrong3"),
            F.count(F.lit(1)).alias("n3"),
            F.max((F.col("r") == 1) & ~ok).alias("cat3"),
        )
    )
    return (
        stats.filter("mean_correct IS NOT NULL AND mean_incorrect IS NOT NULL")
        .join(top, "problem_id")
        .select(
            "problem_id",
            (F.col("mean_incorrect") < F.col("mean_correct")).alias("cat1"),
            (F.col("wrong3") > F.col("n3") - F.col("wrong3")).alias("cat2"),
            "cat3",
        )
        .withColumn("cat_all", F.col("cat1") & F.col("cat2") & F.col("cat3"))
    )


def centroid_histogram(rows: DataFrame, edges: int = 20) -> DataFrame:
    """H-20: counts in the edges-1 equal bins of [0, 1]; the last bin is closed."""
    bins = edges - 1
    b = F.least(F.floor(F.col("centroid") * bins), F.lit(bins - 1)).cast("int")
    inside = rows.filter("centroid >= 0 AND centroid <= 1")
    return inside.groupBy("is_correct", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def resampled_curves(durations: DataFrame, lens: DataFrame, points: int = 201) -> DataFrame:
    """H-13: each trajectory's curve at `points` evenly spaced places, linear between tokens.

    Only the tokens next to a grid place are kept: the token at p serves the
    places in [p-1, p+1), computed from p, so no join on positions is needed.
    """
    last = F.lit(points - 1)
    step = (F.col("trajectory_length") - 1) / last  # tokens per grid step
    rows = durations.join(lens, "traj_id")
    p = F.col("position")
    one = F.col("trajectory_length") == 1
    lo = F.when(one, 0).otherwise(F.greatest(F.lit(0), F.ceil((p - 1) / step).cast("int") - 1))
    hi = F.when(one, last).otherwise(F.least(last, F.floor((p + 1) / step).cast("int") + 1))
    at = F.when(one, F.lit(0.0)).otherwise(F.col("t") * step)
    weight = F.greatest(F.lit(0.0), 1 - F.abs(at - p))
    near = rows.filter(lo <= hi).select("traj_id", "position", "duration", "trajectory_length", F.explode(F.sequence(lo, hi)).alias("t"))
    return (
        near.withColumn("w", weight)
        .filter("w > 0")
        .groupBy("traj_id", "t")
        .agg(F.sum(F.col("w") * F.col("duration")).alias("value"))
    )


def mean_curves(curves: DataFrame, evals: DataFrame) -> DataFrame:
    """H-14."""
    e = evals.select("traj_id", "is_correct")
    return curves.join(e, "traj_id").groupBy("is_correct", "t").agg(F.avg("value").alias("mean_duration"))


def smoothed(curve: DataFrame, x: str, y: str, points: int, sigma: float = 5.0) -> DataFrame:
    """H-15: Gaussian smoothing with edge padding of one curve of `points` rows."""
    r = int(3 * sigma)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    kernel = [(i - r, v / sum(raw)) for i, v in enumerate(raw)]
    k = curve.sparkSession.createDataFrame(kernel, "d int, w double")
    grid = curve.select(F.col(x).alias("x0")).crossJoin(F.broadcast(k))
    src = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.col("x0") + F.col("d")))
    joined = grid.withColumn(x, src).join(curve.select(x, y), x)
    return joined.groupBy(F.col("x0").alias(x)).agg(F.sum(F.col("w") * F.col(y)).alias("smooth"))


def correct_minus_incorrect(curves: DataFrame) -> DataFrame:
    v = lambda ok: F.max(F.when(F.col("is_correct") == ok, F.col("mean_duration")))
    return curves.groupBy("t").agg((v(True) - v(False)).alias("difference"))


def score_entropy_mean(tokens: DataFrame) -> DataFrame:
    """C-01."""
    return tokens.groupBy("traj_id").agg(F.coalesce(-F.avg("entropy"), F.lit(0.0)).alias("score"))


def score_entropy_min(tokens: DataFrame) -> DataFrame:
    """C-02."""
    return tokens.groupBy("traj_id").agg(F.coalesce(-F.min("entropy"), F.lit(0.0)).alias("score"))


def score_early_entropy(tokens: DataFrame, percent: float = 30.0) -> DataFrame:
    """C-03: one minus the centroid of the tokens in the top `percent`."""
    cut = group_percentiles(tokens, ["traj_id"], "entropy", {"cut": (100.0 - percent) / 100.0})
    hot: Column = F.when(F.col("entropy") >= F.col("cut"), F.col("entropy"))
    s = tokens.join(cut, "traj_id", "left").groupBy("traj_id").agg(
        F.sum(hot * F.col("position")).alias("m"), F.sum(hot).alias("w"), F.count(F.lit(1)).alias("n")
    )
    return s.select("traj_id", F.when(F.col("w") != 0, 1 - F.col("m") / F.col("w") / F.col("n")).otherwise(0.0).alias("score"))


