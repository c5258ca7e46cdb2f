"""Confidence of traces: token means, tails, sliding windows, filters (C-04 .. C-14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spread import CHUNK, group_percentiles, numbered, position_chunk, ranked, with_group

T = ["traj_id"]


def token_confidence(cands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C-04 long form: minus the mean log-probability per position, half-even at 3 digits."""
    return cands.groupBy(*keys).agg(F.bround(F.round(-F.avg("logprob"), 9), 3).alias("conf"))


def indexed(confs: DataFrame) -> DataFrame:
    """Dense 0-based index i of the tokens that have a confidence, and their number n per trace."""
    return numbered(confs, T, [F.col("position")], position_chunk("position"), "i", total="n")


def sized(confs: DataFrame) -> DataFrame:
    return confs if "n" in confs.columns else with_group(confs, T, n=F.count(F.lit(1)))


def mean_confidence(confs: DataFrame) -> DataFrame:
    """C-06."""
    return confs.groupBy(*T).agg(F.avg("conf").alias("mean_confidence"))


def tail_confidence(confs: DataFrame, tail: int = 2048) -> DataFrame:
    """C-07; rows need i and n."""
    return confs.filter(F.col("i") >= F.col("n") - tail).groupBy(*T).agg(F.avg("conf").alias("tail_confidence"))


def window_means(confs: DataFrame, window: int = 2048, chunk: int | None = None) -> DataFrame:
    """C-08: means of every full window of `window` tokens (unrounded).

    A trajectory of more than `chunk` tokens is cut into chunks; a chunk also gets the
    last window-1 tokens of the one before, so windows that cross its border are
    whole and the trajectory spreads over tasks. Inside, a window is the difference
    of two running sums: O(n), not O(n w).
    """
    chunk = chunk or max(CHUNK, 8 * window)
    if chunk < window:
        raise ValueError("chunk must be at least as long as the window")
    if "n" in confs.columns:
        long = confs.filter(F.col("n") > chunk)
        short = _window_means(confs.filter(F.col("n") <= chunk).select("traj_id", "i", "conf", "n"), window, W.partitionBy("traj_id"))
        short = short.filter(F.col("i") >= window - 1).select("traj_id", "i", "n", F.col("m").alias("window_mean"))
        return short if long.isEmpty() else short.unionByName(_chunk_means(long, window, chunk))
    return _chunk_means(confs, window, chunk)


def _window_means(rows: DataFrame, window: int, by) -> DataFrame:
    w = by.orderBy("i")
    rows = rows.withColumn("s", F.sum("conf").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("m", (F.col("s") - F.coalesce(F.lag("s", window).over(w), F.lit(0.0))) / window)


def _chunk_means(confs: DataFrame, window: int, chunk: int) -> DataFrame:
    own = position_chunk("i", chunk)
    near_end = F.col("i") % chunk >= chunk - window + 1
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    keep = ["n"] if "n" in confs.columns else []
    rows = confs.select("traj_id", "i", "conf", *keep, F.explode(homes).alias("c"))
    rows = _window_means(rows, window, W.partitionBy("traj_id", "c"))
    full = (F.col("i") >= window - 1) & (own == F.col("c"))
    return rows.filter(full).select("traj_id", "i", *keep, F.col("m").alias("window_mean"))


def least_grouped(confs: DataFrame, window: int = 2048) -> DataFrame:
    """C-08: smallest window mean rounded at 3; shorter traces give their plain mean."""
    m = window_means(confs, window).groupBy(*T).agg(F.min(F.bround(F.round("window_mean", 9), 3)).alias("least"))
    return _or_mean(confs, m, "least", "min_conf")


def _or_mean(confs: DataFrame, got: DataFrame, col: str, name: str) -> DataFrame:
    return mean_confidence(confs).join(got, T, "left").select(
        *T, F.coalesce(F.col(col), F.col("mean_confidence")).alias(name)
    )


def bottom_windows(confs: DataFrame, window: int = 2048, share: float = 0.1) -> DataFrame:
    """C-09: mean of the lowest max(1, floor(m share)) window means."""
    low = _lowest_windows(confs, window, share)
    return _or_mean(confs, low.groupBy(*T).agg(F.avg("window_mean").alias("low")), "low", "bottom_window_confidence")


def _lowest_windows(confs: DataFrame, window: int, share: float) -> DataFrame:
    m = ranked(window_means(confs, window), T, "window_mean", [F.col("i")], "r", total="m")
    return m.filter(F.col("r") < F.greatest(F.lit(1), F.floor(F.col("m") * F.lit(share))))


def min_window(confs: DataFrame, window: int = 2048) -> DataFrame:
    """C-10."""
    m = window_means(confs, window).groupBy(*T).agg(F.min("window_mean").alias("low"))
    return _or_mean(confs, m, "low", "min_window_confidence")


def all_confidences(confs: DataFrame, window: int = 2048, tail: int = 2048, share: float = 0.1) -> DataFrame:
    """C-11: the four confidences per trace; window means are ranked once for both window measures."""
    confs = sized(confs)
    base = confs.groupBy(*T).agg(
        F.count(F.lit(1)).alias("num_tokens"),
        F.avg("conf").alias("mean_confidence"),
        F.avg(F.when(F.col("i") >= F.col("n") - tail, F.col("conf"))).alias("tail_confidence"),
    )
    low = _lowest_windows(confs, window, share).groupBy(*T).agg(F.avg("window_mean").alias("b"), F.min("window_mean").alias("l"))
    return base.join(low, T, "left").select(
        *T,
        "num_tokens",
        "mean_confidence",
        "tail_confidence",
        F.coalesce("b", "mean_confidence").alias("bottom_window_confidence"),
        F.coalesce("l", "mean_confidence").alias("min_window_confidence"),
    )


def top_confidence(traces: DataFrame, measure: str, share: float = 0.1) -> DataFrame:
    """C-12: traces at or above the (1-share) percentile of their problem."""
    cut = group_percentiles(traces, ["problem_id"], measure, {"cut": 1.0 - share})
    return traces.join(cut, "problem_id").filter(F.col(measure) >= F.col("cut")).drop("cut")


def online_stops(traces: DataFrame, warmup: int, eta: float, measure: str = "min_conf") -> DataFrame:
    """C-13: threshold from the warm-up traces of a problem; later traces below it are stopped."""
    is_warm = F.col("traj_idx") < warmup
    bar = group_percentiles(traces.filter(is_warm), ["problem_id"], measure, {"conf_bar": (100.0 - eta) / 100.0})
    late = ~is_warm & (F.col(measure) < F.col("conf_bar"))
    return traces.join(bar, "problem_id").withColumns(
        {"phase": F.when(is_warm, "warmup").otherwise("final"), "stopped": late}
    )


def self_certainty(rows: DataFrame, keys: Sequence[str], vocabulary: int) -> DataFrame:
    """C-14: masked mean over output tokens of -logprob_sum / V - ln V."""
    import math

    per = -F.col("logprob_sum") / vocabulary - math.log(vocabulary)
    return rows.groupBy(*keys).agg((F.sum(F.col("mask") * per) / F.nullif(F.sum("mask"), F.lit(0))).alias("self_certainty"))
