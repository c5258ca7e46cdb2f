"""Reasoning steps cut at high-entropy tokens (E-14, E-15, E-17, E-18, E-22)."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tok
from ..session import stage
from .spread import CHUNK, position_chunk, running


def triggers(tokens: DataFrame, max_search: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """Banded word tokens with the boundary each would set: the next sentence end in reach, else itself."""
    rows = running(
        tokens.select("traj_id", "position", "token", "entropy", "color"),
        ["traj_id"],
        [F.col("position").desc()],
        -position_chunk("position", chunk),
        maxes={"neg_end": F.when(tok.ends_sentence(F.col("token")), -F.col("position"))},
    )
    reach = -F.col("neg_end") < F.col("position") + max_search
    keep = F.col("entropy").isNotNull() & (F.col("color") != "black") & ~tok.is_punctuation_or_digit(F.col("token"))
    return rows.filter(keep).select(
        "traj_id",
        F.col("position").cast("long").alias("position"),
        "token",
        "entropy",
        F.when(reach, -F.col("neg_end")).otherwise(F.col("position")).cast("long").alias("boundary"),
        position_chunk("position", chunk).alias("chunk"),
    )


def boundaries(tokens: DataFrame, min_distance: int = 100, max_search: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """E-14: accepted triggers, each at least `min_distance` after the previous boundary.

    Which trigger is accepted depends on the one before, so each chunk is first
    reduced to a map "earliest allowed position on entry -> on exit"; the short
    maps are composed per trajectory, then every chunk walks from its own entry.
    """
    cand = stage(triggers(tokens, max_search, chunk))  # a few percent of the tokens, read twice

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        at, nxt = pdf["position"].tolist(), (pdf["boundary"] + min_distance).tolist()
        out = [0] * len(at)
        for i in range(len(at) - 1, -1, -1):
            j = bisect_left(at, nxt[i])
            out[i] = out[j] if j < len(at) else nxt[i]
        last = [i for i in range(len(at)) if i + 1 == len(at) or out[i + 1] != out[i]]
        h = pdf.iloc[0]
        return pd.DataFrame(
            [{"traj_id": h["traj_id"], "chunk": h["chunk"], "upto": [at[i] for i in last], "exit": [out[i] for i in last]}]
        )

    # Only trajectories longer than a chunk need maps; all others enter their one chunk free.
    span = cand.groupBy("traj_id").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    several = cand.join(span.filter("lo < hi"), "traj_id", "left_semi")
    maps = several.groupBy("traj_id", "chunk").applyInPandas(
        exits, "traj_id string, chunk long, upto array<long>, exit array<long>"
    )
    entry = F.aggregate(
        F.array_sort(F.collect_list(F.struct("chunk", "upto", "exit"))),
        F.struct(
            F.lit(-1).cast("long").alias("a"), F.expr("cast(array() as array<struct<chunk:bigint,entry:bigint>>)").alias("o")
        ),
        lambda s, x: F.struct(
            F.coalesce(
                F.get(F.filter(F.arrays_zip(x["upto"], x["exit"]), lambda m: m["upto"] >= s["a"]), F.lit(0))["exit"], s["a"]
            ).alias("a"),
            F.concat(s["o"], F.array(F.struct(x["chunk"].alias("chunk"), s["a"].alias("entry")))).alias("o"),
        ),
        lambda s: s["o"],
    )
    entries = maps.groupBy("traj_id").agg(entry.alias("o")).select("traj_id", F.inline("o"))

    # A chunk bounds the list that is walked, whatever the trajectory's length.
    item = F.struct("position", "boundary", "token", "entropy")
    lists = cand.groupBy("traj_id", "chunk").agg(F.array_sort(F.collect_list(item)).alias("c"))
    lists = lists.join(entries, ["traj_id", "chunk"], "left")
    start = F.struct(
        F.coalesce("entry", F.lit(-1).cast("long")).alias("allowed"),
        F.expr("cast(array() as array<struct<position:bigint,boundary:bigint,token:string,entropy:double>>)").alias("out"),
    )

    def walk(s: Column, x: Column) -> Column:
        ok = x["position"] >= s["allowed"]
        kept = F.struct((x["boundary"] + min_distance).alias("allowed"), F.concat(s["out"], F.array(x)).alias("out"))
        return F.when(ok, kept).otherwise(s)

    got = lists.select("traj_id", F.inline(F.aggregate("c", start, walk, lambda s: s["out"])))
    return got.select(
        "traj_id",
        "boundary",
        F.col("position").alias("trigger_position"),
        F.col("token").alias("trigger_token"),
        F.col("entropy").alias("trigger_entropy"),
    )


def numbered_tokens(tokens: DataFrame, bounds: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Tokens with their step number; a boundary token ends its step."""
    marks = bounds.select("traj_id", F.col("boundary").alias("position"), F.lit(1).alias("is_boundary")).distinct()
    rows = tokens.join(marks, ["traj_id", "position"], "left")
    ends = F.coalesce("is_boundary", F.lit(0))
    out = running(rows, ["traj_id"], [F.col("position")], position_chunk("position", chunk), sums={"upto": ends})
    return out.withColumn("step", (F.col("upto") - ends + 1).cast("long")).drop("upto", "is_boundary")


def steps(tokens: DataFrame, bounds: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """E-15: one row per step with its range, text and trigger.

    Text is joined per (trajectory, step, chunk) and then per step, so a step is
    the only thing that grows, as it does in its output row.
    """
    rows = numbered_tokens(tokens, bounds, chunk).withColumn("c", position_chunk("position", chunk))
    text = lambda key, val: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, val))), lambda x: x[val]), "")
    part = rows.groupBy("traj_id", "step", "c").agg(
        F.min("position").alias("lo"), F.max("position").alias("hi"), text("position", "token").alias("part")
    )
    whole = part.groupBy("traj_id", "step").agg(
        F.min("lo").alias("start_position"), F.max("hi").alias("end_position"), text("c", "part").alias("text")
    )
    b = bounds.withColumnRenamed("boundary", "end_position")
    return whole.join(b, ["traj_id", "end_position"], "left")


def step_entropy(tokens: DataFrame, step_rows: DataFrame, value: str = "entropy", chunk: int = CHUNK) -> DataFrame:
    """E-17: mean value per step over [start, end), 0 when the range holds none.

    Steps tile the trajectory, so the step of a token is a running count of
    starts and the range condition needs no range join.
    """
    starts = step_rows.select("traj_id", F.col("start_position").alias("position"), "step", "end_position")
    rows = tokens.select("traj_id", "position", value).join(starts, ["traj_id", "position"], "left")
    cur = F.when(F.col("step").isNotNull(), F.struct("step", "end_position"))
    rows = rows.withColumn("mark", cur).drop("step", "end_position")
    rows = running(rows, ["traj_id"], [F.col("position")], position_chunk("position", chunk), maxes={"cur": F.col("mark")})
    inside = F.col("position") < F.col("cur.end_position")
    return (
        rows.filter(F.col("cur").isNotNull())
        .groupBy("traj_id", F.col("cur.step").alias("step"))
        .agg(F.coalesce(F.avg(F.when(inside, F.col(value))), F.lit(0.0)).alias("mean_entropy"))
    )


def step_entropy_by_correctness(per_step: DataFrame, evals: DataFrame, by_problem: bool = True) -> DataFrame:
    """E-18 (per problem) and E-22 (overall): mean and deviation per step index and correctness."""
    key = (["problem_id"] if by_problem else []) + ["is_correct", "step"]
    e = evals.select("traj_id", "problem_id", "is_correct")
    return per_step.join(e, "traj_id").groupBy(*key).agg(
        F.avg("mean_entropy").alias("mean"), F.stddev_pop("mean_entropy").alias("std"), F.count(F.lit(1)).alias("n")
    )
