"""Structured Streaming jobs over arriving results and tokens (T-01 .. T-08)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import fold


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, form: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).format(form)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """T-01: run what is available, once, into Parquet; a restart resumes at the checkpoint."""
    q = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def first_wins(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """T-02: re-emitted ids dropped within the watermark; state older than the delay is freed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def live_phases(stream: DataFrame, cons: int) -> DataFrame:
    """T-06: rows traj_id, position, entropy, high, low, last; emits phases as they close.

    The token marked `last` ends its trajectory: a phase still open is emitted
    with all its tokens, and the state is freed.
    """

    def step(state, rows):
        inside, start, length, lows = bool(state[0]), int(state[1]), int(state[2]), int(state[3])
        starts, durations = [], []
        for p, e, h, lo in zip(*(rows[c].tolist() for c in ("position", "entropy", "high", "low"))):
            if pd.isna(e):
                continue
            if not inside:
                if e >= h:
                    inside, start, length, lows = True, int(p), 1, 0
                continue
            length += 1
            lows = lows + 1 if e <= lo else 0
            if lows >= cons:
                starts.append(start)
                durations.append(length - cons)
                inside, length, lows = False, 0, 0
        if inside and rows["last"].any():
            starts.append(start)
            durations.append(length)
        return (inside, start, length, lows), {"start": starts, "duration": durations} if starts else {}

    return fold(
        stream, step, "traj_id string, start long, duration long", "inside boolean, start long, length long, lows long", (False, -1, 0, 0), ["position"]
    )


def running_votes(stream: DataFrame) -> DataFrame:
    """T-08: votes and accuracy per problem and answer so far."""
    return stream.groupBy("problem_id", "extracted_answer").agg(
        F.count(F.lit(1)).alias("votes"), F.count_if("is_correct").alias("correct")
    )


def tumbling_counts(stream: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """T-08: event-time counts. In append mode a window is given out once the watermark has passed it and is then forgotten, and rows that come later are left out."""
    g = stream.withWatermark(time, delay).groupBy(F.window(time, width), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
