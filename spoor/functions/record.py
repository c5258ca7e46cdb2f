"""Phases and centroids of one stored trajectory record, without any exchange (H-01 .. H-05, U-07).

A trajectory read from its file is one row with its token array. While it
stays a record, thresholds, phases and centroid are row expressions and nothing
is shuffled. The long-form operators serve token tables and very long traces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile(sorted_values: Column, p: float) -> Column:
    """Linear-interpolated percentile of a sorted array without nulls."""
    at = (F.size(sorted_values) - 1) * F.lit(p / 100.0)
    lo = F.get(sorted_values, F.floor(at).cast("int"))
    hi = F.get(sorted_values, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


def phases(entropy: Column, top: float = 5.0, bottom: float = 50.0, cons: int = 3) -> Column:
    """array<struct<start int, duration long>> of an array of entropies; nulls hold a place but do not count."""
    ordered = F.sort_array(F.filter(entropy, lambda e: e.isNotNull()))
    steps = F.transform(
        entropy, lambda e, i: F.struct(e.alias("e"), i.alias("i"))
    )
    none = F.expr("cast(array() as array<struct<start:int,duration:bigint>>)")
    start = F.struct(
        F.lit(-1).alias("start"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("lows"), none.alias("out"),
        percentile(ordered, 100.0 - top).alias("high"), percentile(ordered, bottom).alias("low"),
    )

    def event(at: Column, n: Column) -> Column:
        return F.array(F.struct(at.alias("start"), n.alias("duration")))

    def step(s: Column, x: Column) -> Column:
        inside = s["start"] >= 0
        lows = F.when(inside & (x["e"] <= s["low"]), s["lows"] + 1).otherwise(0)
        closes = inside & (lows >= cons)
        opens = ~inside & (x["e"] >= s["high"])
        moved = F.struct(
            F.when(closes, -1).when(opens, x["i"]).otherwise(s["start"]).alias("start"),
            F.when(closes, 0).when(opens, 1).when(inside, s["n"] + 1).otherwise(0).cast("long").alias("n"),
            F.when(closes, 0).otherwise(lows).alias("lows"),
            F.when(closes, F.concat(s["out"], event(s["start"], s["n"] + 1 - cons))).otherwise(s["out"]).alias("out"),
            s["high"].alias("high"), s["low"].alias("low"),
        )
        return F.when(x["e"].isNull(), s).otherwise(moved)

    done = lambda s: F.when(s["start"] >= 0, F.concat(s["out"], event(s["start"], s["n"]))).otherwise(s["out"])
    return F.aggregate(steps, start, step, done)


def centroid(events: Column, length: Column, method: str = "weighted_average_center") -> Column:
    half = 2.0 if method == "weighted_average_center" else None
    at = lambda e: e["start"] + (e["duration"] / half if half else F.lit(0))
    moment = F.aggregate(events, F.lit(0.0), lambda a, e: a + e["duration"] * at(e))
    weight = F.aggregate(events, F.lit(0).cast("long"), lambda a, e: a + e["duration"])
    value = moment / length if method == "moment" else moment / F.nullif(weight, F.lit(0)) / length
    return F.when((F.size(events) > 0) & (length > 0), value)
