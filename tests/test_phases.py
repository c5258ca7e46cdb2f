"""Phases against a direct reading of the rule, over random and hand-made trajectories."""

import random

import numpy as np

from spoor.operators.phases import phases, running_durations
from spoor.operators.spread import group_percentiles, numbered, ranked, running, value_bucket
from pyspark.sql import functions as F

COMBOS = [(5.0, 50.0, 3), (30.0, 80.0, 2), (20.0, 50.0, 1), (60.0, 70.0, 2), (10.0, 50.0, 3)]


def brute(ent, top, bottom, cons):
    vals = [e for e in ent if e is not None]
    if not vals:
        return [], [0] * len(ent)
    high, low = np.percentile(vals, 100 - top), np.percentile(vals, bottom)
    out, live, start = [], [], None
    length = lows = 0
    for i, e in enumerate(ent):
        if e is None:
            live.append(0)
        elif start is None:
            if e >= high:
                start, length, lows = i, 1, 0
                live.append(1)
            else:
                live.append(0)
        else:
            length += 1
            lows = lows + 1 if e <= low else 0
            if lows >= cons:
                out.append((start, length - cons))
                start = None
                live.append(0)
            else:
                live.append(length)
    if start is not None:
        out.append((start, length))
    return out, live


def trajectories():
    rng = random.Random(7)
    t = {}
    for i in range(30):
        n = rng.choice([1, 2, 5, 30, 80])
        kind = rng.random()
        if kind < 0.3:
            t[f"t{i}"] = [rng.choice([None, 0.0, 1.0, 2.0]) for _ in range(n)]
        else:
            t[f"t{i}"] = [None if rng.random() < 0.1 else rng.expovariate(1.0) for _ in range(n)]
    t["allnull"] = [None, None]
    t["equal"] = [1.0] * 40
    t["zero"] = [0.0] * 25
    t["tail"] = [0.1] * 20 + [5.0]
    return t


def frame(spark, t):
    rows = [(k, i, e) for k, v in t.items() for i, e in enumerate(v)]
    return spark.createDataFrame(rows, "traj_id string, position int, entropy double")


def test_phases_and_running_durations(spark):
    t = trajectories()
    df = frame(spark, t).cache()
    for chunk in (7, 65536):
        got = {}
        combos = COMBOS[:3] if chunk == 7 else COMBOS
        for r in phases(df, combos, chunk).collect():
            got.setdefault((r.traj_id, r.top, r.bottom, r.cons), []).append((r.start, r.duration))
        for k, v in t.items():
            for c in combos:
                assert sorted(got.get((k, *c), [])) == brute(v, *c)[0], (k, c, chunk, v)
    for c in (COMBOS[0], COMBOS[3]):
        got = {(r.traj_id, r.position): r.duration for r in running_durations(df, *c, chunk=7).collect()}
        for k, v in t.items():
            assert [got[(k, i)] for i in range(len(v))] == brute(v, *c)[1], (k, c)


def test_spread_primitives(spark):
    t = trajectories()
    df = frame(spark, t).cache()
    got = {r.traj_id: r for r in group_percentiles(df, ["traj_id"], "entropy", {"a": 0.95, "b": 0.5, "c": 0.1}).collect()}
    for k, v in t.items():
        x = [e for e in v if e is not None]
        if x:
            assert np.allclose([got[k].a, got[k].b, got[k].c], np.percentile(x, [95, 50, 10]), rtol=1e-12)
        else:
            assert k not in got
    whole = group_percentiles(df, [], "entropy", {"m": 0.5}).collect()[0].m
    assert np.isclose(whole, np.median([e for v in t.values() for e in v if e is not None]))
    r = ranked(df.filter("entropy is not null"), ["traj_id"], "entropy", [F.col("position")], "r", descending=True)
    seen = {(x.traj_id, x.position): x.r for x in r.collect()}
    for k, v in t.items():
        order = sorted((i for i, e in enumerate(v) if e is not None), key=lambda i: (-v[i], i))
        assert [seen[(k, i)] for i in order] == list(range(len(order)))
    run = running(df, ["traj_id"], [F.col("position")], F.floor(F.col("position") / 7), {"s": F.col("position")}, {"m": F.col("entropy")})
    for x in run.collect():
        v = t[x.traj_id][: x.position + 1]
        assert x.s == x.position * (x.position + 1) // 2
        assert x.m == max((e for e in v if e is not None), default=None)
    n = numbered(df, ["traj_id"], [F.col("position")], F.floor(F.col("position") / 7), "n")
    assert n.filter("n <> position").count() == 0
    vals = [-5.0, -1e-9, 0.0, 1e-9, 0.5, 3.0, 1e6]
    b = [x[0] for x in spark.createDataFrame([(v,) for v in vals], "v double").select(value_bucket("v")).collect()]
    assert b == sorted(b)
