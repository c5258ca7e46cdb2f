"""Folds over arriving tokens whose state ends: with the last token, or after a time of silence (T-03, T-04, T-05, T-07).

State lies in RocksDB, so it may exceed memory. Trajectories share the state of
their bucket, so that Python is called once per bucket and trigger, not once per
trajectory. A trajectory's state is cleared with the token marked `last`; one
whose end never arrives is dropped after `ttl_ms` of silence. A query with that
clock always plans another batch, so a run over what is available (availableNow)
goes without. Rows of a trigger are gone through in array steps, not token by token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Buckets of trajectories; a stream keeps the number that its checkpoint began with.
BUCKETS = 4096

Step = Callable[[tuple, dict[str, np.ndarray]], tuple[tuple, dict[str, list]]]


def fold(stream: DataFrame, step: Step, out: str, schema: str, start: tuple, order: list[str], ttl_ms: int | None = None) -> DataFrame:
    """`step(state, columns in order) -> (state, output columns)` per trajectory; its state is removed by a row marked `last` or by time."""
    stream.sparkSession.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [x.split()[0] for x in out.split(", ")]

    def keep(states: dict, held: GroupState, now: int) -> None:
        """The bucket's states as they are now; silent ones go, and the clock is set for the next to go."""
        if ttl_ms:
            states = {k: v for k, v in states.items() if v[1] + ttl_ms > now}
        if not states:
            if held.exists:
                held.remove()
            return
        held.update(([(k, seen, *s) for k, (s, seen) in states.items()],))
        if ttl_ms:
            held.setTimeoutDuration(max(1, min(v[1] for v in states.values()) + ttl_ms - now))

    def run(key: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.getCurrentProcessingTimeMs() if ttl_ms else 0
        states = {r[0]: (tuple(r[2:]), r[1]) for r in held.get[0]} if held.exists else {}
        if held.hasTimedOut:
            keep(states, held, now)
            return
        batch = pd.concat(list(chunks)).sort_values(["traj_id", *order])  # one trigger of one bucket; the trigger bounds it
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        ids = columns["traj_id"]
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        found: dict[str, list] = {c: [] for c in names}
        for a, z in zip(cuts, cuts[1:]):
            traj = ids[a]
            old = states.pop(traj, None)
            if old is not None and ttl_ms and old[1] + ttl_ms <= now:
                old = None  # its time was over before the clock rang
            rows = {c: v[a:z] for c, v in columns.items()}
            state, got = step(old[0] if old else start, rows)
            if not rows["last"].any():
                states[traj] = (state, now)
            if got:
                n = len(next(iter(got.values())))
                found["traj_id"] += [traj] * n
                for c, v in got.items():
                    found[c] += list(v)
        keep(states, held, now)
        if found["traj_id"]:
            yield pd.DataFrame(found)

    rows = stream.withColumn("bucket", F.pmod(F.xxhash64("traj_id"), F.lit(BUCKETS)))
    kind = ",".join(x.replace(" ", ":", 1) for x in schema.split(", "))
    state = f"held array<struct<traj_id:string,seen:bigint,{kind}>>"
    clock = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("bucket").applyInPandasWithState(run, out, state, "append", clock)


def early_stop(stream: DataFrame, window: int, ttl_ms: int | None = None) -> DataFrame:
    """T-03/T-04: rows traj_id, position, conf, threshold, last. One event per trajectory, at the first full window whose mean lies below the threshold.

    Between triggers a trajectory keeps the last window - 1 values, and nothing but a mark once it has stopped.
    """

    def step(state: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, list]]:
        buf, done = state
        if done:
            return ([], True), {}
        x = np.concatenate([buf, rows["conf"]]) if len(buf) else rows["conf"].astype(float)
        if len(x) < window:
            return (x.tolist(), False), {}
        sums = np.concatenate([[0.0], np.cumsum(x)])
        # a mean belongs to the row that its window ends with; what was kept is shorter than a window
        means = (sums[window:] - sums[:-window]) / window
        first = window - 1 - len(buf)
        low = np.flatnonzero(means < rows["threshold"][first:])
        if not len(low):
            return (x[len(x) - window + 1 :].tolist(), False), {}
        return ([], True), {"stopped_at": [int(rows["position"][first + low[0]])], "window_mean": [float(means[low[0]])]}

    return fold(stream, step, "traj_id string, stopped_at long, window_mean double", "buf array<double>, done boolean", ([], False), ["position"], ttl_ms)


def merged_turns(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """T-05: rows traj_id (the run), turn, position, last; positions continue over the turns as they arrive."""

    def step(state: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, list]]:
        offset, turn, top = (int(v) for v in state)
        turns = rows["turn"]
        first = np.concatenate([[0], np.flatnonzero(turns[1:] != turns[:-1]) + 1])
        tops = []
        for t, n in zip(turns[first].tolist(), (np.maximum.reduceat(rows["position"], first) + 1).tolist()):  # a few turns a trigger
            if t != turn:
                offset, turn, top = offset + top, int(t), 0
            top = max(top, int(n))
            tops.append(offset)
        at = rows["position"] + np.repeat(tops, np.diff([*first.tolist(), len(turns)]))
        return (offset, turn, top), {"turn": turns.tolist(), "position": at.tolist()}

    return fold(stream, step, "traj_id string, turn long, position long", "offset long, turn long, top long", (0, -1, 0), ["turn", "position"], ttl_ms)


def live_degeneration(stream: DataFrame, threshold: int = 10, ttl_ms: int | None = None) -> DataFrame:
    """T-07: rows traj_id, position, token_id, last; the first run of `threshold` zero token ids, reported once when it is reached."""

    def step(state: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, dict[str, list]]:
        begin, n, done = int(state[0]), int(state[1]), bool(state[2])
        if done:
            return (begin, n, True), {}
        zero, at = rows["token_id"] == 0, rows["position"]
        place = np.arange(len(zero))
        broken = np.maximum.accumulate(np.where(zero, -1, place))  # the last row before this that ends a run
        length = np.where(broken >= 0, place - broken, place + 1 + n)
        hit = np.flatnonzero(zero & (length >= threshold))
        first = lambda i: int(at[broken[i] + 1]) if broken[i] >= 0 or n == 0 else begin
        if len(hit):
            return (-1, 0, True), {"degenerate_at": [first(hit[0])]}
        end = len(zero) - 1
        return ((first(end), int(length[end]), False) if zero[end] else (-1, 0, False)), {}

    return fold(stream, step, "traj_id string, degenerate_at long", "begin long, n long, done boolean", (-1, 0, False), ["position"], ttl_ms)
