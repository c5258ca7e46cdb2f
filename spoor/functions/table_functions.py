"""Phases and steps as SQL table functions over Arrow batches (U-07).

    SELECT * FROM phase_rows(3, TABLE(marked_tokens) PARTITION BY traj_id ORDER BY (position))
    SELECT * FROM step_rows(TABLE(bounded_tokens) PARTITION BY traj_id ORDER BY (position))

Spark deals the trajectories out and sorts each; a function sees its tokens in
batches and keeps what is open between them: a phase's three counters, or the
tokens of one step, which is the size of its output row. The operators
`phases.phases` and `steps.steps` cut long trajectories over several tasks;
these functions are for SQL users and take each trajectory in one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

PHASES = "traj_id string, start bigint, duration bigint"
STEPS = "traj_id string, step bigint, start_position bigint, end_position bigint, n_tokens bigint, text string"


def _floats(column) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN


class PhaseRows:
    """H-02 of rows with traj_id, position, entropy and the cuts high and low (`phases.thresholds`).

    Null entropies hold their place but do not count; a phase that is open at the
    end is given out with all its tokens. The first argument is the number of
    low tokens in a row that close a phase.
    """

    def __init__(self):
        self.key, self.open, self.start, self.length, self.lows = None, False, -1, 0, 0

    def eval(self, cons, rows: pa.RecordBatch):
        if rows.num_rows == 0:
            return
        cons = cons[0].as_py() if isinstance(cons, (pa.Array, pa.ChunkedArray)) else cons
        self.key = rows.column("traj_id")[0].as_py()
        e, high, low = (_floats(rows.column(c)) for c in ("entropy", "high", "low"))
        held = np.flatnonzero(~np.isnan(e))
        at = rows.column("position").to_numpy(zero_copy_only=False)[held]
        up, down = e[held] >= high[held], e[held] <= low[held]
        opens = np.flatnonzero(up)
        starts, lengths, i = [], [], 0
        while i < len(held):
            if not self.open:
                j = np.searchsorted(opens, i)  # straight to the next token that opens a phase
                if j == len(opens):
                    break
                i = int(opens[j])
                self.open, self.start, self.length, self.lows = True, int(at[i]), 1, 0
            else:
                self.length += 1
                self.lows = self.lows + 1 if down[i] else 0
                if self.lows >= cons:
                    starts.append(self.start)
                    lengths.append(self.length - cons)
                    self.open = False
            i += 1
        yield self._rows(starts, lengths)

    def terminate(self):
        yield self._rows([self.start], [self.length]) if self.open else self._rows([], [])

    def _rows(self, starts, lengths):
        return pa.table({"traj_id": pa.array([self.key] * len(starts), pa.string()), "start": pa.array(starts, pa.int64()), "duration": pa.array(lengths, pa.int64())})


class StepRows:
    """E-15 of rows with traj_id, position, token and is_boundary: the token with the mark ends its step; null marks none."""

    def __init__(self):
        self.key, self.step, self.first, self.last, self.parts = None, 1, None, None, []

    def eval(self, rows: pa.RecordBatch):
        if rows.num_rows == 0:
            return
        self.key = rows.column("traj_id")[0].as_py()
        out = []
        columns = (rows.column(c).to_pylist() for c in ("position", "token", "is_boundary"))
        for position, token, ends in zip(*columns):
            self.first = position if self.first is None else self.first
            self.last = position
            self.parts.append(token or "")
            if ends:
                out.append(self._close())
        yield self._rows(out)

    def terminate(self):
        yield self._rows([self._close()] if self.parts else [])

    def _close(self):
        row = (self.key, self.step, self.first, self.last, len(self.parts), "".join(self.parts))
        self.step, self.first, self.parts = self.step + 1, None, []
        return row

    def _rows(self, rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in STEPS.split(", ")]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def register(spark: SparkSession) -> None:
    spark.udtf.register("phase_rows", F.arrow_udtf(PhaseRows, returnType=PHASES))
    spark.udtf.register("step_rows", F.arrow_udtf(StepRows, returnType=STEPS))
