"""Streams in several batches: same events as in one pass, and no state is left."""

import random
import uuid

import pytest

from spoor.streaming import jobs, state


def written(spark, path, rows, schema, files):
    """The rows in order of position, as files that arrive one after another."""
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, stream, tmp_path):
    out = f"{tmp_path}/{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.parquet(out), held


@pytest.fixture(scope="module")
def tokens():
    r = random.Random(6)
    rows = []
    for p in range(60):
        for t in range(8):
            if p < 20 + 5 * t:
                rows.append((f"t{t}", p, 2.0 + r.random() - (0.6 if p > 25 and t % 2 else 0), 2.2, r.choice([0, 0, 7]), p == 19 + 5 * t))
    return rows


SCHEMA = "traj_id string, position long, conf double, threshold double, token_id int, last boolean"


def test_early_stop(spark, tmp_path, tokens):
    path = f"{tmp_path}/in"
    written(spark, path, tokens, SCHEMA, 5)
    stream = jobs.read_stream(spark, path, SCHEMA, 1)
    got, held = run(spark, state.early_stop(stream.drop("token_id"), 6), tmp_path)
    want = {}
    for t in {r[0] for r in tokens}:
        c = [r[2] for r in tokens if r[0] == t]
        hit = [i for i in range(5, len(c)) if sum(c[i - 5 : i + 1]) / 6 < 2.2]
        if hit:
            want[t] = (hit[0], pytest.approx(sum(c[hit[0] - 5 : hit[0] + 1]) / 6))
    assert {r.traj_id: (r.stopped_at, r.window_mean) for r in got.collect()} == want and want
    assert len(held) >= 5 and max(held) > 0 and held[-1] == 0


def test_degeneration(spark, tmp_path, tokens):
    path = f"{tmp_path}/in"
    written(spark, path, tokens, SCHEMA, 7)
    stream = jobs.read_stream(spark, path, SCHEMA, 1).select("traj_id", "position", "token_id", "last")
    got, held = run(spark, state.live_degeneration(stream, 4), tmp_path)
    want = {}
    for t in {r[0] for r in tokens}:
        z = "".join("0" if r[4] == 0 else "x" for r in tokens if r[0] == t)
        if "0000" in z:
            want[t] = z.index("0000")
    assert {r.traj_id: r.degenerate_at for r in got.collect()} == want and want
    assert held[-1] == 0


def test_merged_turns(spark, tmp_path):
    rows = [("a", t, p, t == 3 and p == 4) for t in range(4) for p in range(5)] + [("b", 0, 0, False), ("b", 2, 1, True)]
    path = f"{tmp_path}/in"
    written(spark, path, rows, "traj_id string, turn long, position long, last boolean", 4)
    got, held = run(spark, state.merged_turns(jobs.read_stream(spark, path, "traj_id string, turn long, position long, last boolean", 1)), tmp_path)
    assert sorted((r.traj_id, r.turn, r.position) for r in got.collect()) == [("a", t, 5 * t + p) for t in range(4) for p in range(5)] + [("b", 0, 0), ("b", 2, 2)]
    assert held[-1] == 0


def test_trajectories_share_the_state_of_their_bucket(spark, tmp_path, tokens, monkeypatch):
    """Python and the store are called once per bucket and trigger, and results do not turn on the buckets."""
    path = f"{tmp_path}/in"
    written(spark, path, tokens, SCHEMA, 2)
    found = []
    for buckets in (1, 3):
        monkeypatch.setattr(state, "BUCKETS", buckets)
        got, held = run(spark, state.early_stop(jobs.read_stream(spark, path, SCHEMA, 1).drop("token_id"), 6), tmp_path)
        found.append({tuple(r) for r in got.collect()})
        assert 0 < max(held) <= buckets and held[-1] == 0
    assert found[0] == found[1] and found[0]
