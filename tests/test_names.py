"""Extension points by name and from SQL, adapters over several layouts, and checked reuse of results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spoor import registry
from spoor.operators import phases
from spoor.sources import adapters, layout


def test_post_processors(spark):
    df = spark.createDataFrame([("x ", False, False, 3)], "extracted_answer string, error boolean, is_correct boolean, round int")
    assert registry.process(df, "self-correction", max_rounds=3).first()["status"] == "max_rounds"
    assert registry.process(df, "unknown") is df and registry.process(df, None) is df
    with pytest.raises(TypeError):
        registry.process(df, 7)
    with pytest.raises(ValueError):
        registry.post_processor("normalised")(lambda rows: rows)


def test_phase_rows_over_several_batches(spark):
    """Trajectories longer than an Arrow batch, nulls, and one without any entropy."""
    r = random.Random(3)
    rows = [(f"t{t}", p, None if r.random() < 0.1 or t == 4 else round(r.random() * 5, 3)) for t in range(5) for p in range(150 + 40 * t)]
    t = spark.createDataFrame(rows, "traj_id string, position int, entropy double")
    marked = t.join(phases.thresholds(t, 30.0, 60.0), "traj_id", "left")
    registry.register_sql(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 16)
    try:
        got = spark.sql("SELECT * FROM phase_rows(2, TABLE(SELECT * FROM {m}) PARTITION BY traj_id ORDER BY (position))", m=marked).collect()
    finally:
        spark.conf.set(key, before)
    want = phases.phases(t, [(30.0, 60.0, 2)]).select("traj_id", F.col("start").cast("long"), F.col("duration").cast("long")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10


def test_step_rows_edges(spark):
    registry.register_sql(spark)
    rows = [("a", 0, "x", None), ("a", 1, None, True), ("a", 2, "y", False), ("b", 5, "z", True)]
    t = spark.createDataFrame(rows, "traj_id string, position int, token string, is_boundary boolean")
    q = "SELECT * FROM step_rows(TABLE(SELECT * FROM {t}) PARTITION BY traj_id ORDER BY (position))"
    assert sorted(map(tuple, spark.sql(q, t=t).collect())) == [("a", 1, 0, 1, 2, "x"), ("a", 2, 2, 2, 1, "y"), ("b", 1, 5, 5, 1, "z")]
    assert spark.sql(q, t=t.limit(0)).count() == 0


def test_adapter_layouts(spark, tmp_path):
    rows = [{"id": f"p{i}_traj_0", "generated_text": 'a "} , [' + str(i), "reward": 1.0, "extra": i} for i in range(30)]
    for name in ("run_lines", "run_array", "run_parquet", "run_empty", "other"):
        (tmp_path / name).mkdir()
    (tmp_path / "run_lines" / "x.jsonl").write_text("\n".join(map(json.dumps, rows[:10])) + "\n{broken\n")
    (tmp_path / "run_array" / "x.json").write_text("\n " + json.dumps(rows[10:20]))
    (tmp_path / "other" / "x.jsonl").write_text(json.dumps(rows[0]))
    spark.createDataFrame([(r["id"], r["reward"]) for r in rows[20:]], "id string, reward double").write.parquet(f"{tmp_path}/run_parquet", mode="append")
    found = adapters.discover(spark, f"{tmp_path}/*", "^run_")
    assert {k: len(v) for k, v in found.items()} == {"lines": 1, "array": 1, "parquet": 1}
    got = adapters.read(spark, "trajectories", f"{tmp_path}/*", "^run_", 4096)
    assert {(r.run_id, r.n) for r in got.groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {("run_lines", 10), ("run_array", 10), ("run_parquet", 10)}
    assert sorted(r.problem_id for r in got.collect()) == sorted(f"p{i}" for i in range(30))
    assert adapters.read(spark, "problems", f"{tmp_path}/none*").count() == 0
    with pytest.raises(ValueError):
        adapters.register("problems", "id string", lambda rows: rows)


SCHEMA = "traj_id string, centroid double, method string, top double"


def _reuse(spark, path, top, value, schema=SCHEMA, method="hep", analysed=None):
    made = spark.createDataFrame([("a", value), ("b", value)], "traj_id string, centroid double")
    got = layout.reuse(spark, path, schema, {"method": method, "top": top}, lambda: made, analysed).collect()
    return {(r["origin"], r["centroid"]) for r in got}


def test_reuse_checks_parameters(spark, tmp_path):
    path = f"{tmp_path}/kept"
    assert _reuse(spark, path, 5.0, 0.1) == {("computed", 0.1)}
    assert _reuse(spark, path, 5.0, 0.2) == {("cache", 0.1)}
    assert _reuse(spark, path, 6.0, 0.3) == {("computed", 0.3)}  # another parameter set is made anew
    part = spark.createDataFrame([("a", 0.9, "hep", 5.0)], SCHEMA)
    layout.write_results(part, path, ["method", "top"])  # half a write
    assert _reuse(spark, path, 7.0, 0.5) == {("computed", 0.5)}  # whose manifest says nothing about the half one
    assert _reuse(spark, path, 5.0, 0.4) == {("computed", 0.4)}
    assert _reuse(spark, path, 6.0, 0.8) == {("cache", 0.3)}
    wider = SCHEMA.replace("centroid double", "centroid double, num_heps int")
    assert not layout.reusable(spark, path, wider, {"method": "hep", "top": 6.0})
    analysed = spark.createDataFrame([("a", 0.7, 9.0)], "traj_id string, centroid double, top double")
    assert _reuse(spark, path, 9.0, 0.6, analysed=analysed) == {("analysis", 0.7)}
    assert _reuse(spark, path, 9.0, 0.6, method="raw_entropy", analysed=analysed) == {("computed", 0.6)}
