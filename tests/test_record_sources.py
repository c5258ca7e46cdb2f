"""Record-level phases, readers, registry, streaming over several batches, and hot groups."""

import json

from pyspark.sql import functions as F

from spoor import registry
from spoor.functions import counting, keys, record
from spoor.operators import agent, confidence, voting
from spoor.sources import layout, readers
from spoor.streaming import jobs, state
from tests.test_phases import COMBOS, brute, trajectories


def test_record_phases(spark):
    t = {k: v for k, v in trajectories().items()}
    df = spark.createDataFrame(list(t.items()), "traj_id string, e array<double>")
    for c in COMBOS[:3]:
        got = {r.traj_id: [(p.start, p.duration) for p in r.p] for r in df.select("traj_id", record.phases(F.col("e"), *c).alias("p")).collect()}
        assert all(got[k] == brute(v, *c)[0] for k, v in t.items()), c


def test_readers(spark, tmp_path):
    rec = {"id": "a_traj_1", "original_id": "a", "entropy_sequence": [{"token": "x", "token_id": 1, "entropy": 0.5}, {"token": "y", "entropy": None}]}
    (tmp_path / "r.jsonl").write_text(json.dumps(rec) + "\n{broken\n" + json.dumps({**rec, "solution": "last"}) + "\n")
    df = readers.read_lines(spark, str(tmp_path / "r.jsonl")).filter("id IS NOT NULL")
    assert df.count() == 2
    assert [r.solution for r in readers.keep_last(df).collect()] == ["last"]
    rows = readers.token_rows(readers.read_slim(spark, str(tmp_path / "r.jsonl")).filter("id IS NOT NULL").limit(1)).collect()
    assert [(r.traj_id, r.problem_id, r.traj_idx, r.position, r.entropy) for r in rows] == [("a_traj_1", "a", 1, 0, 0.5), ("a_traj_1", "a", 1, 1, None)]
    (tmp_path / "all.json").write_text(json.dumps([rec, rec]))
    assert readers.read_array(spark, str(tmp_path / "all.json")).count() == 2
    c = spark.createDataFrame([("q", '["a","b"]', "[1.0,2.0]")], "question_id string, output string, confidence_list string")
    c.write.parquet(str(tmp_path / "conf"))
    assert [(r.traj_idx, r.output, r.confidence) for r in readers.read_confidence(spark, str(tmp_path / "conf")).collect()] == [(0, "a", 1.0), (1, "b", 2.0)]
    n = layout.nested_outputs(spark.createDataFrame([("p", 1, "b"), ("p", 0, "a")], "p string, i int, t string"), "p", "i", "t")
    assert n.collect()[0].output == ["a", "b"]


def test_ids(spark):
    df = spark.createDataFrame([("bare",), ("a_traj_3",), ("a_traj_b_traj_2",), ("a_traj_x",), ("games_two_words_12_traj_3",)], "id string")
    i = F.col("id")
    got = df.select(keys.trajectory_index(i).alias("k"), keys.problem_id(i).alias("p"), keys.task_between(i, "games_").alias("t")).collect()
    assert [r.k for r in got] == [0, 3, 2, None, 3]
    assert [r.p for r in got][:3] == ["bare", "a", "a"] and got[4].t == "two_words"


def test_estimators(spark):
    df = spark.createDataFrame([(5, 0, 2), (5, 5, 2), (5, 2, 2), (3, 2, 3), (4, 3, 2)], "n long, c long, k long")
    n, c, k = (F.col(x) for x in "nck")
    a = [round(r[0], 9) for r in df.select(counting.pass_at_k(n, c, k)).collect()]
    b = [round(r[0], 9) for r in df.select(counting.pass_hat_k(n, c, k)).collect()]
    assert a == [0.0, 1.0, 0.7, 1.0, 1.0] and b == [0.0, 1.0, 0.1, 0.0, 0.5]
    registry.register_sql(spark)
    assert spark.sql("SELECT round(pass_at_k(5, 2, 2), 9), round(pass_hat_k(4, 3, 2), 9)").first()[:] == (0.7, 0.5)
    assert spark.sql("SELECT count(*) FROM word_ngrams('a b c a b c', 3)").first()[0] == 3


def test_hot_group_votes(spark):
    """A third of the rows in one problem, cut into many chunks: same results as one small group at a time."""
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("problem_id"),
        F.col("id").cast("int").alias("traj_idx"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("traj_id"),
        F.concat(F.lit("A"), (F.col("id") * 7 % 4).cast("string")).alias("extracted_answer"),
        (F.col("id") * 37 % 1009 / 1009.0).alias("centroid"),
    )
    local = {}
    for r in rows.collect():
        local.setdefault(r.problem_id, []).append(r)
    for r in voting.centroid_vote(rows, 10.0).collect():
        mine = sorted(local[r.problem_id], key=lambda x: (x.centroid, x.traj_idx))
        voters = mine[: max(1, len(mine) * 10 // 100)]
        tally = {}
        for v in voters:
            tally.setdefault(v.extracted_answer.lower(), []).append(v)
        best = min(tally.values(), key=lambda g: (-len(g), g[0].centroid, g[0].traj_idx))
        assert (r.winning_votes, r.selected_idx) == (len(best), best[0].traj_idx)


def test_windows_cross_chunks(spark):
    conf = [float(i * 7 % 11) for i in range(200)]
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate(conf)] + [("b", 0, 1.0)], "traj_id string, i long, conf double")
    got = {r.i: r.window_mean for r in confidence.window_means(df, 16, chunk=16).filter("traj_id = 'a'").collect()}
    assert len(got) == 185 and all(abs(got[i] - sum(conf[i - 15 : i + 1]) / 16) < 1e-9 for i in got)


def test_action_edges(spark):
    g = spark.createDataFrame(
        [("r", "1", "f", {"a": "1", "b": "2"}, None), ("r", "2", "f", {"a": "1"}, ["a"]), ("r", "3", "g", {}, []), ("r", "4", "f", {"a": "9"}, ["a"]), ("s", "5", "f", {"a": "1"}, None)],
        "run_id string, action_id string, name string, arguments map<string,string>, compare_args array<string>",
    )
    c = spark.createDataFrame([("r", "f", {"a": "1"}), ("s", "f", {"z": "1"})], "run_id string, name string, arguments map<string,string>")
    got = {r.action_id: r.action_match for r in agent.action_matches(g, c).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": False}


def test_stream_batches(spark, tmp_path):
    """Tokens in several files, one file per trigger: the state carries over."""
    rows = [("t", i, float(i % 5)) for i in range(40)]
    src = tmp_path / "src"
    for k in range(4):
        part = spark.createDataFrame(rows[k * 10 : k * 10 + 10], "traj_id string, position long, conf double")
        part.coalesce(1).write.mode("append").parquet(str(src))
    s = jobs.read_stream(spark, str(src), "traj_id string, position long, conf double", files_per_trigger=1)
    stops = state.early_stop(s.withColumn("threshold", F.when(F.col("position") >= 13, 2.1).otherwise(0.0)).withColumn("last", F.col("position") == 39), 5)
    jobs.append_to(stops, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.traj_id, r.stopped_at) for r in got] == [("t", 13)]
