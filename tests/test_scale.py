"""Steps whose cost must follow the input: what travels, and what one task holds."""

from pyspark.sql import functions as F

from spoor.operators import agent, confidence, corpus, entropy, phases, spread

CALL = "run_id long, name string, arguments map<string,string>"
GOLD = "run_id long, action_id string, name string, arguments map<string,string>, compare_args array<string>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_action_matches_do_not_gather_a_tool_in_one_task(spark):
    calls = spark.createDataFrame([(1, "t", {"q": "1"})], CALL)
    golden = spark.createDataFrame([(1, "a", "t", {"q": "1"}, ["q"]), (1, "b", "t", {"q": "1"}, None)], GOLD)
    got = plan(agent.action_matches(golden, calls))
    assert got.count("strategy=broadcast") >= 2


def test_action_matches_tell_nulls_and_missing_arguments_apart(spark):
    calls = [
        (1, "t", {"q": "s", "s": None}), (2, "t", {"q": "s"}), (3, "t", {}), (4, "t", None), (5, None, {"q": "s"}), (6, "t", {"q": "", "s": "s"}),
    ]
    golden = [
        (1, "same", "t", {"q": "s", "s": None}, ["s", "q"]), (1, "moved", "t", {"q": None, "s": "s"}, ["s", "q"]), (1, "own", "t", {"q": "s", "s": None, "x": "1"}, None),
        (2, "short", "t", {"q": "s", "s": None}, ["q", "s"]), (2, "cut", "t", {"q": "s", "s": "1"}, ["q"]), (3, "empty", "t", {"q": "s"}, None),
        (4, "none", "t", {}, []), (5, "nameless", None, {"q": "s"}, ["q"]), (6, "blank", "t", {"q": None, "s": "s"}, ["q", "s"]),
    ]
    rows = agent.action_matches(spark.createDataFrame(golden, GOLD), spark.createDataFrame(calls, CALL)).collect()
    assert {r.action_id for r in rows if r.action_match} == {"same", "own", "cut", "empty"} and len(rows) == len(golden)


def test_gram_summary_makes_no_row_per_gram(spark):
    docs = spark.createDataFrame([(1, "b a b a b"), (2, "x"), (3, None), (4, "z y x"), (4, "c c c")], "doc_id long, text string")
    got = corpus.gram_summary(docs, "doc_id", F.col("text"), 2)
    rows = corpus.gram_rows(docs, "doc_id", F.col("text"), 2).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_distinct"), F.min("ngram").alias("least"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.collect()} == {(1, 2, "a b"), (4, 3, "c c")}
    assert "partial_min(ngram" not in got._jdf.queryExecution().executedPlan().toString() and "partial_min(least" in got._jdf.queryExecution().executedPlan().toString()


def test_percentiles_of_small_and_large_groups_agree(spark):
    """Small groups are sorted as one list, groups above the limit go by counts; both give the same ranks."""
    rows = [(k, float((i * 7) % n)) for k, n in (("a", 5), ("b", 40), ("c", 41)) for i in range(n)] + [("n", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    ranks = lambda total: [F.floor(total / 2), total - 1]
    want = {("a", 5, 2.0, 4.0), ("b", 40, 20.0, 39.0), ("c", 41, 20.0, 40.0)}
    for limit in (4, 40, 100):
        assert {tuple(r) for r in spread.selected(df, ["k"], "x", ranks, limit).collect()} == want
    assert "sort_array(collect_list" in plan(spread.group_percentiles(df, ["k"], "x", {"m": 0.5}))


def test_reduction_grid_exchanges_no_cells(spark):
    sem = spark.createDataFrame([("a", 0, 0.5), ("a", 2, -1.0), ("a", 9, 3.0), ("b", 7, 1.0), ("c", 1, None), (None, 1, 2.0)], "traj_id string, position int, entropy_reduction double")
    got = entropy.reduction_grid(sem, 3)
    want = {(t, p, 0.5 if (t, p) == ("a", 0) else 0.0) for t in ("a", "b", "c", None) for p in range(3)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 12 and "Join" not in plan(got)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_small_groups_are_numbered_in_one_exchange(spark):
    """Groups up to the limit travel once; cut into chunks they get the same numbers and totals."""
    df = spark.createDataFrame([(k, (i * 7) % n, float(i % 3)) for k, n in (("a", 5), ("b", 40), ("c", 41)) for i in range(n)] + [(None, 1, 1.0)], "k string, i long, x double")
    by = lambda limit: spread.numbered(df, ["k"], [F.col("i")], F.floor(F.col("i") / 7), "r", total="n", limit=limit)
    rank = lambda limit: spread.ranked(df, ["k"], "x", [F.col("i")], "r", True, "n", limit=limit)
    for made in (by, rank):
        whole = {tuple(r) for r in made(100).select("k", "i", "x", "r", "n").collect()}
        assert len(whole) == 86 and {(k, n) for k, _, _, _, n in whole} == {("a", 5), ("b", 40), ("c", 41)}
        for limit in (4, 40):
            assert {tuple(r) for r in made(limit).select("k", "i", "x", "r", "n").collect()} == whole
        assert exchanges(made(100)) == 1
    assert all(r == i for _, i, _, r, _ in by(100).collect())


def test_window_means_of_short_and_long_traces_agree(spark):
    rows = [(t, i, float((i * 5) % 11), n) for t, n in ((1, 3), (2, 8), (3, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "traj_id long, i long, conf double, n long")
    whole = confidence.window_means(df, 4, 64)
    got = lambda d: {(r.traj_id, r.i, round(r.window_mean, 9)) for r in d.collect()}
    assert got(whole) == got(confidence.window_means(df, 4, 8)) == got(confidence.window_means(df.drop("n"), 4, 8)) and whole.count() == 5 + 47
    assert "explode" not in plan(whole)


def test_ordered_scans_call_python_per_part(spark, monkeypatch):
    """Cuts that cross go through the ordered scan: chunks of all trajectories share the calls, and parts and chunks do not change results."""
    rows = [(f"t{t}", p, float((p * (7 + t)) % 11) if p % 9 else None) for t in range(12) for p in range(40)]
    toks = spark.createDataFrame(rows, "traj_id string, position int, entropy double")
    found = []
    for parts, chunk in ((1, 1000), (5, 7), (1024, 7)):
        monkeypatch.setattr(phases, "PARTS", parts)
        got = phases.phases(toks, [(30.0, 80.0, 2)], chunk)
        found.append({tuple(r) for r in got.collect()})
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == {f"t{t}" for t in range(12)}
    assert "part#" in plan(got).split("FlatMapGroupsInPandas")[1]
