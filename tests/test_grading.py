"""Mixed-type grading, re-banded runs, failure reports and semantic groups on hand-made rows."""

import itertools
import math
import random

from pyspark.sql import functions as F

from spoor.functions import text as tx
from spoor.operators import agent, entropy, grading, semantic

COLUMNS = "traj_id string, original_id string, generated_text string, task_type string, subtype string, solution string, answer string, final_answer string"


def graded(spark, rows, **k):
    return {r.traj_id: r for r in grading.graded(spark.createDataFrame(rows, COLUMNS), **k).collect()}


def test_rules_truths_and_records(spark):
    rows = [
        ("p_traj_0", None, r"so \boxed{\frac{1}{2}}", "math", None, r"long \boxed{0.5} text", None, None),
        ("p_traj_1", "own", r"\boxed{7}", None, None, "", None, "7"),
        ("p_traj_2", None, "[[ (B) ]]", "choice", "cipher", "B", None, None),
        ("p_traj_3", None, "<answer>[1, 'A']</answer>", "logic", "", '["  1"]', None, None),
        ("p_traj_4", None, "<answer>[1, 'A ']</answer>", "logic", "", "[1,'a']", None, None),
        ("p_traj_5", None, r"\boxed{1}", "math", None, None, None, None),
        ("p_traj_6", None, None, "math", None, "1", None, None),
        ("p_traj_7", None, r"\boxed{42\text{ apples}}", "other", None, "42", None, None),
        ("p_traj_8", None, r"\boxed{3}", "math", None, r"unclosed \boxed{3", None, None),
    ]
    got = graded(spark, rows)
    assert [(got[r[0]].is_correct, got[r[0]].comparison_method) for r in rows] == [
        (True, "numeric"), (True, "exact"), (True, "choice_cipher"), (False, "logic_unknown"), (True, "logic_unknown"),
        (False, "none"), (False, "none"), (True, "exact_cleaned"), (False, "failed"),
    ]
    assert got["p_traj_0"].original_id == "p" and got["p_traj_1"].original_id == "own"
    assert got["p_traj_0"].ground_truth == "0.5" and got["p_traj_1"].ground_truth == "7" and got["p_traj_5"].ground_truth is None
    assert graded(spark, []) == {}


def test_normalised_comparison(spark):
    rows = [("a_traj_0", None, r"\boxed{\dfrac{1}{3} kg}", "math", None, r"\frac{1}{3}", None, None)]
    assert not graded(spark, rows)["a_traj_0"].is_correct and graded(spark, rows, normalise=True)["a_traj_0"].is_correct


def test_steps_equal_the_expression(spark):
    values = ["1", "1.0", "1/2", r"\frac{1}{2}", "0.5", r"\text{x} 5", "5", "", "x", r"2\,", None, "1/0"]
    df = spark.createDataFrame(list(itertools.product(values, values)), "t string, a string")
    out = grading.compared(df, "t", "a").withColumn("want", tx.compare_answers(F.col("t"), F.col("a"))["comparison_method"]).collect()
    assert all(r.method == (None if r.t is None or r.a is None else r.want) for r in out)


def test_rebanded_run(spark):
    rng = random.Random(3)
    rows = [("r", t, p, rng.choice([0.5, rng.random(), None]), 0.0, "red") for t in range(5) for p in range(60)] + [("none", 0, 0, None, None, "black")]
    bands, stats = entropy.rebanded(spark.createDataFrame(rows, "run_id string, turn int, position int, entropy double, percentile double, color string"))
    flat = [(e, t * 60 + p) for r, t, p, e, *_ in rows if r == "r" and e is not None]
    order = {pos: k for k, (_, pos) in enumerate(sorted(flat, key=lambda x: (-x[0], x[1])))}
    got = {r.position: r for r in bands.filter("run_id = 'r'").collect()}
    assert len(got) == 300 and all(math.isclose(got[p].percentile, k / len(flat) * 100) for p, k in order.items())
    by = {r.run_id: r for r in stats.collect()}
    assert by["r"].turns == 5 and by["r"].red + by["r"].pink + by["r"].purple == by["r"].high_entropy_count == sum(k / len(flat) < 0.05 for k in order.values())
    assert by["none"].high_entropy_ratio == 0.0 and by["none"].avg_entropy is None


def test_failure_reports(spark):
    rows = [("m", "air", "default", True, False, None, 0, 0), ("m", "air", "default", False, None, None, 0, 0), ("m", "air", "solo", False, None, None, 0, 0)]
    rows += [("m", "telecom", "default", i == 3, None, None, i, 3) for i in range(4)] + [("m", "telecom", "default", False, None, None, 7, 10)]
    df = spark.createDataFrame(rows, "llm string, domain string, mode string, success boolean, database boolean, communication boolean, num_correct_write_action int, num_write_action int")
    r = agent.check_failures(df).collect()
    assert [(x.domain, x.n, x.db_failures, x.communication_failures) for x in r] == [("air", 2, 1.0, 0.0)]
    # bins as floating-point edges give them: 0.7 lies under the edge 7 * 0.1
    bins = {(x.length_class, x.bin): x.n for x in agent.write_proportions(df).collect()}
    assert bins == {("short", 0): 1, ("short", 3): 1, ("short", 6): 1, ("short", 9): 1, ("long", 6): 1}
    assert ("short", 9) not in {(x.length_class, x.bin) for x in agent.write_proportions(df, failed_only=True).collect()}


def test_entropy_of_positions(spark):
    rows = [(0, i, lp) for i, lp in enumerate([-0.1, -2.0, -3.0])] + [(1, 0, -5.0)] + [(2, i, -2000.0) for i in range(3)]
    got = {r.p: r for r in entropy.position_entropy(spark.createDataFrame(rows, "p int, cand_idx int, logprob double"), ["p"], 2).collect()}
    e = [math.exp(-0.1), math.exp(-2.0)]
    assert math.isclose(got[0].entropy, -sum(x / sum(e) * math.log(x / sum(e)) for x in e)) and got[0].n_candidates == 2
    assert got[1].entropy == 0.0 and math.copysign(1, got[1].entropy) == 1 and got[2].entropy == 0.0


def test_semantic_groups_against_brute_force(spark):
    rng = random.Random(5)
    vectors = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(40)}
    sets = []
    for p in range(60):
        ids = [rng.randrange(44) for _ in range(rng.randint(0, 9))]
        w = [rng.random() + 0.01 for _ in ids]
        sets.append((p % 3, p, "w", 1.0, ids, [x / sum(w) for x in w]))
    emb = spark.createDataFrame(list(vectors.items()), "token_id long, embedding array<double>")
    df = spark.createDataFrame(sets, "traj_id int, position int, token string, entropy double, top_k_token_ids array<long>, top_k_probs array<double>")
    got = {r.position: r for r in semantic.semantic_entropy(df, emb, 0.8).collect()}

    def near(a, b):
        if a == b or a not in vectors or b not in vectors:
            return a == b
        u, v = vectors[a], vectors[b]
        return sum(x * y for x, y in zip(u, v)) / math.hypot(*u) / math.hypot(*v) > 0.8

    for _, p, _, _, ids, probs in sets:
        label = list(range(len(ids)))
        for i, j in itertools.combinations(range(len(ids)), 2):
            if near(ids[i], ids[j]):
                old, new = label[j], label[i]
                label = [new if x == old else x for x in label]
        mass = [sum(q for x, q in zip(label, probs) if x == g) for g in set(label)]
        assert got[p].num_groups == len(mass)
        if ids:
            assert math.isclose(got[p].semantic_entropy, -sum(m * math.log(m) for m in mass), abs_tol=1e-9)
