"""Steps, semantic groups, degeneration and repetition against direct readings of their rules."""

import math
import random

from pyspark.sql import functions as F

from spoor.functions import probs
from spoor.functions import tokens as tk
from spoor.operators import entropy as en
from spoor.operators import semantic as sem
from spoor.operators import steps as st
from spoor.operators.repetition import _start


def walk(rows, dist, search):
    out, last = [], -dist
    for i, (tok, e, color) in enumerate(rows):
        if e is None or color == "black" or tok.strip(".,;!?0123456789") == "" or i - last < dist:
            continue
        end = next((j for j in range(i, min(i + search, len(rows))) if any(c in ".!?" for c in rows[j][0])), None)
        last = i if end is None else end
        out.append((i, last))
    return out


def test_step_boundaries(spark):
    rng = random.Random(3)
    t = {
        f"t{k}": [
            (rng.choice(["word", "end.", "x", ",", "7"]), rng.choice([None, 1.0, 2.0]), rng.choice(["red", "black", "pink"]))
            for _ in range(rng.choice([1, 40, 200]))
        ]
        for k in range(25)
    }
    df = spark.createDataFrame(
        [(k, i, *r) for k, v in t.items() for i, r in enumerate(v)],
        "traj_id string, position int, token string, entropy double, color string",
    )
    for chunk in (16, 65536):
        got = {}
        for r in st.boundaries(df, 10, 12, chunk).collect():
            got.setdefault(r.traj_id, []).append((r.trigger_position, r.boundary))
        for k, v in t.items():
            assert sorted(got.get(k, [])) == walk(v, 10, 12), (k, chunk)
    b = st.boundaries(df, 10, 12, 16)
    rows = st.steps(df, b, 16).collect()
    for k, v in t.items():
        mine = sorted((r.start_position, r.end_position, r.text) for r in rows if r.traj_id == k)
        assert "".join(x[2] for x in mine) == "".join(r[0] for r in v)
        assert mine[0][0] == 0 and mine[-1][1] == len(v) - 1


def test_entropy_arrays(spark):
    df = spark.createDataFrame([([-1.0, -2.0, -0.5],), ([],), (None,)], "lp array<double>")
    a, b, c = [r[0] for r in df.select(probs.entropy(F.col("lp"), 2)).collect()]
    p = [math.exp(-0.5), math.exp(-1.0)]
    p = [x / sum(p) for x in p]
    assert math.isclose(a, -sum(x * math.log(x) for x in p)) and b == 0.0 and c is None
    conf = df.select(probs.confidence(F.col("lp"))).collect()
    assert conf[0][0] == 1.167 and conf[1][0] is None


def test_semantic_components(spark):
    # 1-2 and 2-3 are close, 1-3 are not: one component through the middle token.
    e = [(1, [1.0, 0.0]), (2, [0.95, 0.31]), (3, [0.81, 0.59]), (4, [-1.0, 0.0])]
    emb = spark.createDataFrame(e, "token_id long, embedding array<double>")
    sets = spark.createDataFrame(
        [("a", 0, "word", 1.2, [1, 2, 3, 4], [0.4, 0.3, 0.2, 0.1]), ("a", 1, "12", 1.0, [1, 2], [0.5, 0.5]), ("a", 2, "w", None, [], [])],
        "traj_id string, position int, token string, entropy double, top_k_token_ids array<long>, top_k_probs array<double>",
    )
    r = {x.position: x for x in sem.semantic_entropy(sets, emb, 0.9).collect()}
    assert r[0].num_groups == 2
    assert math.isclose(r[0].semantic_entropy, -(0.9 * math.log(0.9) + 0.1 * math.log(0.1)))
    assert r[1].is_math_symbol and r[1].semantic_entropy == 1.0 and r[1].num_groups == 2 and r[1].entropy_reduction == 0.0
    assert r[2].semantic_entropy is None and r[2].num_groups == 0


def test_token_predicates(spark):
    rows = [("12a", True), ("\\frac", True), ("e", True), ("word", False), ("  ", False), ("π", True), (" + ", True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.m == r.want for r in df.select("want", tk.is_math_symbol(F.col("t")).alias("m")).collect())
    p = spark.createDataFrame([("...",), ("12",), (" ",), ("a.",)], "t string")
    assert [r[0] for r in p.select(tk.is_punctuation_or_digit(F.col("t"))).collect()] == [True, True, True, False]


def test_degeneration(spark):
    ids = {"a": [1] + [0] * 12, "b": [0] * 9 + [1] + [0] * 9, "c": [0] * 10, "d": [5]}
    df = spark.createDataFrame([(k, i, x) for k, v in ids.items() for i, x in enumerate(v)], "traj_id string, position int, token_id int")
    got = {r.traj_id: r.degenerate_at for r in en.degeneration(df, 10, chunk=4).collect()}
    assert got == {"a": 1, "c": 0}


def brute_repeat(text, shortest=50):
    n = len(text)
    if n < 2 * shortest:
        return -1
    for p in range(shortest, min(500, n // 3), 10):
        for i in range(max(0, n - p * 10), n - 2 * p):
            if i + 3 * p <= n and text[i : i + p] == text[i + p : i + 2 * p] == text[i + 2 * p : i + 3 * p]:
                return i
    return -1


def test_repetition():
    rng = random.Random(5)
    texts = ["", "a" * 400, "x" * 99]
    for _ in range(30):
        unit = "".join(rng.choice("abcdef ") for _ in range(rng.choice([25, 50, 60, 77, 130])))
        texts.append("".join(rng.choice("abc ") for _ in range(rng.randrange(300))) + unit * rng.randrange(1, 7) + "tail" * rng.randrange(3))
    for t in texts:
        assert _start(t, 50) == brute_repeat(t), t
