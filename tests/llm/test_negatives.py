"""Hard negatives against all scores in plain Python; the index against plain products."""

from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=50, positives=5, k=3):
    v = [(i, l, [floor(256 * float(c)) for c in e]) for i, e, l in rows if i is not None and l is not None and e is not None and all(c is not None and isfinite(c) for c in e)]
    out, seen = [], set()
    for a in v:
        if a[0] % every or str(a) in seen:
            continue
        seen.add(str(a))
        scored = sorted((-sum(p * q for p, q in zip(a[2], b[2])), b[0], b[1]) for b in v if b[0] != a[0])
        for s, p, _ in [x for x in scored if x[2] == a[1]][:positives]:
            fit = [(n, i) for n, i, l in scored if l != a[1] and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a[0], p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit[:k])]
    return sorted(out)


def got(spark, rows):
    df = negatives.mined(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("label"))
    assert df.columns == NAMES
    return sorted(tuple(r) for r in df.collect())


def cloud(n, d=16, seed=3, labels=4):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(labels, d))
    return [(int(i), [float(np.float32(c)) for c in (centres[i % labels] * (i % 3) + g.normal(size=d)) / 4], int(i % labels)) for i in range(n)]


@pytest.mark.parametrize("size", [8192, 64])
def test_equals_all_scores(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "ROWS", size)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = cloud(900)
    want = plain(rows)
    assert got(spark, rows) == want and len(want) > 100


def test_odd_rows(spark):
    one = [0.5] * 4
    rows = [
        (0, one, 1), (0, one, 1), (1, one, 1), (1, one, 1), (2, [0.4] * 4, 2), (2, [0.4] * 4, 2), (3, [0.3, 0.3], 2), (4, [], 1), (5, None, 1), (6, one, None),
        (7, [float("nan")] * 4, 2), (8, [float("inf"), 0.0, 0.0, 0.0], 2), (9, [0.1, None, 0.1, 0.1], 2), (None, one, 2), (50, [-0.5] * 4, 1), (100, [0.0] * 4, 3), (150, [0.9] * 4, 7),
    ]
    assert got(spark, rows) == plain(rows)


def test_equal_vectors_and_columns_that_clash(spark):
    rows = [(i, [0.25, -0.5, 0.75], i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id AS id", "label AS h", "embedding AS x", "1 AS window")
    found = negatives.mined(df, "vec_id", "embedding", F.col("label"), low=100, high=100)
    assert found.count() == 6 * 5 * 3 and {r.negative_id for r in found.collect()} == {1, 3, 5}


def test_empty_table(spark):
    assert got(spark, []) == []


def test_index_reaches_all_and_leaves_out_dimensions():
    g = np.random.default_rng(5)
    x, q = np.round(g.normal(size=(500, 40)) * 100), np.round(g.normal(size=(30, 40)) * 100)
    x *= np.geomspace(1, 0.01, 40).round(2)
    x = np.round(x)
    for share in (0.3, 0.05, -1.0):
        scores = q @ x.T
        least = np.full(len(q), share * scores.max())
        index = negatives.Index(x, negatives._rests(q).max(axis=0), float(least.min()))
        found = {(i, j): s for part in index.reach(q, least) for i, j, s in zip(*map(np.ndarray.tolist, part))}
        assert found == {(i, j): scores[i, j] for i, j in zip(*map(np.ndarray.tolist, np.nonzero(scores >= least[:, None])))}
        assert share < 0 or index.cut.sum() < x.size
