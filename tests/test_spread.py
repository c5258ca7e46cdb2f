"""Ranks and percentiles where most values are equal or close."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.operators import entropy, spread


def values(n=20_000, seed=4):
    g = np.random.default_rng(seed)
    x = np.where(g.random(n) < 0.8, 0.5, g.normal(size=n))
    close = g.random(n) < 0.05
    x[close] = 0.5 + g.random(close.sum()) * 1e-9  # beside the heavy value, in its bucket
    return [(["a", "b"][i % 5 == 0], int(i), float(x[i])) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    data = values()
    return data, spark.createDataFrame(data, "k string, i long, x double").repartition(6).cache()


def test_percentiles(rows):
    data, df = rows
    probs = {f"p{int(p * 1000)}": p for p in (0.0, 0.037, 0.25, 0.5, 0.905, 1.0)}
    for keys in ([], ["k"]):
        for r in spread.group_percentiles(df, keys, "x", probs).collect():
            own = [x for k, _, x in data if not keys or k == r["k"]]
            assert [r[n] for n in probs] == pytest.approx([np.percentile(own, 100 * p) for p in probs.values()], abs=1e-12)


def test_corpus_cut(rows):
    data, df = rows
    tokens = df.withColumnRenamed("x", "entropy")
    for percent in (0.001, 5.0, 30.0, 100.0):
        k = max(1, int(len(data) * percent / 100))
        assert entropy.kth_largest(tokens, percent).first()["cut"] == sorted((x for *_, x in data), reverse=True)[k - 1]


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_with_ties(rows, descending):
    data, df = rows
    got = spread.ranked(df, ["k"], "x", [F.col("i")], "r", descending, "n", limit=300).collect()
    sign = -1 if descending else 1
    for k in "ab":
        order = sorted((sign * x, i) for g, i, x in data if g == k)
        assert [(i, r) for r, (_, i) in enumerate(order)] == sorted(((r["i"], r["r"]) for r in got if r["k"] == k), key=lambda t: t[1])
        assert {r["n"] for r in got if r["k"] == k} == {len(order)}


def test_no_chunk_holds_the_ties(rows):
    _, df = rows
    cut, names = spread.value_chunks(df, ["k"], "x", F.col("i"), limit=300)
    most = cut.groupBy("k", *names).count().agg(F.max("count")).first()[0]
    whole = df.groupBy("k", spread.value_bucket("x")).count().agg(F.max("count")).first()[0]
    assert most <= 900 and whole > 10_000  # the heavy value alone is 80 % of a group


def test_ranks_of_empty_and_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 1.0)], "k string, i long, x double")
    assert [tuple(r) for r in spread.group_percentiles(df, ["k"], "x", {"m": 0.5}).collect()] == [("b", 1.0)]
    assert spread.ranked(df.filter("false"), ["k"], "x", [F.col("i")], "r").count() == 0
